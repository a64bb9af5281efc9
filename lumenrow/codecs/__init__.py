"""Image decoders over bytes and numpy arrays, without Spark."""
