"""Image files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import bytesx
from ..operators.decode import decode_images
from ..sources.images import EXTENSIONS, glob

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def decode_arrivals(spark: SparkSession, path: str, files_per_trigger: int = 1000, mode: str = "PERMISSIVE", pixels: bool = True) -> DataFrame:
    """A stream of decoded rows, image_id being the file's name. Decoding keeps no state, so a restart only needs Spark's own record of files."""
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", glob(EXTENSIONS)).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return decode_images(files.withColumn("image_id", bytesx.basename(files["path"])), mode, pixels)
