"""Media columns: WAV payloads and spectral-peak pair fingerprints.

A payload is stored as 8-bit mono samples in a WAV file held in a binary
column. ``wave`` reads it back; the samples go through a short-time Fourier
transform, local maxima of the magnitude become peaks, and each peak is paired
with the next few. A pair's two frequencies and time difference make a hash;
hashes are kept with the frame of their first peak, as two parallel arrays.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, id_and_text, texts_of

#: Payloads are filled up with bytes 255 to a positive multiple of this.
UNIT = 576
FILL = b"\xff"
RATE = 8000
FRAME, HOP = 192, 96
#: Frames transformed at a time, so that long payloads need no more memory.
BLOCK_FRAMES = 4096
#: Bands of the spectrum; each frame offers its strongest bin of each.
BANDS = ((2, 8), (8, 24), (24, 48), (48, 97))
#: A band's strongest bin counts as a peak if it reaches this many times the band's mean.
PEAK_RATIO = 1.8
#: Later peaks that a peak is paired with.
FAN_OUT = 3
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str) -> tuple[bytes, int]:
    """The UTF-8 bytes, filled up, and how many are the text's own."""
    data = text.encode("utf-8", "surrogatepass")
    return data + FILL * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)), len(data)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file whose 8-bit samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of each spectral peak, by frame and then bin."""
    x = np.frombuffer(samples, np.uint8)
    if x.size < FRAME:
        x = np.concatenate([x, np.full(FRAME - x.size, 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for at in range(0, len(frames), BLOCK_FRAMES):
        block = frames[at : at + BLOCK_FRAMES].astype(np.float32)
        block -= block.mean(axis=1, keepdims=True)
        block *= _WINDOW
        spectrum = np.fft.rfft(block, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for low, high in BANDS:
            band = power[:, low:high]
            best = band.argmax(axis=1)
            strong = np.flatnonzero(band[np.arange(len(band)), best] > PEAK_RATIO**2 * band.mean(axis=1))
            times.append(strong + at)
            bins.append(best[strong] + low)
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def pair_hashes(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and hashes of peak pairs: first bin (9 bits), second bin (9 bits), frames between (12 bits, at most 4095)."""
    times, hashes = [], []
    for k in range(1, FAN_OUT + 1):
        a, b, n = f[:-k], f[k:], np.minimum(t[k:] - t[:-k], 4095)
        times.append(t[:-k])
        hashes.append((a << 21) | (b << 12) | n)
    at, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, at))
    return at[order].astype(np.int32), h[order].astype(np.int32)


def media_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Each row's text as a WAV payload and what is computed from the stored bytes.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (the pairs' time codes and hashes as big-endian hex),
    pair_times and pair_hashes (array<int>) and, if ``keep_media``, media. A
    null or empty text is a payload of 576 fill bytes, which has no peaks and an
    empty feature. Equal texts have equal values; repeated rows and null doc_ids
    stay; an empty table gives an empty result; other columns aren't read.
    """
    rows = id_and_text(df, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pair_times", "pair_hashes"] + ["media"] * keep_media
        for batch in bounded(batches):
            own, size, sha, tail, stored_size, stored_sha, feature, at, h, kept = ([] for _ in range(10))
            for text in texts_of(batch):
                payload, n = payload_of(text)
                media = to_wav(payload)
                back = from_wav(media)
                times, hashes = pair_hashes(*peaks(back))
                own.append(n)
                size.append(len(back))
                sha.append(hashlib.sha256(back).hexdigest())
                tail.append(zlib.crc32(back[-32:]))
                stored_size.append(len(media))
                stored_sha.append(hashlib.sha256(media).hexdigest())
                feature.append(np.stack([times, hashes], axis=1).astype(">u4").tobytes().hex())
                at.append(times)
                h.append(hashes)
                if keep_media:
                    kept.append(media)
            longs, ints = pa.int64(), pa.list_(pa.int32())
            columns = [batch.column(0), pa.array(own, longs), pa.array(size, longs), pa.array(sha, pa.string()), pa.array(tail, longs), pa.array(stored_size, longs), pa.array(stored_sha, pa.string()), pa.array(feature, pa.string()), pa.array(at, ints), pa.array(h, ints)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_media, names=names)

    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pair_times array<int>, pair_hashes array<int>"
    return rows.mapInArrow(run, schema + ", media binary" * keep_media)
