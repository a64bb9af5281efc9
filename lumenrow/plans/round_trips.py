"""Texts written into files by minimal encoders and read back by the decoders.

SQL can't decode, but it knows what must come back: the text's own bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import writers
from ..operators import decode
from .image_queries import query
from .recipes import SQL_BYTES, contents

#: Bytes in a row of the images; the last row is filled with zeros.
WIDTH = 64

_ADLER = "CAST(((max(n) + sum((n - i) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521 AS BIGINT)"
_SAME = f"WITH {SQL_BYTES} SELECT doc_id, CAST(max(n) AS BIGINT) AS n, {_ADLER} AS adler FROM b GROUP BY doc_id"


#: Bytes of texts that are written as files at a time, about.
TOGETHER = 1 << 16


def groups(blobs: list[bytes]) -> Iterator[list[bytes]]:
    """Blobs in groups of about TOGETHER bytes."""
    held: list[bytes] = []
    size = 0
    for blob in blobs:
        held.append(blob)
        size += len(blob)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def written(spark: SparkSession, sf_dir: str, write: Callable[[bytes], bytes] | None = None, together: Callable[[list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """image_id, n, content: each text that isn't empty as a file; all of a group at once by ``together``. A group leaves the worker before the next is written."""
    rows = contents(spark, sf_dir).where(F.octet_length("content") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [b.as_py() for b in batch.column(1)]
            at = 0
            for group in groups(blobs):
                made = together(group) if together else [write(b) for b in group]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array([len(b) for b in group], pa.int64()), pa.array(made, pa.binary())], names=["image_id", "n", "content"])
                at += len(group)

    return rows.mapInArrow(run, "image_id long, n long, content binary")


def _grid(data: bytes, width: int = WIDTH) -> np.ndarray:
    return np.frombuffer(data + bytes(-len(data) % width), np.uint8).reshape(-1, width)


def _checked(rows: DataFrame, channel: int | None = 0) -> DataFrame:
    """From image_id, n and what came back doc_id, n and Adler-32 of the first n bytes; of RGBA pixels those of ``channel``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for n, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                back = blob.as_py() or b""
                sums.append(zlib.adler32((back[channel::4] if channel is not None else back)[:n]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["doc_id", "n", "adler"])

    return rows.mapInArrow(run, "doc_id long, n long, adler long")


def _through(write: Callable[[bytes], bytes], channel: int = 0) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        images = decode.decode_images(written(spark, sf_dir, write), keep=("n",))
        return _checked(images.select("image_id", "n", "pixels"), channel)

    return run


def _png(data: bytes) -> bytes:
    """All five filters in turn, over two chunks of data."""
    rows = _grid(data)
    return writers.png(WIDTH, len(rows), 8, 0, writers.filtered(rows, 1, [i % 5 for i in range(len(rows))]))


def _bmp(data: bytes) -> bytes:
    """Run lengths: pairs where bytes repeat, else one by one; the palette is gray."""
    body = bytearray()
    for row in _grid(data):
        edges = np.flatnonzero(np.diff(row)) + 1
        for first, last in zip([0, *edges.tolist()], [*edges.tolist(), WIDTH], strict=True):
            body += bytes([last - first, row[first]])
        body += b"\0\0"
    body += b"\0\1"
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1).tobytes()
    height = len(_grid(data))
    return writers.bmp(WIDTH, -height, 8, bytes(body), 1, palette)


def _pgm(data: bytes) -> bytes:
    grid = _grid(data)
    return b"P5\n# text\n%d %d\n255\n" % (WIDTH, len(grid)) + grid.tobytes()


def _webp(data: bytes) -> bytes:
    """Bytes as the red of lossless pixels, less green, which is put back."""
    v = _grid(data).astype(np.int64)
    green = (v * 7 + 3) & 255
    return writers.webp(writers.vp8l(0xFF000000 | ((v - green) & 255) << 16 | green << 8, [(2, 0, None)]))


def block_sums(files: DataFrame, key: str, value: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the column ``key`` of the files or their blocks, blocks and at_coef: the number of blocks, and the sum of what ``value`` makes of a block's coefficients and place. Rows of one image and key that follow each other are summed up; few are left to group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column("image_id"), batch.column(key)]
            known = [c.is_valid().to_numpy(zero_copy_only=False) for c in columns]
            coefs, place = batch.column("coef").flatten().to_numpy().reshape(-1, 64), batch.column("block").to_numpy().astype(np.int64)
            new = np.arange(len(place)) == 0
            for x in (*known, *(c.fill_null(0).to_numpy() for c in columns)):
                new[1:] |= x[1:] != x[:-1]
            first = np.flatnonzero(new)
            made = [np.diff(first, append=len(place)), np.add.reduceat(value(coefs, place), first)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in columns), *map(pa.array, made)], names=["doc_id", key, "blocks", "at_coef"])

    type_ = files.schema[key].dataType.simpleString() if key in keep else "int"
    return decode.jpeg_coefficients(files, keep, (run, f"doc_id long, {key} {type_}, blocks long, at_coef long"))


#: Bytes that one JPEG block carries, as its first coefficients.
BLOCK_BYTES = 8


def _jpeg_image(data: bytes) -> tuple[int, int, list[tuple]]:
    """A block for each eight bytes less 128; steps of 1, and of 8 for the mean."""
    v = _grid(data + b"\x80" * (-len(data) % BLOCK_BYTES), BLOCK_BYTES).astype(int) - 128
    width = min(64, len(v))
    coefs = np.zeros((-(-len(v) // width) * width, 64), int)
    coefs[: len(v), :BLOCK_BYTES] = v
    return 8 * width, 8 * (len(coefs) // width), [(1, 1, 1, 0, coefs)]


def _jpegs(texts: list[bytes]) -> list[bytes]:
    """An interval is a row."""
    images = [_jpeg_image(t) for t in texts]
    return writers.jpegs(images, [[8] + [1] * 63], [width // 8 for width, _, _ in images])


@query(_SAME)
def png_roundtrip(spark, sf_dir):
    return _through(_png)(spark, sf_dir)


@query(_SAME)
def bmp_rle8_roundtrip(spark, sf_dir):
    return _through(_bmp)(spark, sf_dir)


@query(_SAME)
def pnm_binary_roundtrip(spark, sf_dir):
    return _through(_pgm)(spark, sf_dir)


@query(_SAME)
def webp_roundtrip(spark, sf_dir):
    return _through(_webp)(spark, sf_dir)


@query(_SAME)
def inflate_roundtrip(spark, sf_dir):
    files = written(spark, sf_dir, lambda b: zlib.compress(b, 6))
    return _checked(decode.inflated(files, keep=("n",)).select("image_id", "n", "data"), None)


@query(f"WITH {SQL_BYTES} SELECT doc_id, CAST(max(n) AS BIGINT) AS n, CAST(sum((v - 128) * CASE WHEN i % {BLOCK_BYTES} = 0 THEN 8 ELSE 1 END * (i % 1009 + 1)) AS BIGINT) AS at_coef FROM b GROUP BY doc_id")
def jpeg_entropy_roundtrip(spark, sf_dir):
    """The coefficients out of the entropy-coded data, times their steps."""
    files = written(spark, sf_dir, together=_jpegs)
    k = np.arange(BLOCK_BYTES)
    sums = block_sums(files, "n", lambda coefs, block: (coefs[:, :BLOCK_BYTES] * np.where(k == 0, 8, 1) * ((block[:, None] * BLOCK_BYTES + k) % 1009 + 1)).sum(axis=1), ("n",))
    return sums.groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("at_coef").alias("at_coef"))


@query("SELECT doc_id, CAST(5 AS BIGINT) AS chunks, true AS all_ok, octet_length(encode(text)) AS bytes FROM documents WHERE octet_length(encode(text)) > 0")
def png_chunk_walk(spark, sf_dir):
    """IHDR, tEXt with the text, two of IDAT and IEND, all with good checksums."""
    files = written(spark, sf_dir, lambda b: writers.png(1, 1, 8, 0, [b"\0\0"], [(b"tEXt", b"text\0" + b)]))
    chunks = decode.png_chunks(files).groupBy(F.col("image_id").alias("doc_id"))
    return chunks.agg(F.count("*").alias("chunks"), F.bool_and("crc_ok").alias("all_ok"), (F.max(F.when(F.col("type") == "tEXt", F.col("length"))) - 5).alias("bytes"))


