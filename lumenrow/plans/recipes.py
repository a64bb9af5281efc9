"""Inputs made from the driver's tables, whole texts throughout, and the SQL for the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the rasters made of a text's bytes; zeros fill the last row up.
RASTER_WIDTH = 32
#: Rows that a worker sends at a time.
SENT_ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: each text's UTF-8 bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))


def filled(data: bytes, unit: int) -> np.ndarray:
    """The bytes, zeros filling them up to a multiple of ``unit``."""
    return np.frombuffer(data + bytes(-len(data) % unit), np.uint8)


def arrays(spark: SparkSession, sf_dir: str, unit: int = 1) -> DataFrame:
    """doc_id, n, b: the bytes of each text that isn't empty as array<int>, filled up to a multiple of ``unit``; n is the text's own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [b.as_py() for b in batch.column(1)]
            parts = [filled(b, unit) for b in blobs]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.uint8)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in blobs], pa.int32()), lists], names=["doc_id", "n", "b"])

    return contents(spark, sf_dir).where("octet_length(content) > 0").mapInArrow(run, "doc_id long, n int, b array<int>")


def _rows(spark: SparkSession, sf_dir: str, make: Callable[[bytes], dict[str, np.ndarray]], ddl: str) -> DataFrame:
    """Rows made of each text that isn't empty, as columns of equal length, behind doc_id. Rows leave the worker as Arrow columns, so no array is taken apart in the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[dict[str, np.ndarray]] = []
            ids: list[np.ndarray] = []

            def sent() -> pa.RecordBatch:
                columns = {k: np.concatenate([h[k] for h in held]) for k in held[0]}  # noqa: B023
                return pa.RecordBatch.from_pydict({"doc_id": np.concatenate(ids), **columns})  # noqa: B023

            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made = make(blob.as_py())
                n = len(next(iter(made.values())))
                held.append(made)
                ids.append(np.full(n, doc, np.int64))
                if sum(map(len, ids)) >= SENT_ROWS:
                    yield sent()
                    held, ids = [], []
            if held:
                yield sent()

    return contents(spark, sf_dir).where("octet_length(content) > 0").mapInArrow(run, f"doc_id long, {ddl}")


def byte_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, i, v: a row per byte."""

    def make(data: bytes) -> dict[str, np.ndarray]:
        v = np.frombuffer(data, np.uint8).astype(np.int32)
        return {"n": np.full(len(v), len(v), np.int32), "i": np.arange(len(v), dtype=np.int32), "v": v}

    return _rows(spark, sf_dir, make, "n int, i int, v int")


def words(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """doc_id, k and the bytes b0, b1, ... of each group of ``size`` bytes; zeros fill the last one up."""

    def make(data: bytes) -> dict[str, np.ndarray]:
        groups = filled(data, size).reshape(-1, size).astype(np.int64)
        return {"k": np.arange(len(groups)), **{f"b{j}": groups[:, j] for j in range(size)}}

    return _rows(spark, sf_dir, make, "k long, " + ", ".join(f"b{j} long" for j in range(size)))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, h, x, y, v: the bytes as a gray image of RASTER_WIDTH columns; zeros fill the last row up."""

    def make(data: bytes) -> dict[str, np.ndarray]:
        v = filled(data, RASTER_WIDTH).astype(np.int64)
        i = np.arange(len(v), dtype=np.int32)
        return {"h": np.full(len(v), len(v) // RASTER_WIDTH, np.int32), "x": i % RASTER_WIDTH, "y": i // RASTER_WIDTH, "v": v}

    return _rows(spark, sf_dir, make, "h int, x int, y int, v long")


def value_sums(spark: SparkSession, sf_dir: str, unit: int, **values: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id, n, and of values worked out from each text's filled-up bytes their sum and their sum weighted by place: no row per byte is made."""

    def make(data: bytes) -> dict[str, np.ndarray]:
        bytes_, out = filled(data, unit), {}
        for name, f in values.items():
            v = np.asarray(f(bytes_)).astype(np.int64).ravel()
            out.setdefault("n", np.array([len(v)], np.int64))
            out |= {f"sum_{name}": np.array([v.sum()]), f"at_{name}": np.array([v @ (np.arange(len(v)) % 1009 + 1)])}
        return out

    return _rows(spark, sf_dir, make, "n long, " + ", ".join(f"sum_{name} long, at_{name} long" for name in values))


def summed(rows: DataFrame, keys: list[str], place: Column, **values: Column) -> DataFrame:
    """Of each value its sum, and its sum weighted by a place, so that what moves shows."""
    made = [x for name, v in values.items() for x in (F.sum(v.cast("long")).alias(f"sum_{name}"), F.sum(v.cast("long") * (F.pmod(place.cast("long"), F.lit(1009)) + 1)).alias(f"at_{name}"))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *made)


def sql_summed(keys: str, place: str, source: str, **values: str) -> str:
    made = ", ".join(f"CAST(sum({v}) AS BIGINT) AS sum_{name}, CAST(sum(({v}) * (({place}) % 1009 + 1)) AS BIGINT) AS at_{name}" for name, v in values.items())
    return f"SELECT {keys}, count(*) AS n, {made} FROM {source} GROUP BY {keys}"


#: doc_id, n, i, v: a row per byte.
SQL_BYTES = "b AS (SELECT doc_id, n, unnest(range(n)) AS i, CAST('0x' || unnest(regexp_extract_all(h, '..')) AS BIGINT) AS v FROM (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents) AS d)"


def sql_padded(unit: int) -> str:
    """pb: doc_id, i, v of each text's bytes and the zeros that fill it up to a multiple of ``unit``; s: doc_id and the size m of that."""
    return f"{SQL_BYTES}, s AS (SELECT doc_id, max(n) AS n, (max(n) + {unit - 1}) // {unit} * {unit} AS m FROM b GROUP BY doc_id), pb AS (SELECT doc_id, i, v FROM b UNION ALL SELECT doc_id, unnest(range(n, m)), 0 FROM s)"


SQL_RASTER = f"{sql_padded(RASTER_WIDTH)}, p AS (SELECT pb.doc_id, m // {RASTER_WIDTH} AS h, i % {RASTER_WIDTH} AS x, i // {RASTER_WIDTH} AS y, v FROM pb JOIN s ON pb.doc_id = s.doc_id)"


def sql_words(size: int) -> str:
    """The groups of ``size`` bytes as relation w."""
    parts = ", ".join(f"max(CASE WHEN i % {size} = {j} THEN v END) AS b{j}" for j in range(size))
    return f"{sql_padded(size)}, w AS (SELECT doc_id, i // {size} AS k, {parts} FROM pb GROUP BY doc_id, i // {size})"
