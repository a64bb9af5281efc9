"""Shared storage and Arrow helpers of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold when the operator's rows carry whole texts.
TEXT_ROWS_PER_BATCH = 1024
#: Keys with more than this part of all rows are spread over several tasks.
SPREAD = 1000
#: Paths of the tables written so far.
_STORED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master an own one where that is unset.

    On a cluster a folder of one machine is none that executors share, so there the setting must be given.
    """
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not place:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        spark.sparkContext.setCheckpointDir(place)
    return place


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later reads don't depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> None:
    """Delete all tables that ``stored`` wrote in this process, once no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """left join right on ``key``, where right has a key once at most and left may have a third of its rows under one.

    ``counts`` has key and n, left's rows under each key. Keys with more than a
    share of 1 / SPREAD of all rows get salts in proportion, so that no salted
    key has a greater share. There are SPREAD such keys at most: they are
    broadcast whatever the data's size.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("n") * SPREAD > total).select(key, F.ceil(F.col("n") * SPREAD / F.lit(max(total, 1))).cast("int").alias("salts_")))
    many = F.coalesce("salts_", F.lit(1))
    salted = left.join(hot, key, "left").withColumn("salt_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), many).cast("int")).drop("salts_")
    repeated = right.join(hot, key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), many - 1))).drop("salts_")
    return salted.join(repeated, [key, "salt_"], how).drop("salt_")


def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows at a time, cut in the worker, so that no setting of the session is touched. Spark bounds their bytes by itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXT_ROWS_PER_BATCH):
            yield batch.slice(at, TEXT_ROWS_PER_BATCH)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under names of its own; a null text counts as empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts; nulls are empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A record batch from columns in schema order."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
