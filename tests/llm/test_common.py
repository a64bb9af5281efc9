"""What the corpus operators share."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lumenrow.llm import common


def test_a_cluster_needs_a_shared_folder():
    """No folder of one machine stands in for the shared one unless the master is local."""
    conf = SimpleNamespace(get=lambda *a: a[1] if len(a) > 1 else None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))
    named = SimpleNamespace(get=lambda *a: "hdfs://x/y")
    assert common.shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: named), conf=conf)) == "hdfs://x/y"


def test_stored_tables_can_be_removed(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(common, "_STORED", paths)
    kept = common.stored(spark.range(5).toDF("a"), "five")
    assert kept.count() == 5 and len(paths) == 1
    path = paths[0].removeprefix("file://")
    assert os.path.isdir(path)
    common.remove_stored(spark)
    assert not paths and not os.path.exists(path)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, how):
    """Half of the rows under one key, a key without a partner, a null key: as a plain join, with the hot key in many parts."""
    left = spark.range(4000).select(F.col("id").alias("x"), F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") == 1, F.lit(None)).otherwise(F.col("id") % 50).cast("long").alias("key"))
    right = spark.range(0, 45).select(F.col("id").alias("key"), (F.col("id") * 10).alias("y"))
    counts = left.groupBy("key").agg(F.count("*").alias("n"))
    got = common.spread_join(left, right, "key", counts, how)
    want = left.join(right, "key", how).select("x", "y").collect()
    assert sorted(map(tuple, got.select("x", "y").collect()), key=str) == sorted(map(tuple, want), key=str)
    assert "salt_" not in got.columns and "salts_" not in got.columns


def test_batches_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "TEXT_ROWS_PER_BATCH", 3)
    batch = pa.RecordBatch.from_pydict({"a": list(range(8))})
    assert [b.num_rows for b in common.bounded([batch, batch.slice(0, 0)])] == [3, 3, 2]
