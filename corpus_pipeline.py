"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.llm import packing, secrets, simhash, toxicity
from lumenrow.llm.common import stored
from lumenrow.llm.queries import WORD_VOCABULARY, table

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model of op5 finds toxic; the model is learned from the labels of the rows at hand.

    Null and empty texts have no term and stay, as do repeated rows and rows
    without an id if their text isn't toxic. Without labels nothing is toxic.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest doc_id, and of rows with one doc_id and text one.

    Null and empty texts are near copies of each other; a null doc_id counts as
    greater than any other. Repeats go before the shuffle, so a row that is
    there many times doesn't meet in one task.
    """
    free = lambda name: name if name not in docs.columns else free(name + "_")
    names = [free(n) for n in ("key_missing", "key_id", "key_hash")]
    keys = dict(zip(names, (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64(F.coalesce("text", F.lit("")))), strict=True))
    keyed = docs.withColumns(keys)
    groups = simhash.near_duplicates(keyed.select(F.struct(*names).alias("doc_id"), "text"))
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id.*").distinct()
    return keyed.dropDuplicates(names).join(kept, names, "left_semi").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; n_chars follows the text. Every row stays; a null text stays null."""
    return secrets.redact(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token windows. Null and empty texts have an end token; repeated rows and null ids are packed like any others."""
    return packing.pack(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [("toxicity", without_toxic), ("near_duplicates", near_duplicates), ("secrets", without_secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
