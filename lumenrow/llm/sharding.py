"""Sharding by a k-d tree over metadata.

The tree starts with all rows and the number of shards. A node that stands for
more than one shard is split along its widest dimension, at the weighted
quantile that gives each side its share of the bytes (the median where shards
halve evenly), until every leaf has its target. A node is as wide along a
dimension as the share of all bytes that lies between its ends there, so
dimensions of any scale can be compared.

A dimension is a whole number of 16 bits. Behind it a row's key has a hash of
its text, so equal texts lie together, and a hash of the row's own number, so
that even rows that are alike can be told apart where a third of all are. A cut
inside a group of equal texts is moved to the group's end if the group is small.

The quantile is found by counting: bytes are summed over equal ranges of the key
for all nodes of a level at once, and the range that holds the quantile is cut
again until it holds next to nothing. Only those sums, of a fixed number for
each node, reach the driver. The rows are written before the first cut; a node
is an expression over the cuts found so far.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stored

SHARDS = 24
#: Bits of a key: the dimension, a hash of the text, a hash of the row's number.
DIM_BITS, TEXT_BITS, ROW_BITS = 16, 17, 22
TIE_BITS = TEXT_BITS + ROW_BITS
#: Each round cuts a range into 2 ** ROUND_BITS; the bits below the first round's are a multiple of it.
ROUND_BITS = 11
#: A quantile is near enough when its range holds this share of a shard's bytes; a group of equal texts stays whole up to this share.
TOLERANCE, WHOLE_GROUP = 2e-4, 5e-3
#: Rows of a shard that are numbered together, about.
SLOT_ROWS = 20_000


def _bits(c: Column, n: int) -> Column:
    return F.xxhash64(c).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def dimensions(df: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """The dimensions of documents: language and source (in the order of a hash) and logarithmic length, those of them that df has. A null has a place of its own."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    made = {"length": F.least(F.log2(size + F.lit(1)) * 2000, F.lit((1 << DIM_BITS) - 1)).cast("long")}
    made |= {name: _bits(F.col(name), DIM_BITS) for name in ("lang", "source") if name in df.columns}
    return made


#: A cut: the dimension, and the key from which on rows go to the second part.
Cut = tuple[str, int]
#: A node: its first shard and how many it stands for.
Node = tuple[int, int]


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(dim), TIE_BITS).bitwiseOR(F.col("tie"))


def parts_of(node: Node) -> tuple[Node, Node]:
    first, shards = node
    return (first, shards // 2), (first + shards // 2, shards - shards // 2)


def node_of(cuts: dict[Node, Cut], node: Node) -> Column:
    """The first shard of the node that a row is in, as far as cuts are known."""
    if node not in cuts:
        return F.lit(node[0])
    dim, at = cuts[node]
    left, right = parts_of(node)
    return F.when(_key(dim) < at, node_of(cuts, left)).otherwise(node_of(cuts, right))


def _summed(rows: DataFrame, *keys: str) -> list:
    return rows.groupBy(*keys).agg(F.sum("size").alias("size")).collect()


def _level(rows: DataFrame, nodes: list[Node], dims: list[str], ranks: dict[tuple[str, int], float]) -> dict[Node, Cut]:
    """The cuts of a level's nodes, one pass over the rows for each round; ``ranks`` gets the place of each range among all bytes on the first level."""
    shift = DIM_BITS + TIE_BITS - ROUND_BITS
    here = rows.where(F.col("node").isin([first for first, _ in nodes]))
    every = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.shiftright(_key(d), shift).alias("cell")) for d in dims)))
    sums: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for r in _summed(here.select("node", "size", every.alias("e")).select("node", "size", "e.*"), "node", "dim", "cell"):
        sums.setdefault((r["node"], r["dim"]), []).append((r["cell"], r["size"]))
    if not ranks:
        for (_, dim), cells in sums.items():
            cells.sort()
            total = sum(size for _, size in cells)
            ranks |= {(dim, cell): (end - size / 2) / total for (cell, size), end in zip(cells, accumulate(size for _, size in cells), strict=True)}
    cuts: dict[Node, Cut] = {}
    open_ = {}
    for node in nodes:
        found = {d: sorted(sums[node[0], d]) for d in dims if (node[0], d) in sums}
        if not found:  # no row is in it
            cuts[node] = (dims[0], 0)
            continue
        wide = lambda d: ranks[d, found[d][-1][0]] - ranks[d, found[d][0][0]]  # noqa: B023, E731
        dim = max(dims, key=lambda d: (wide(d), d))
        size = sum(s for _, s in found[dim])
        open_[node] = {"dim": dim, "low": 0, "cells": found[dim], "before": 0, "want": size * parts_of(node)[0][1] / node[1], "shard": size / node[1]}
    while True:
        for node, o in [*open_.items()]:
            for cell, size in o["cells"]:
                if o["before"] + size >= o["want"]:
                    break
                o["before"] += size
            low = o["low"] + (cell << shift)
            if shift == 0 or size <= o["shard"] * (WHOLE_GROUP if shift == ROW_BITS else TOLERANCE):
                # the whole range goes to the side it lies nearer to
                cuts[node] = (o["dim"], low + (1 << shift) if o["want"] - o["before"] >= size / 2 else low)
                del open_[node]
            else:
                o["low"] = low
        if not open_:
            return cuts
        last, shift = shift, shift - ROUND_BITS
        cell = F.lit(None).cast("long")
        for node, o in open_.items():
            key = _key(o["dim"])
            cell = F.when((F.col("node") == node[0]) & (F.shiftright(key, last) == o["low"] >> last), F.shiftright(key - F.lit(o["low"]), shift)).otherwise(cell)
        counted: dict[int, list[tuple[int, int]]] = {}
        for r in _summed(here.select("node", "size", cell.alias("cell")).where("cell IS NOT NULL"), "node", "cell"):
            counted.setdefault(r["node"], []).append((r["cell"], r["size"]))
        for node, o in open_.items():
            o["cells"] = sorted(counted[node[0]])


def kd_shards(df: DataFrame, shards: int = SHARDS, dims: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row.

    size is the text's UTF-8 bytes (null: none) plus 8; shards are 0 to
    ``shards`` - 1 and nearly equal in bytes (law ``bytes``), however many rows
    are alike; slots are gapless from 0 in each shard; grown_shard is null under
    this law. Equal texts share a shard unless a cut falls into their group and
    it is more than WHOLE_GROUP of a shard; for the tree they all have the least
    metadata among them. Null doc_ids and metadata are values like any other. An empty table gives an empty
    result; other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = dimensions(df, text_col) if dims is None else dims
    names = [f"d_{d}" for d in dims]
    rows = df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        F.monotonically_increasing_id().alias("n"), *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in zip(names, dims.values(), strict=True)),
    )
    # the numbers are written with the rows, so they stay as they are whichever task is run again
    rows = stored(rows, "metadata")
    # rows of one text take the least metadata among them, so that no dimension parts them
    groups = rows.groupBy("text_hash").agg(F.min(F.struct(*names)).alias("least"), F.count("*").alias("rows")).where("rows > 1")
    joined = spread_join(rows, groups.select("text_hash", "least"), "text_hash", groups.select("text_hash", F.col("rows").alias("n")), "left")
    tie = F.shiftleft(_bits(F.col("text_hash"), TEXT_BITS), ROW_BITS).bitwiseOR(_bits(F.col("n"), ROW_BITS))
    rows = stored(joined.select("doc_id", "size", "text_crc32", "n", tie.alias("tie"), *(F.coalesce(F.col("least")[d], F.col(d)).alias(d) for d in names)), "placed")
    root, cuts, ranks = (0, shards), {}, {}
    level = [root]
    while level := [n for n in level if n[1] > 1]:
        cuts |= _level(rows.withColumn("node", node_of(cuts, root)), level, names, ranks)
        level = [part for n in level for part in parts_of(n)]
    count = rows.count()
    parts = max(1, -(-count // (shards * SLOT_ROWS)))
    dealt = rows.select("doc_id", "size", "text_crc32", node_of(cuts, root).cast("int").alias("shard"), F.pmod(F.xxhash64("n", F.lit(1)), F.lit(parts)).cast("int").alias("part"), "n")
    # a slot is the rows of the shard's earlier parts and the place in the own part: no task numbers a whole shard
    sizes = dealt.groupBy("shard", "part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "part", "before")
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("n"))
    placed = dealt.withColumn("own", own).join(sizes, ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
