"""SimHash near-duplicate detection with pigeonring candidate filtering.

Fingerprints: the text's ASCII letters are lower-cased, words are runs of
non-whitespace (space and 0x09-0x0D), shingles are ``width`` words in sequence,
repeats included, and a bit is set if more than half of the shingles' XXH64
values have it. Two fingerprints of 64 bits link if at most two bits differ.

Pigeonring. The 64 bits are cut into three segments in a ring. If two
fingerprints differ in at most two bits, some chain of consecutive segments
keeps every prefix within its share of the budget: no difference in the first
segment (a share of 2/3), at most one in the first two (4/3), at most two in
all. A fingerprint is therefore filed under its first two segments exactly, and
probes with each of the second segment's zero bits set; a pair meets under the
probe of the one that lacks the bit. The key of 42 or 43 bits keeps buckets
small, the probes grow in proportion to the input, and only then the full
Hamming distance is taken.

Only distinct fingerprints are compared, so copies never multiply pairs. A
bucket of many distinct fingerprints isn't expanded into pairs either: its
members are tied to hubs instead, namely to themselves and to each value one
bit away. Two values at most two bits apart share a hub, and values that share
one are at most two bits apart, so no link is lost and none is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded, id_and_text, spread_join, stored, texts_of

SEED = 42
#: First bit and number of bits of each segment, from the lowest bit.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
BUDGET = 2
#: Up to so many exact members of a bucket are compared in pairs; larger buckets use hubs.
PAIRS_UP_TO = 48
#: Members of a bucket that are held, and rows of hubs and edges that are sent, at a time.
HELD_ROWS, HUB_ROWS, SENT_ROWS = 65_536, 4096, 100_000
_SIGN = 1 << 63


def fingerprint(text: str, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text; zero if it has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    first, last = starts[:n].tolist(), ends[width - 1 :].tolist()
    for at in range(0, n, 65536):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + 65536], last[at : at + 65536], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long, for every row. Null texts are empty: fingerprint zero."""
    rows = id_and_text(df, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            fps = np.array([fingerprint(t, width) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {id_type}, fp long")


def _keys(fps: DataFrame) -> DataFrame:
    """bucket (which chain, and its first two segments), fp, and whether fp stands there itself or probes."""
    made = []
    for i, (first, n) in enumerate(SEGMENTS):
        then, m = SEGMENTS[(i + 1) % len(SEGMENTS)]
        head = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
        tail = F.shiftrightunsigned("fp", then).bitwiseAND(F.lit((1 << m) - 1).cast("long"))
        # chain number (2 bits), head (22 bits) and tail (22 bits) never overlap
        exact = F.lit(i << 44).cast("long").bitwiseOR(F.shiftleft(head, 22)).bitwiseOR(tail)
        probes = [F.when(tail.bitwiseAND(F.lit(1 << b).cast("long")) == 0, exact.bitwiseOR(F.lit(1 << b).cast("long"))) for b in range(m)]
        made += [F.struct(exact.alias("bucket"), F.lit(True).alias("own"))] + [F.struct(p.alias("bucket"), F.lit(False).alias("own")) for p in probes]
    return fps.select("fp", F.explode(F.array(*made)).alias("k")).select("k.bucket", "fp", "k.own").where("bucket IS NOT NULL")


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _hub_edges(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each value with itself and its 64 neighbours one bit away, in blocks."""
    flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    for at in range(0, fps.size, HUB_ROWS):
        part = fps[at : at + HUB_ROWS]
        hubs = (part.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64)
        yield np.repeat(part, flips.size), hubs.ravel()


def _bucket_edges(own: np.ndarray, probing: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    others = np.concatenate([own, probing])
    if own.size * others.size > PAIRS_UP_TO * PAIRS_UP_TO:
        yield from _hub_edges(others)
    else:
        near = np.bitwise_count(own[:, None].view(np.uint64) ^ others[None, :].view(np.uint64)) <= BUDGET
        a, b = np.nonzero(near & (own[:, None] != others[None, :]))
        yield own[a], others[b]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows that are sorted by bucket, own members first. No more than HELD_ROWS of a bucket are held: what has hubs needs no partner."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    size, bucket, crowded = 0, None, False
    held: list[int] = []
    flags: list[bool] = []

    def closed() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fps, own = np.array(held, np.int64), np.array(flags, bool)
        if crowded:
            yield from _hub_edges(fps)
        elif len(held) > 1 and own.any():
            yield from _bucket_edges(fps[own], fps[~own])

    def sent(edges: Iterator[tuple[np.ndarray, np.ndarray]], least: int) -> Iterator[pa.RecordBatch]:
        nonlocal out, size
        for a, b in edges:
            if a.size:
                out.append((a, b))
                size += a.size
            if size > least:
                yield batch_of(_EDGES, [np.concatenate(x) for x in zip(*out, strict=True)])
                out, size = [], 0

    for batch in batches:
        for key, fp, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key != bucket:
                yield from sent(closed(), SENT_ROWS)
                bucket, held, flags, crowded = key, [], [], False
            held.append(fp)
            flags.append(own)
            # without a member of its own first, a bucket has only probes, which don't link
            if len(held) >= HELD_ROWS:
                if crowded or any(flags):
                    crowded = True
                    yield from sent(closed(), SENT_ROWS)
                held, flags = [], []
    yield from sent(closed(), SENT_ROWS)
    if out:
        yield batch_of(_EDGES, [np.concatenate(x) for x in zip(*out, strict=True)])


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct values of column ``fp`` at most two bits apart; a hub may stand between two."""
    # a value becomes some 36 keys, so it is spread by number first: by its size alone it would seem little work
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = _keys(fps.select("fp").repartition(tasks, "fp").distinct()).repartition("bucket").sortWithinPartitions("bucket", F.desc("own"))
    return sorted_keys.mapInArrow(_linked, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge list; root is the component's smallest node.

    Alternates large and small stars until nothing changes. Each round is two
    aggregations over the edges; it is written to the shared folder, so lineage
    stays short and a lost executor costs one round. Stars are built by joins on
    the node's minimum, a great star's rows spread over several tasks.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        # large star: every larger neighbour of a node points to the node's least neighbour
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, least.select("u", "m"), "u", least.select("u", "n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours point to the least of them
        large = stored(large, "large")
        lows = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, lows.select("u", "m"), "u", lows.select("u", "n")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        now = stored(small, "stars")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of df.

    component_id is the smallest doc_id reachable over links. Null or empty
    texts have fingerprint zero and link like any other. A null doc_id keeps its
    row but never names a component unless all its members are null. Repeated
    rows stay repeated. An empty table gives an empty result; other columns of
    df are not read.
    """
    docs = stored(fingerprints(df, id_col, text_col, width), "fingerprints")
    reps = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(links(reps))
    # a component's hubs have no document of their own
    placed = reps.join(roots, reps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(names, "root").select("fp", "component_id")
    return spread_join(docs, classes, "fp", reps.select("fp", "n")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
