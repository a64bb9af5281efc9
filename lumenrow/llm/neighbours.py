"""Nearest neighbours by cross-polytope hashing with calibrated multiprobe.

Vectors are dealt into bands of like norms. Within a band they are scaled by its
greatest norm and given one more component that makes them unit vectors, so that
the largest inner product is the nearest direction. Each table turns them by
pseudo-rotations (three rounds of random signs and a fast Hadamard transform)
and takes the nearest signed axis of each; the axes together are the cell. How
many rotations a cell has, and how many axes count, follows from the band's
size, so that a cell holds about CELL_ROWS vectors at any size.

A query's weight of a cell is how far its own turned vector points along the
cell's axes, in proportion to the band's norm. It probes all cells, of all
tables and bands, whose weight reaches a threshold. The threshold is measured:
for a bounded sample of queries the true neighbours are found in all rows, and
it is set so that the share RECALL of them lies in a probed cell. A band whose
norm can't reach a query's floor (what it finds in a bounded sample of vectors)
is left out, which loses nothing. A query that finds fewer than k neighbours
goes through all rows, in blocks.

Candidates are scored on the original vectors. Equal vectors are one class. A
class keeps only its smallest ids, as no query can return more, so a vector that
a third of all rows share costs no more than another. Great cells are dealt into
blocks, and a query visits all blocks of its cells: nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import spread_join, stored

K = 20
TABLES = 16
#: Vectors of a cell, about.
CELL_ROWS = 64
#: Share of the sampled queries' true neighbours that the probed cells hold.
RECALL = 0.96
#: Queries (of each length of vectors) that the threshold is measured on, and vectors that give queries their floors, those with the least hashes.
SAMPLE_QUERIES, FLOOR_ROWS = 256, 2048
#: Vectors and queries of a cell that one task takes together; queries that are multiplied at a time.
BLOCK_CANDIDATES, BLOCK_QUERIES, TILE = 32_768, 65_536, 1024
#: Norms that differ by less than a factor of 2 ** (1 / BANDS) are one band.
BANDS = 4
#: Rows of an Arrow batch that are coded at a time, and pairs that are scored at a time.
CODED_ROWS, SCORED_PAIRS = 1024, 20_000
#: Pairs that a task holds of the best it has found so far, before it sends them on.
HELD_PAIRS = 1_000_000
#: Great cells up to this number are broadcast.
BROADCAST_CELLS = 100_000
#: Bits of a cell's number below its band's and table's.
CODE_BITS = 40


def _signs_of(n: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of order n."""
    out = np.ones((1, 1))
    while len(out) < n:
        out = np.block([[out, out], [out, -out]])
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the row length is a power of two.

    A transform of a * b is one of b in each row of an a x b matrix and one of a
    in each column, so n * (a + b) steps do for n * n.
    """
    n = x.shape[1]
    a = 1 << (n.bit_length() - 1) // 2
    b = n // a
    rows = (x.reshape(-1, b) @ _signs_of(b)).reshape(-1, a, b)
    columns = np.ascontiguousarray(rows.swapaxes(1, 2)).reshape(-1, a) @ _signs_of(a)
    return columns.reshape(-1, b, a).swapaxes(1, 2).reshape(-1, n) / np.sqrt(n)


@lru_cache(maxsize=256)
def _signs(seed: int, size: int) -> np.ndarray:
    return np.random.default_rng(1000 + seed).choice((-1.0, 1.0), (3, size))


def turned(x: np.ndarray, seed: int, size: int) -> np.ndarray:
    """Rows padded to ``size`` and pseudo-rotated."""
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    for s in _signs(seed, size):
        out = hadamard(out * s)
    return out


def padded_size(dim: int) -> int:
    """The least power of two that holds a vector and its added component."""
    return 1 << dim.bit_length()


def _lifted(x: np.ndarray, greatest: float, query: bool) -> np.ndarray:
    """Unit vectors: candidates scaled by the greatest norm with what is missing added, queries by their own norm."""
    if query:
        return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
    x = x / greatest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])


class Band(NamedTuple):
    """Vectors of one length and of like norms. Its cells in a table are the signed first ``axes`` axes of ``hashes`` rotations; without any it is one cell."""

    number: int
    dim: int
    greatest: float
    held: int
    hashes: int
    axes: int

    def cell(self, table: int) -> int:
        """The number of a table's first cell."""
        return (self.number * TABLES + table) << CODE_BITS

    @property
    def reach(self) -> float:
        """What a vector has along the axis nearest to it, about, times the band's norm."""
        return self.greatest * np.sqrt(2 * np.log(2 * self.axes + 1) / padded_size(self.dim))


def band_of(number: int, dim: int, greatest: float, held: int) -> Band:
    cells, size = held / CELL_ROWS, padded_size(dim)
    hashes = 0
    while (2 * size) ** hashes < cells:
        hashes += 1
    axes = min(size, max(1, round(cells ** (1 / hashes) / 2))) if hashes else 0
    return Band(number, dim, greatest, held, hashes, axes)


def digits(x: np.ndarray, band: Band, table: int) -> np.ndarray:
    """For each candidate row 2 * axis + (1 if negative) in each of the table's rotations."""
    out, size, lifted = np.empty((len(x), band.hashes), np.int64), padded_size(band.dim), _lifted(x, band.greatest, False)
    for h in range(band.hashes):
        z = turned(lifted, table * 8 + h, size)[:, : band.axes]
        axis = np.abs(z).argmax(axis=1)
        out[:, h] = 2 * axis + (z[np.arange(len(z)), axis] < 0)
    return out


def coded(found: np.ndarray, band: Band, table: int) -> np.ndarray:
    """Cells of rows of digits."""
    out = np.zeros(len(found), np.int64)
    for h in range(band.hashes):
        out = out * (2 * band.axes) + found[:, h]
    return out + band.cell(table)


def pointing(x: np.ndarray, table: int, h: int) -> np.ndarray:
    """What each query row's unit vector has in the direction of every signed axis of a rotation."""
    size = padded_size(x.shape[1])
    y = turned(_lifted(x, 1.0, True), table * 8 + h, size)
    z = np.empty((len(x), 2 * size))
    z[:, ::2], z[:, 1::2] = y, -y
    return z


def reaching(along: list[np.ndarray], least: float) -> np.ndarray:
    """The codes whose digits' values, one of each array, sum up to ``least`` or more."""
    sums, codes = np.zeros(1), np.zeros(1, np.int64)
    for h, z in enumerate(along):
        best = sum(a.max() for a in along[h + 1 :])
        both = sums[:, None] + z[None, :]
        i, j = np.nonzero(both + best >= least)
        sums, codes = both[i, j], codes[i] * len(z) + j
    return codes


def probes_of(x: np.ndarray, floors: np.ndarray, bands: list[Band], threshold: float, tables: int) -> list[np.ndarray]:
    """For each query row the cells it probes: those of weight ``threshold`` or more in bands that can reach its floor."""
    norm, top = np.linalg.norm(x, axis=1), max(b.greatest for b in bands)
    deepest = max(b.hashes for b in bands)
    found: list[list[np.ndarray]] = [[] for _ in x]
    for t in range(tables):
        z = [pointing(x, t, h) for h in range(deepest)]
        for b in bands:
            if t and not b.hashes:
                continue  # one cell, held by the first table
            for i in np.flatnonzero(norm * b.greatest * (1 + 1e-9) >= floors).tolist():
                codes = reaching([z[h][i, : 2 * b.axes] for h in range(b.hashes)], threshold * top / b.reach) if b.hashes else np.zeros(1, np.int64)
                found[i].append(codes + b.cell(t))
    return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


def weights_of(x: np.ndarray, y: np.ndarray, band: Band, top: float, tables: int) -> np.ndarray:
    """For queries and a true neighbour of each, in ``band``: the greatest weight of a cell that holds the neighbour."""
    if not band.hashes:
        return np.full(len(x), np.inf)
    best = np.full(len(x), -np.inf)
    for t in range(tables):
        found = digits(y, band, t)
        best = np.maximum(best, sum(pointing(x, t, h)[np.arange(len(x)), found[:, h]] for h in range(band.hashes)))
    return best * band.reach / top


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List column -> rows of doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _by(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """The batch's rows by some number columns."""
    values = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
    for key in np.unique(values, axis=0):
        yield tuple(key.tolist()), batch.take(pa.array(np.flatnonzero((values == key).all(axis=1))))


def floors_of(x: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """The (k + 1)-th best score of each row among ``known`` vectors, less what rounding may add: no better class can score less."""
    if len(known) <= k:
        return np.full(len(x), -np.inf)
    near = x @ known.T
    worst = np.partition(near, len(known) - k - 1, axis=1)[:, len(known) - k - 1]
    return worst - _rounding(x, known)


def _rounding(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far a matrix product may be off, for each row of x."""
    return 4e-16 * x.shape[1] * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max()


def _true_neighbours(classes: DataFrame, asking: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """qid, cid of the k + 1 best classes for a bounded set of queries, by length of vector: ids and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for (dim,), part in _by(batch, "dim"):
                if dim in asking:
                    near, cids = asking[dim][1] @ _matrix(part.column("v"), dim).T, np.broadcast_to(part.column("cid").to_numpy(), (len(asking[dim][0]), part.num_rows))
                    if dim in held:
                        near, cids = np.hstack([held[dim][0], near]), np.hstack([held[dim][1], cids])
                    best = np.argsort(-near, axis=1, kind="stable")[:, : k + 1]
                    held[dim] = np.take_along_axis(near, best, 1), np.take_along_axis(cids, best, 1)
        for dim, (near, cids) in held.items():
            yield pa.RecordBatch.from_pydict({"qid": np.repeat(asking[dim][0], near.shape[1]), "cid": cids.ravel(), "score": near.ravel()})

    best = classes.select("cid", "v", "dim").mapInArrow(run, "qid long, cid long, score double")
    return best.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))).where(F.col("r") <= k + 1).select("qid", "cid")


_ENTRY = "cell long, asks boolean, cid long, lid long, floor double, v binary"


def _entries(batch: pa.RecordBatch, dim: int, dtype: str, cells: list[np.ndarray], asks: bool, floors: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each cell of each row of the batch."""
    at = pa.array(np.repeat(np.arange(batch.num_rows), [len(c) for c in cells]))
    rows = np.ascontiguousarray(_matrix(batch.column("v"), dim), dtype)
    vectors = pa.array([r.tobytes() for r in rows], pa.binary())
    floor = np.zeros(batch.num_rows) if floors is None else floors
    columns = [pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int64)), pa.array(np.full(len(at), asks)), batch.column("cid").take(at), batch.column("lid").take(at), pa.array(floor).take(at), vectors.take(at)]
    yield pa.RecordBatch.from_arrays(columns, names=["cell", "asks", "cid", "lid", "floor", "v"])


def _scored(entries: DataFrame, dtype: str, k: int) -> DataFrame:
    """qid, cid, lid and score from entries: of each cell the k + 1 best for each of its queries, and what ties with them, as far as they reach the floor."""
    size = np.dtype(dtype).itemsize
    out = pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("lid", pa.int64()), ("score", pa.float64())])

    def rows_of(batch: pa.RecordBatch, first: int, last: int) -> np.ndarray:
        column = batch.column("v").slice(first, last - first)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(column.buffers()[2], dtype, (offsets[-1] - offsets[0]) // size, offsets[0])
        return flat.astype(np.float64).reshape(last - first, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, known = None, [], None
        found: list[tuple[np.ndarray, ...]] = []
        scored: list[list[np.ndarray]] = []
        pairs = waiting = 0
        best, floor_ids, floor_at = [np.zeros(0, f.type.to_pandas_dtype()) for f in out], np.zeros(0, np.int64), np.zeros(0)

        def score() -> None:
            """Scores the pairs found, whose vectors needn't be held any longer."""
            nonlocal found, pairs, waiting
            for dim in {f[3].shape[1] for f in found}:
                qid, cid, lid, q, c = (np.concatenate(x) for x in zip(*(f for f in found if f[3].shape[1] == dim), strict=True))
                value = np.zeros(len(qid))
                for d in range(dim):  # in order of components, so that the sum doesn't hang on the block
                    value += q[:, d] * c[:, d]
                scored.append([qid, cid, lid, value])
                waiting += len(qid)
            found, pairs = [], 0

        def combine() -> None:
            """Keeps each query's k + 1 best different classes and raises its floor to the last of them."""
            nonlocal best, floor_ids, floor_at, scored, waiting
            qid, cid, lid, value = (np.concatenate(x) for x in zip(best, *scored, strict=True))
            order = np.lexsort((cid, lid, -value, qid))
            qid, cid, lid, value = (x[order] for x in (qid, cid, lid, value))
            fresh = np.ones(len(qid), bool)
            fresh[1:] = (qid[1:] != qid[:-1]) | (cid[1:] != cid[:-1])
            qid, cid, lid, value = (x[fresh] for x in (qid, cid, lid, value))
            starts = np.flatnonzero(np.concatenate(([True], qid[1:] != qid[:-1]))) if len(qid) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(qid)))
            rank = np.arange(len(qid)) - np.repeat(starts, sizes)
            full = sizes > k
            floor_ids, floor_at = qid[starts[full]], value[starts[full] + k]
            best = [x[rank <= k] for x in (qid, cid, lid, value)]
            scored, waiting = [], 0

        def sent() -> pa.RecordBatch:
            nonlocal best
            batch, best = pa.RecordBatch.from_arrays([pa.array(x) for x in best], schema=out), [x[:0] for x in best]
            return batch

        def raised(ids: np.ndarray, floors: np.ndarray) -> np.ndarray:
            """The floors of queries, or what this task knows to be better."""
            if not len(floor_ids):
                return floors
            at = np.minimum(np.searchsorted(floor_ids, ids), len(floor_ids) - 1)
            return np.where(floor_ids[at] == ids, np.maximum(floors, floor_at[at]), floors)

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "c", "q", "asks")]
            cids, lids, floors = (batch.column(c).to_numpy() for c in ("cid", "lid", "floor"))
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                key = tuple(x[first] for x in keys[:3])
                if key != group:
                    group, held, known = key, [], None
                if not keys[3][first]:  # sorted: a cell's vectors stand before its queries
                    held.append((cids[first:last], lids[first:last], rows_of(batch, first, last)))
                elif held:
                    if known is None:
                        known = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    ids, least, c = known
                    n = min(k + 1, len(c))
                    for at in range(first, last, TILE):
                        q = rows_of(batch, at, min(at + TILE, last))
                        near = q @ c.T
                        worst = np.partition(near, len(c) - n, axis=1)[:, len(c) - n]
                        floor = raised(cids[at : at + len(q)], floors[at : at + len(q)])
                        qi, ci = np.nonzero(near >= (np.maximum(worst, floor) - _rounding(q, c))[:, None])
                        for i in range(0, len(qi), SCORED_PAIRS):
                            x, y = qi[i : i + SCORED_PAIRS], ci[i : i + SCORED_PAIRS]
                            found.append((cids[at + x], ids[y], least[y], q[x], c[y]))
                            pairs += len(x)
                            if pairs >= SCORED_PAIRS:
                                score()
                                # as much again as is held, so that sorting stays in proportion to the pairs
                                if waiting >= max(2 * SCORED_PAIRS, len(best[0])):
                                    combine()
                                    if len(best[0]) > HELD_PAIRS:
                                        yield sent()
        score()
        combine()
        yield sent()

    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(tasks, "cell", "c", "q").sortWithinPartitions("cell", "c", "q", "asks")
    return dealt.mapInArrow(run, "qid long, cid long, lid long, score double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k + 1 best different classes of each query. dense_rank: a pair that several tables find counts once, and Spark drops the rest before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "lid", "cid")
    return pairs.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1).select("qid", "cid", "score").distinct()


def _dealt(entries: DataFrame, cells: DataFrame) -> DataFrame:
    """Entries with their blocks c and q of cells that are too great for one task; ``cells`` has the cell of each entry that doesn't ask."""
    parts = cells.groupBy("cell").count().where(F.col("count") > BLOCK_CANDIDATES)
    great = stored(parts.select("cell", F.ceil(F.col("count") / BLOCK_CANDIDATES).cast("int").alias("parts")), "great_cells")
    number = great.count()
    if not number:
        return entries.withColumns({"c": F.lit(0), "q": F.lit(0)})
    joined = entries.join(F.broadcast(great) if number <= BROADCAST_CELLS else great, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # as many blocks of queries as of vectors: every block of the one meets every block of the other
    own, every = F.array(F.pmod(F.xxhash64("cid"), "parts").cast("int")), F.sequence(F.lit(0), F.col("parts") - 1)
    asks = F.col("asks")
    return joined.select("*", F.explode(F.when(asks, every).otherwise(own)).alias("c")).select("*", F.explode(F.when(asks, own).otherwise(every)).alias("q")).drop("parts")


def _sampled(classes: DataFrame, where: Column, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector the ids and rows of n classes, those with the least hashes."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("cid", F.lit(5)), "cid")
    out: dict[int, tuple[list, list]] = {}
    for r in classes.where(where).select("cid", "v", "dim").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).collect():
        ids, rows = out.setdefault(r["dim"], ([], []))
        ids.append(r["cid"])
        rows.append(r["v"])
    return {d: (np.array(ids, np.int64), np.array(rows, np.float64)) for d, (ids, rows) in out.items()}


def _thresholds(classes: DataFrame, bands: dict[tuple[int, int], Band], asking: dict[int, tuple[np.ndarray, np.ndarray]], k: int, tables: int, recall: float) -> dict[int, float]:
    """By length of vector the weight that the share ``recall`` of the sampled queries' true neighbours reach."""
    pairs = stored(_true_neighbours(classes, asking, k), "true_neighbours")
    # SAMPLE_QUERIES times k + 1 pairs for each length at most
    vectors = {r["cid"]: (r["v"], r["dim"], r["band"]) for r in classes.join(F.broadcast(pairs.select("cid").distinct()), "cid").select("cid", "v", "dim", "band").collect()}
    grouped: dict[tuple[int, int], tuple[list, list]] = {}
    rows = {int(i): row for ids, found in asking.values() for i, row in zip(ids, found, strict=True)}
    for r in pairs.collect():
        if r["qid"] != r["cid"]:
            v, dim, band = vectors[r["cid"]]
            xs, ys = grouped.setdefault((dim, band), ([], []))
            xs.append(rows[r["qid"]])
            ys.append(v)
    out = {}
    for dim in asking:
        top = max(b.greatest for (d, _), b in bands.items() if d == dim)
        found = [weights_of(np.array(xs), np.array(ys, np.float64), bands[key], top, tables) for key, (xs, ys) in grouped.items() if key[0] == dim]
        weights = np.sort(np.concatenate([*found, np.zeros(0)]))
        out[dim] = float(weights[int((1 - recall) * len(weights))]) - 1e-12 if len(weights) else -np.inf
    return out


def nearest(df: DataFrame, every: int, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, recall: float | None = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by ``every`` its k nearest other rows.

    Nearness is the inner product in double precision, ties go to the smaller
    vec_id; a query gets all other rows if they are fewer than k. About the
    share ``recall`` of the true neighbours is found; with None every query goes
    through all rows and all are. Vectors of each length are searched by
    themselves. Rows with a null id, and vectors that are null, empty, zero, or
    that hold null or non-finite components take no part. Rows that repeat id
    and vector count once. An empty table gives an empty result.
    """
    spark = df.sparkSession
    v = F.col("v")
    kind = df.schema[vector_col].dataType
    dtype = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(fine)
    rows = stored(rows.select("vec_id", "v", F.struct(F.xxhash64("v").alias("a"), F.hash("v", F.lit(1)).alias("b")).alias("key")), "vectors")
    asked = F.col("vec_id") % every == 0
    # repeats go first; then Spark drops all but the first k + 1 ids of a class before the shuffle
    first = rows.select("vec_id", "key").distinct().withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = first.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = rows.groupBy("key").agg(F.first("v").alias("v"), F.sum(asked.cast("long")).alias("n"))
    top = F.array_max(F.transform("v", F.abs))
    joint = ids.join(vectors, "key").withColumn("top", top).withColumn("dim", F.size("v"))
    # by the greatest component, so that squares neither overflow nor vanish
    norm = F.col("top") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("top")) * (x / F.col("top"))))
    joint = joint.withColumn("norm", norm).withColumn("band", F.floor(F.log2("norm") * BANDS + 0.5).cast("int"))
    classes = stored(joint.select("*", F.monotonically_increasing_id().alias("cid"), F.element_at("ids", 1).alias("lid"), (F.col("n") > 0).alias("asked")), "classes")
    # a row for each length and band of norms
    found = sorted(classes.groupBy("dim", "band").agg(F.max("norm").alias("greatest"), F.count("*").alias("held")).collect(), key=lambda r: (r["dim"], r["band"]))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    bands = {(r["dim"], r["band"]): band_of(i, r["dim"], r["greatest"], r["held"]) for i, r in enumerate(found)}
    of_dim = {d: [b for b in bands.values() if b.dim == d] for d in sorted({d for d, _ in bands})}
    held = {d: sum(b.held for b in bs) for d, bs in of_dim.items()}
    columns = ["cid", "lid", "v", "dim", "band", "asked"]
    if recall is None:
        answers, short = None, classes.where("asked").select("cid")
    else:
        known = {d: f for d, (_, f) in _sampled(classes, F.lit(True), FLOOR_ROWS).items()}
        limits = _thresholds(classes, bands, _sampled(classes, F.col("asked"), SAMPLE_QUERIES), k, tables, recall)

        def probing(part: pa.RecordBatch, dim: int) -> tuple[list[np.ndarray], np.ndarray]:
            x = _matrix(part.column("v"), dim)
            floors = floors_of(x, known[dim], k)
            return probes_of(x, floors, of_dim[dim], limits[dim], tables), floors

        def placing(part: pa.RecordBatch, band: Band) -> list[np.ndarray]:
            x = _matrix(part.column("v"), band.dim)
            return [*np.stack([coded(digits(x, band, t), band, t) for t in range(tables if band.hashes else 1)], axis=1)]

        def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, CODED_ROWS):
                    batch = whole.slice(at, CODED_ROWS)
                    for key, part in _by(batch, "dim", "band"):
                        yield from _entries(part, key[0], dtype, placing(part, bands[key]), False)
                    asking = batch.filter(batch.column("asked"))
                    for (dim,), part in _by(asking, "dim") if asking.num_rows else ():
                        probes, floors = probing(part, dim)
                        yield from _entries(part, dim, dtype, probes, True, floors)

        def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, CODED_ROWS):
                    for key, part in _by(whole.slice(at, CODED_ROWS), "dim", "band"):
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(placing(part, bands[key])))], names=["cell"])

        coming = classes.select(*columns)
        dealt = _dealt(coming.mapInArrow(entries_of, _ENTRY), coming.mapInArrow(cells_of, "cell long"))
        answers = stored(_best(_scored(dealt, dtype, k), k), "answers")
        # fewer than there could be: those queries go on through all rows
        wanted = F.create_map(*(x for d, n in held.items() for x in (F.lit(d), F.lit(min(n, k + 1)))))
        enough = answers.groupBy(F.col("qid").alias("cid")).agg(F.count("*").alias("got"))
        short = classes.where("asked").select("cid", "dim").join(enough, "cid", "left").where(F.coalesce("got", F.lit(0)) < wanted[F.col("dim")]).select("cid")
    short = stored(short, "short")
    if short.count():
        asking_dims = [r["dim"] for r in classes.join(short, "cid", "left_semi").select("dim").distinct().collect()]
        blocks = {d: -(-held[d] // BLOCK_CANDIDATES) for d in asking_dims}
        start = dict(zip(blocks, np.cumsum([0, *blocks.values()])[:-1].tolist(), strict=True))

        def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, CODED_ROWS):
                    for (dim,), part in _by(whole.slice(at, CODED_ROWS), "dim"):
                        block = part.column("cid").to_numpy() % blocks[dim] + start[dim]
                        yield from _entries(part, dim, dtype, [*block[:, None]], False)
                        asking = part.filter(part.column("asked"))
                        if asking.num_rows:
                            yield from _entries(asking, dim, dtype, [np.arange(blocks[dim]) + start[dim]] * asking.num_rows, True, np.full(asking.num_rows, -np.inf))

        marked = classes.where(F.col("dim").isin(asking_dims)).drop("asked").join(short.withColumn("asked", F.lit(True)), "cid", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        parts = F.expr(f"CAST(ceil(cell * 0 + {short.count()} / {BLOCK_QUERIES}) AS INT)")
        entries = marked.select(*columns).mapInArrow(in_blocks, _ENTRY).withColumn("c", F.lit(0))
        split = entries.select("*", F.explode(F.when(F.col("asks"), F.array(F.pmod(F.xxhash64("cid"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))).alias("q"))
        further = _best(_scored(split, dtype, k), k)
        answers = further if answers is None else answers.join(short, F.col("qid") == short["cid"], "left_anti").unionByName(further)
    # at most (k + 1) classes of k + 1 ids for a query class
    entry = F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id"))))
    lists = answers.join(classes.select("cid", "ids"), "cid").select("qid", entry.alias("e")).groupBy("qid").agg(F.slice(F.sort_array(F.collect_list("e")), 1, k + 1).alias("near"))
    by_key = classes.where("asked").select(F.col("cid").alias("qid"), "key").join(lists, "qid").select("key", "near")
    own = rows.where(asked).select("vec_id", "key").distinct()
    listed = spread_join(own, by_key, "key", classes.where("asked").select("key", "n")).select(F.col("vec_id").alias("query_id"), F.posexplode(F.expr(f"slice(filter(near, e -> e.id != vec_id), 1, {k})")).alias("at", "e"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.s")).alias("score"))
