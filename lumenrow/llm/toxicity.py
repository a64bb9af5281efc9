"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its lower-cased words and the words' beginnings, each hashed
into a bucket and counted once. From labelled rows the buckets that tell most
about the label are chosen, by themselves or beside one that does, and a
factorization machine is trained on them: a
weight for each bucket and a short vector whose inner products weigh pairs, so
that two terms together can count for more (or less) than each alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_and_text, stored, texts_of

BUCKETS = 1 << 18
#: Letters of a word's beginning that are a term too.
STEM = 5
#: Labelled rows that the model is fitted on at most; those with the least hash of their doc_id.
SAMPLE_ROWS = 20_000
#: Buckets that the machine has weights for at most.
CHOSEN = 4096
#: Least different labelled texts that must have a bucket's term, and by how many standard errors its share of toxic ones must stand out.
LEAST_ROWS, LEAST_APART = 4, 4.5
#: The buckets that stand out most, among whose texts further ones are looked for, and by how many standard errors those must stand out there.
PARTNERS, PAIR_APART = 16, 6.0
FACTORS, ROUNDS, RATE, DECAY = 6, 200, 0.08, 5e-5
TOXIC_FROM = 0.3
#: Distinct words a Python worker remembers.
CACHE_WORDS = 500_000
_WORD = re.compile(r"[^\W\d_]+")


class _Terms(dict):
    """word -> its buckets."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        made = (zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % BUCKETS, zlib.crc32(b"s" + word[:STEM].encode("utf-8", "surrogatepass")) % BUCKETS)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = made
        return made


_TERMS = _Terms()


def buckets(text: str) -> np.ndarray:
    """The sorted distinct buckets of a whole text's terms."""
    words = {*_WORD.findall(text.lower())}
    return np.array(sorted({b for w in words for b in _TERMS[w]}), np.int32)


@dataclass
class Machine:
    """``place[bucket]`` is a row of the weights or, for buckets that aren't chosen, the last row, which is zero."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        """The probability of each text, from its buckets."""
        out = np.full(len(found), self.bias)
        for i, b in enumerate(found):
            at = self.place[b]
            at = at[at < len(self.weights) - 1]
            if at.size:
                v = self.factors[at]
                out[i] += self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(found: list[np.ndarray], labels: np.ndarray, n: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors for texts given by indexes 0 to n - 1, by Adam on the logistic loss with weight decay."""
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    cols = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    by_col = np.argsort(cols, kind="stable")
    params = [np.zeros(1), np.zeros(n), np.random.default_rng(seed).normal(0, 0.02, (n, FACTORS))]
    y = labels.astype(float)
    params[0][0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    per_row = lambda x: np.stack([np.bincount(rows, x[:, k], len(found)) for k in range(x.shape[1])], axis=1)
    per_col = lambda x: np.stack([np.bincount(cols[by_col], x[by_col, k], n) for k in range(x.shape[1])], axis=1)
    for step in range(1, ROUNDS + 1):
        bias, w, v = params
        vc = v[cols]
        sums = per_row(vc)
        z = bias[0] + np.bincount(rows, w[cols], len(found)) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(rows, (vc**2).sum(axis=1), len(found)))
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(found)
        gc = g[rows]
        grads = [np.array([g.sum()]), np.bincount(cols, gc, n) + DECAY * w, per_col(gc[:, None] * (sums[rows] - vc)) + DECAY * v]
        for p, d, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def _partners(found: DataFrame, shares: dict[int, float], known: list[int], most: int) -> list[int]:
    """Buckets that say little by themselves but much beside one of ``shares`` (bucket: its texts' share of toxic ones), ``most`` at most.

    Within a bucket's texts a further one stands out as it would among all
    texts; where nearly all of them agree there is nothing to tell apart.
    """
    even = {b: s for b, s in shares.items() if 0 < s < 1}
    if not even or most <= 0:
        return []
    # PARTNERS pairs of numbers at most
    share = F.create_map(*(F.lit(x) for pair in even.items() for x in pair))
    beside = found.select("label", "buckets", F.explode(F.array_intersect("buckets", F.lit(list(even)))).alias("a")).select("label", "a", F.explode("buckets").alias("b"))
    counts = beside.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("label").alias("t")).withColumn("share", share[F.col("a")])
    spread = F.col("n") * F.col("share") * (1 - F.col("share"))
    apart = F.abs(F.col("t") - F.col("n") * F.col("share")) / F.sqrt(spread)
    fresh = counts.where((spread >= 1) & (F.col("n") >= LEAST_ROWS) & ~F.col("b").isin(known)).withColumn("apart", apart).where(F.col("apart") >= PAIR_APART)
    return [r["b"] for r in fresh.groupBy("b").agg(F.max("apart").alias("apart")).orderBy(F.desc("apart"), "b").limit(most).collect()]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine fitted on a bounded sample of labelled rows, those with the least hash of their doc_id.

    Rows with a null doc_id or label are left out; a doc_id labelled twice has
    the greater label. Without any labelled row every score is 0. The cluster
    counts terms by label; the driver gets the chosen buckets and, for at most
    ``sample_rows`` texts, which of them they have.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # broadcast: sample_rows pairs of numbers at most
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield pa.RecordBatch.from_pydict({"label": batch.column(batch.schema.get_field_index("label")), "buckets": pa.array([buckets(t) for t in texts_of(batch)], pa.list_(pa.int32()))})

    found = stored(rows.select("text", F.col("label").cast("int").alias("label")).mapInArrow(terms, "label int, buckets array<int>").dropDuplicates(), "terms")
    n, toxic = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return Machine(np.zeros(BUCKETS, np.int64), -40.0, np.zeros(1), np.zeros((1, FACTORS)))
    counts = found.select("label", F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.sum("label").alias("t")).where(F.col("n") >= LEAST_ROWS)
    # how far the number of toxic texts with the term is from what their share of all would make it, in standard errors
    share = toxic / n
    apart = F.abs(F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(max(share * (1 - share), 1e-9)))
    telling = counts.withColumn("apart", apart).where(F.col("apart") >= LEAST_APART).orderBy(F.desc("apart"), "b").limit(CHOSEN).collect()
    best = [r["b"] for r in telling]
    best += _partners(found, {r["b"]: r["t"] / r["n"] for r in telling[:PARTNERS]}, best, CHOSEN - len(best))
    place = np.full(BUCKETS, len(best), np.int64)
    place[best] = np.arange(len(best))
    chosen = found.select("label", F.array_intersect("buckets", F.lit(best) if best else F.array().cast("array<int>")).alias("buckets"), F.xxhash64("label", "buckets").alias("o")).orderBy("o").toPandas()
    texts = [place[np.asarray(b, np.int64)] for b in chosen["buckets"]]
    bias, w, v = fit(texts, chosen["label"].to_numpy(), len(best))
    return Machine(place, bias, np.append(w, 0.0), np.vstack([v, np.zeros((1, FACTORS))]))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row. A null or empty text has the score of no term; repeated rows and null doc_ids stay."""
    rows = id_and_text(docs, id_col, text_col)
    # a few hundred thousand numbers, whatever the data's size
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score([buckets(t) for t in texts_of(batch)]), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {id_type}, score double")


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from TOXIC_FROM on) for every row of docs.

    Only labels of rows that aren't held out are learned from. A null doc_id is
    not held out. A null or empty text has the score of no term. Repeated rows
    have equal scores and stay; labels all of one class make every score follow
    that class; an empty table gives an empty result.
    """
    machine = train(docs, labels.where(~held_out()), sample_rows)
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs whose score is below TOXIC_FROM, with all their columns.

    A null or empty text has the score of no term; repeated rows and rows with a
    null doc_id are judged like any other. Without labels every row stays; an
    empty table gives an empty result.
    """
    machine = train(docs, labels.where(~held_out()), sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield batch.filter(pa.array(shared.value.score([buckets(t) for t in texts_of(batch)]) < TOXIC_FROM))

    return docs.mapInArrow(run, docs.schema)
