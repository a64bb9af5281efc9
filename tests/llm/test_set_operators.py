"""Operators that look at many rows together, against brute force."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenrow.llm import neighbours, packing, queries, sharding, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = [w for w in text.encode().lower().split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, ids):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(values))]


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_simhash(table, request):
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text").collect()
    values = [brute_fingerprint(r["text"] or "") for r in rows]
    want = sorted(((r["doc_id"], f"{v:016x}", c) for r, v, c in zip(rows, values, brute_components(values, [r["doc_id"] for r in rows]), strict=True)), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str) == want


@pytest.mark.parametrize(("pairs_up_to", "held"), [(48, 65_536), (0, 65_536), (48, 2)])
def test_links_lose_nothing(spark, monkeypatch, pairs_up_to, held):
    """Dense groups of values near each other; with hubs alone, and with buckets that are sent on before they end, as well."""
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs_up_to)
    monkeypatch.setattr(simhash, "HELD_ROWS", held)
    rng = np.random.default_rng(3)
    values = []
    for _ in range(30):
        v = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + int(rng.integers(0, 2))
        for _ in range(12):
            values.append(v)
            for _ in range(int(rng.integers(1, 4))):
                v ^= 1 << int(rng.integers(0, 64))
    values = [*{*values}]
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups = brute_components(values, list(range(len(values))))
    mine = {}
    for s, g in zip(signed, groups, strict=True):
        mine.setdefault(roots.get(s, s), set()).add(g)
    assert all(len(g) == 1 for g in mine.values()) and len(mine) == len({*groups})


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_sharding(table, request):
    df = request.getfixturevalue(table)
    rows = sharding.kd_shards(df).collect()
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == want
    slots, sizes = {}, {}
    for r in rows:
        assert 0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if table == "docs":
        mean, largest = sum(sizes.values()) / 24, max(r["size"] for r in rows)
        assert len(sizes) == 24 and max(abs(s - mean) for s in sizes.values()) <= 2 * largest


def test_sharding_splits_rows_that_are_alike(spark):
    """500 rows of one document beside a thousand others: no shard is off the mean by more than its slack and a row or two."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hot = docs.where("doc_id = 7").crossJoin(spark.range(500).select()).select(*docs.columns)
    rows = sharding.kd_shards(docs.unionByName(hot)).collect()
    sizes, slots = [0] * 24, [[] for _ in range(24)]
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean, largest = sum(sizes) / 24, max(r["size"] for r in rows)
    assert len(rows) == 1500 and max(abs(s - mean) for s in sizes) <= largest + 5 * sharding.WHOLE_GROUP * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_sharding_keeps_groups_of_equal_texts(spark):
    """Near equal shards, and no more cut groups than cuts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sharding.kd_shards(docs).collect()
    sizes = [0] * 24
    for r in rows:
        sizes[r["shard"]] += r["size"]
    mean, largest = sum(sizes) / 24, max(r["size"] for r in rows)
    assert max(abs(s - mean) for s in sizes) <= largest + 5 * sharding.WHOLE_GROUP * mean
    # groups of equal texts that are cut: one for each of the 23 cuts at most, and only great ones
    shard = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in rows}
    groups = {}
    for d in docs.collect():
        text = d["text"] or ""
        groups.setdefault(text, []).append(shard[d["doc_id"], zlib.crc32(text.encode())])
    cut = [t for t, g in groups.items() if len({*g}) > 1]
    assert len(cut) <= 23 and all(len(groups[t]) * (len(t.encode()) + 8) > sharding.WHOLE_GROUP * mean for t in cut)


def test_sharding_takes_the_widest_dimension(spark):
    """All of one length and source: only the language can be cut, and it is."""
    df = spark.createDataFrame([(i, f"{i:05d}", "abcdefgh"[i % 8], "s") for i in range(1600)], "doc_id long, text string, lang string, source string")
    langs = {}
    for r in sharding.kd_shards(df, 8).join(df.select("doc_id", "lang"), "doc_id").collect():
        langs.setdefault(r["shard"], set()).add(r["lang"])
    assert [len(langs[s]) for s in range(8)] == [1] * 8


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_packing(table, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(table)
    path = public_tokenizers.path(queries.WORD_VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = [r.asDict() for r in packing.pack(df, path).collect()]
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for d in df.dropDuplicates(["doc_id"]).collect():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[d["doc_id"]], key=lambda r: r["start"])
        copies = df.where(df.doc_id.eqNullSafe(d["doc_id"])).count()
        assert sum(r["length"] for r in own) == copies * len(ids)
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids) and len(part) == r["length"]
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    tokens = sum(r["length"] for r in rows)
    assert len(windows) <= max(1, math.ceil(tokens / packing.WINDOW * 1.05) + 1)


def test_words_are_encoded_as_by_the_library():
    import random

    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path(queries.WORD_VOCABULARY), random.Random(9)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    parts = [*"abcAÉé Σςσ.,.,  \n\t'sT1!-_漢😀 ́xİ\x1c\x85²", "<|endoftext|>", "the", "'ll", "%%%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, got, want in zip(texts, packing.token_bytes(texts, path), tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(text)


def test_differencing_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 800).tolist()
    loads = np.bincount(packing.karmarkar_karp(sizes, 60), sizes, 60)
    assert loads.sum() == sum(sizes) and loads.max() - loads.min() < 120
    assert np.bincount(packing.packed(sizes, 4096), sizes).max() <= 4096


def test_warc(spark):
    big, small = "é" * 700, "short"
    pages = spark.createDataFrame([(1, "http://a/\n1", big, 0), (2, "http://a/2", big, 0), (3, None, big, 0), (3, None, big, 0), (4, "http://b", small, 0), (5, "http://b", small, 0), (None, "http://c", big, 0), (6, "http://d", None, 0), (7, "http://e", "x" * 999, 0), (8, "http://e", "x" * 999, 0)], "page_id long, url string, html string, digest int")
    rows = {}
    for r in warc.archived_pages(pages).collect():
        rows.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, rows.values())) == 10
    for i, kind, refers, data in ((1, "revisit", 3, big), (2, "revisit", 3, big), (3, "response", None, big), (4, "response", None, small), (5, "response", None, small), (None, "revisit", 3, big), (6, "response", None, ""), (7, "response", None, "x" * 999)):
        for r in rows[i]:
            assert (r["record_type"], r["refers_to"], r["payload_bytes"]) == (kind, refers, len(data.encode())), i
            assert r["payload_digest"] == hashlib.sha1(data.encode()).hexdigest()
    nested = warc.transactions(warc.read_records(warc.write_archives(warc.with_originals(pages)))).collect()
    assert len(nested) == 10 and all(r["request"] and r["metadata"] for r in nested)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_warc_with_hot_payloads(spark):
    """A third of all pages with one payload, a third without any; page ids that aren't numbers."""
    import zlib as z

    rows = [(f"p {i:04d}/é", f"http://h/{i}", "x" * 1500 if i % 3 == 0 else None if i % 3 == 1 else f"{i} " * 400) for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r["page_id"]: r for r in warc.archived_pages(pages).collect()}
    assert len(got) == 900
    for i, (page, url, html) in enumerate(rows):
        last = i % 3 == 0 and i != 897
        assert (got[page]["record_type"], got[page]["refers_to"], got[page]["target_uri"]) == ("revisit" if last else "response", rows[897][0] if last else None, url)
        assert got[page]["payload_digest"] == hashlib.sha1((html or "").encode()).hexdigest()
    # a standard reader takes the archive as one gzip file of several members
    import gzip

    blobs = [bytes(r["archive"]) for r in warc.write_archives(warc.with_originals(pages)).collect()]
    assert sum(gzip.decompress(b).count(b"WARC/1.1\r\n") for b in blobs) == 2700 and all(len([*warc.members(b)]) % 3 == 0 for b in blobs)
    assert z.decompressobj(31).decompress(blobs[0]).startswith(b"WARC/1.1\r\n")


def test_toxicity(spark, docs, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.toxicity(big, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    hit = sum(r["toxic"] == 1 and r["predicted"] == 1 for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.8 and hit / max(1, sum(r["predicted"] for r in rows)) > 0.9
    own = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert len(own) == odd.count() and all(r["score"] < 1e-9 and r["predicted"] == 0 for r in own)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in own if r["doc_id"] is not None)
    assert toxicity.toxicity(none, labels).count() == 0


def test_pairs_weigh_beyond_their_terms():
    """Label 1 only where both terms stand: no sum of the two alone can tell."""
    rng = np.random.default_rng(2)
    a, b = rng.random(2000) < 0.5, rng.random(2000) < 0.5
    found = [np.flatnonzero([x, y]) for x, y in zip(a, b, strict=True)]
    label = (a ^ b).astype(int)
    bias, w, v = toxicity.fit(found, label, 2)
    z = np.array([bias + w[f].sum() + (v[0] @ v[1] if len(f) == 2 else 0) for f in found])
    assert ((z > 0) == label).mean() > 0.99


def test_machine_scores_as_a_sum_over_pairs(spark):
    """The forward pass in plain Python: bias, weights, and the product of factors of every pair of terms."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    assert len(m.weights) > 5
    rng = np.random.default_rng(4)
    m.factors[:-1] = rng.normal(0, 0.4, m.factors[:-1].shape)
    texts = [r["text"] or "" for r in docs.limit(40).collect()] + ["", "no such words", "the " * 50]
    for text, got in zip(texts, m.score([toxicity.buckets(t) for t in texts]), strict=True):
        rows = [int(m.place[b]) for b in toxicity.buckets(text) if m.place[b] < len(m.weights) - 1]
        z = m.bias + sum(float(m.weights[i]) for i in rows)
        for n, i in enumerate(rows):
            for j in rows[n + 1 :]:
                z += sum(float(x) * float(y) for x, y in zip(m.factors[i], m.factors[j], strict=True))
        assert got == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-9)


def test_pairs_gain_on_held_out_rows(spark):
    """Toxic where an insult meets a group's mention; both also stand alone in clean texts. Trained by train(), screen included."""
    rng = np.random.default_rng(11)
    filler = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    rows = []
    for i in range(4000):
        insult, group = rng.random(2) < 0.5
        text = [*rng.choice(filler, 12), *(["vermin"] if insult else []), *(["villagers"] if group else [])]
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(insult and group)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(df.select("doc_id", "text"), df.where("doc_id < 2000").select("doc_id", "toxic"))
    found, y = [toxicity.buckets(t) for _, t, _ in rows[2000:]], np.array([t for _, _, t in rows[2000:]])
    loss = lambda p: -np.mean(y * np.log(np.clip(p, 1e-9, 1)) + (1 - y) * np.log(np.clip(1 - p, 1e-9, 1)))
    p = m.score(found)
    # without factors: a new bias and weights of the same buckets, fitted alone
    place = [m.place[b][m.place[b] < len(m.weights) - 1] for b in (toxicity.buckets(t) for _, t, _ in rows[:2000])]
    rounds = toxicity.FACTORS
    try:
        toxicity.FACTORS = 1
        bias, w, _ = toxicity.fit([np.asarray(x) for x in place], np.array([t for _, _, t in rows[:2000]]), len(m.weights) - 1, seed=0)
    finally:
        toxicity.FACTORS = rounds
    alone = toxicity.Machine(m.place, bias, np.append(w, 0.0), np.zeros((len(m.weights), 1)))
    assert ((p >= 0.3) == y).mean() > 0.99 and loss(p) < 0.5 * loss(alone.score(found))


def test_terms_that_only_a_pair_tells(spark):
    """One insult is toxic with a group's mention, another without: the mention says nothing by itself, and the machine learns it all the same."""
    rng = np.random.default_rng(12)
    filler = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    rows = []
    for i in range(6000):
        one, two, group = rng.random(3) < 0.5
        text = [*rng.choice(filler, 10), *(["vermin"] if one else []), *(["scumbag"] if two else []), *(["villagers"] if group else [])]
        rows.append((i, " ".join(text), int(one if group else two)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(df.select("doc_id", "text"), df.where("doc_id < 4000").select("doc_id", "toxic"))
    assert m.place[toxicity.buckets("villagers")].max() < len(m.weights) - 1
    p = m.score([toxicity.buckets(t) for _, t, _ in rows[4000:]])
    assert ((p >= 0.5) == [bool(t) for _, _, t in rows[4000:]]).mean() > 0.97


def test_toxicity_of_odd_rows_with_a_fitted_model(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels.where(~toxicity.held_out()))
    rows = toxicity.score(odd, m).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[3] == by[4] and len(by[6]) == 1 and None in by
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.without_toxic(odd.limit(0), labels).count() == 0
    # labels of one class
    own = odd.where("doc_id IS NOT NULL").select("doc_id").distinct()
    for label in (0, 1):
        one = toxicity.toxicity(odd, own.select("doc_id", F.lit(label).alias("toxic"))).collect()
        assert len(one) == odd.count() and {r["predicted"] for r in one} == {label}


def brute_neighbours(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    out = {}
    for q in good:
        if q % every == 0:
            ranked = sorted((-sum(float(x) * float(y) for x, y in zip(good[q], good[i], strict=True)), i) for i in good if i != q)
            out[q] = [i for _, i in ranked[:k]]
    return out


def lists_of(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def recall_of(got, rows, every, k=20):
    """The share of the true neighbours that were found; scores are exact, and order and ties as asked."""
    good = {i: np.array(v, float) for i, v in rows}
    want, hits = brute_neighbours(rows, every, k), 0
    assert {*got} == {q for q in want if want[q]}
    for q, found in got.items():
        for i, score in found:
            exact = 0.0
            for x, y in zip(good[q].tolist(), good[i].tolist(), strict=True):
                exact += x * y
            assert score == exact and i != q
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len({i for i, _ in found}) == len(found) == len(want[q])
        hits += len({i for i, _ in found} & {*want[q]})
    return hits / sum(map(len, want.values()))


def odd_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = rows[:200] + [(1000 + i, rows[0][1]) for i in range(60)] + [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, [None] * 64), (2020, [x * 3 for x in rows[5][1]]), (None, rows[3][1]), rows[7]]
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")


def test_neighbours(spark):
    """Nulls, zeros, repeats and ties: all found if all rows are asked for, and at least 0.9 by hashing."""
    df = odd_vectors(spark)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = lists_of(neighbours.nearest(df, 20, recall=None))
    assert {q: [i for i, _ in f] for q, f in got.items()} == brute_neighbours(rows, 20, 20)
    fine = [(i, v) for i, v in rows if i is not None and v and None not in v and not any(math.isnan(x) for x in v) and any(v)]
    assert recall_of(lists_of(neighbours.nearest(df, 20)), fine, 20) >= 0.9
    assert neighbours.nearest(df.limit(0), 20).count() == 0
    assert neighbours.nearest(df.where("vec_id = 20"), 20).count() == 0
    # fewer than k others: all of them
    few = df.where("vec_id < 12 OR vec_id = 20")
    assert recall_of(lists_of(neighbours.nearest(few, 20)), [(i, v) for i, v in rows if i is not None and (i < 12 or i == 20)][:13], 20) == 1.0


def test_neighbours_of_the_test_vectors(spark):
    """The registered query on 2,000 vectors."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    assert recall_of(lists_of(queries.QUERIES["op10_neighbours"](spark, "/root/testdata/sf0.1")), fine, 20) >= 0.9


@pytest.mark.parametrize("spread", ["equal", "outlier", "lognormal", "wide", "clustered"])
def test_neighbours_of_unequal_norms(spark, spread):
    """So many vectors that cells are really left out; norms that one scale for all would hide in the added component."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if spread == "outlier":
        x[7] *= 3
    elif spread == "clustered":
        x = x[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 32)) * 0.1
    elif spread != "equal":
        x *= np.exp(rng.normal(size=(3000, 1)) * {"lognormal": 0.5, "wide": 40}[spread])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scores = x[::50] @ x.T
    scores[np.arange(60), np.arange(0, 3000, 50)] = -np.inf
    want = {50 * q: {*np.argsort(-scores[q], kind="stable")[:20].tolist()} for q in range(60)}
    for recall, least in ((neighbours.RECALL, 0.9), (None, 1.0)):
        got = lists_of(neighbours.nearest(df, 50, recall=recall))
        assert all(len(f) == 20 for f in got.values()) and sum(len({i for i, _ in got[q]} & want[q]) for q in want) / 1200 >= least


def test_neighbours_in_great_cells(spark, monkeypatch):
    """Cells and queries over many blocks find what whole ones do."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = [lists_of(neighbours.nearest(df, 5, recall=r)) for r in (neighbours.RECALL, None)]
    monkeypatch.setattr(neighbours, "BLOCK_CANDIDATES", 16)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 8)
    assert [lists_of(neighbours.nearest(df, 5, recall=r)) for r in (neighbours.RECALL, None)] == want


def test_probes_reach_every_cell_of_their_weight():
    """Enumeration against all cells of a band of three rotations."""
    rng = np.random.default_rng(3)
    along = [rng.normal(size=6) for _ in range(3)]
    every = {(i * 6 + j) * 6 + k: along[0][i] + along[1][j] + along[2][k] for i in range(6) for j in range(6) for k in range(6)}
    for least in (-9.0, 0.5, 2.0, 9.0):
        assert sorted(neighbours.reaching(along, least).tolist()) == sorted(c for c, w in every.items() if w >= least)


def test_cells_follow_from_the_bands_size():
    for n in (1, 64, 500, 5000, 50_000, 5_000_000, 500_000_000):
        b = neighbours.band_of(0, 64, 1.0, n)
        cells = (2 * b.axes) ** b.hashes
        assert n <= 64 and cells == 1 or 0.25 <= n / cells / neighbours.CELL_ROWS <= 4


def test_neighbours_of_several_lengths(spark):
    """A stray longer vector takes no other away; each length is searched by itself."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate([8] * 120 + [5] * 90 + [9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {q: [i for i, _ in f] for q, f in lists_of(neighbours.nearest(df, 10, recall=None)).items()}
    assert got == brute_neighbours(rows[:120], 10, 20) | brute_neighbours(rows[120:210], 10, 20)
    hashed = lists_of(neighbours.nearest(df, 10))
    assert {*hashed} == {*got} and sum(len({i for i, _ in hashed[q]} & {*got[q]}) for q in got) / sum(map(len, got.values())) >= 0.9


def test_empty_sets(none):
    path = public_tokenizers.path(queries.WORD_VOCABULARY)
    for df in (simhash.near_duplicates(none), sharding.kd_shards(none), packing.pack(none, path)):
        assert df.count() == 0
