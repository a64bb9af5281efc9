"""Each stage on its own input, and the pipeline as a whole."""

import corpus_pipeline
from lumenrow.llm import secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "near_duplicates", "secrets", "packing"]
    kept = stages["toxicity"](spark, docs, SF)
    machine = toxicity.train(docs, labels.where(~toxicity.held_out()))
    want = {r["doc_id"] for r in docs.collect() if machine.score([toxicity.buckets(r["text"])])[0] < toxicity.TOXIC_FROM}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    alone = stages["near_duplicates"](spark, docs, SF)
    groups = simhash.near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted({r["component_id"] for r in groups}) and alone.columns == docs.columns
    clean = {r["doc_id"]: r for r in stages["secrets"](spark, docs, SF).collect()}
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(docs).collect()}
    for r in docs.collect():
        if not spans[r["doc_id"]]:
            assert clean[r["doc_id"]] == r
        else:
            assert "[SECRET]" in clean[r["doc_id"]]["text"] and clean[r["doc_id"]]["n_chars"] == len(clean[r["doc_id"]]["text"])


def test_odd_rows_through_near_duplicates(spark, odd):
    kept = corpus_pipeline.near_duplicates(spark, odd, SF).collect()
    # 3 and 4 are empty and link; the repeated row stays once; the null id stays
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 1, 3, 5, 6, 7, 8]
    assert corpus_pipeline.near_duplicates(spark, odd.limit(0), SF).count() == 0


def test_odd_rows_through_the_other_stages(spark, odd):
    """Nulls, repeats and columns with the stages' own names; every row that isn't toxic stays, texts without secrets as they are."""
    clash = odd.selectExpr("*", "1 AS key_id", "'x' AS key_hash", "2 AS lr_text", "3 AS salt_")
    kept = corpus_pipeline.without_toxic(spark, clash, SF)
    assert kept.columns == clash.columns and kept.count() == clash.count()
    alone = corpus_pipeline.near_duplicates(spark, clash, SF)
    assert alone.columns == clash.columns and alone.count() == 7 and {r["key_hash"] for r in alone.collect()} == {"x"}
    clean = corpus_pipeline.without_secrets(spark, clash, SF).collect()
    before = {(r["doc_id"], r["text"]) for r in clash.collect()}
    assert len(clean) == clash.count() and sum("[SECRET]" in (r["text"] or "") for r in clean) == 5  # a run of one hex letter is a hex span too
    assert all(r["lr_text"] == 2 and ((r["doc_id"], r["text"]) in before or "[SECRET]" in r["text"]) for r in clean)
    assert {r["doc_id"] for r in corpus_pipeline.packed(spark, clash, SF).collect()} == {r["doc_id"] for r in clash.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, clash.limit(0), SF).count() == 0, name


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in rows}
    assert ids and all(r["offset"] + r["length"] <= 4096 for r in rows)
    for d in ids:
        own = [r for r in rows if r["doc_id"] == d]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]
