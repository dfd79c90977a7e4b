"""The pipeline stage by stage against brute force, and its queries in the entry module."""

import hashlib

import pytest

import corpus_pipeline
from graphloom.llm import line_dedup, minhash, queries
from test_operators import SF, brute_documents, brute_rules, check_repeats, low_words

P = pytest.importorskip("public_tokenizers")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        seen.append(out)
        docs = out
    start = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ruled = {r.doc_id for r in start if (f := brute_rules(r.text))[0] >= 10 and 100 * f[4] <= 20 * f[0]}
    assert {r.doc_id for r in seen[0].collect()} == ruled  # no host fails here
    first = {i for i, _, _, kept in brute_documents([(r.doc_id, r.text) for r in seen[0].collect()]) if kept}
    assert {r.doc_id for r in seen[1].collect()} == first
    repeated, caught = check_repeats(spark.createDataFrame([(r.doc_id, r.text, r.n_chars) for r in seen[1].collect()], "doc_id long, text string, n_chars long"))
    assert caught >= 0.8 * repeated  # few passages are left here, and the end of each keeps up to one cut's distance
    before = {r.doc_id: r.text for r in seen[1].collect()}
    after = {r.doc_id: r.text for r in seen[2].collect()}
    assert after.keys() == before.keys() and all(r.n_chars == len(r.text) for r in seen[2].collect())
    gone = {i: len(low_words(before[i])) - len(low_words(t)) for i, t in after.items()}
    removed = {r.doc_id: r._dedup_removed_words for r in line_dedup.remove_repeats(seen[1]).collect()}
    assert gone == removed
    assert {r.doc_id for r in seen[3].collect()} == first
    text = {r.doc_id: r.text for r in seen[2].collect()}
    for r in seen[4].collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert seen[4].count() == seen[3].count()


def test_registered():
    entry = pytest.importorskip("__spark_entry__")
    found = entry.queries()
    assert set(queries.queries()) <= set(found) and "pipeline" in found


def test_empty_and_clashing(spark):
    """Every stage of no documents, and of documents whose other columns have the names that operators use."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    clash = docs.limit(40).withColumns({"_keep_id": docs["doc_id"], "_keep_hash": docs["doc_id"], "component": docs["source"], "rank": docs["lang"]})
    kept = minhash.keep_one(clash)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in minhash.keep_one(docs.limit(40)).collect()}


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema) if stage is not corpus_pipeline.STAGES[-1][1] else stage(spark, docs, SF)
    assert sorted(map(tuple, out)) == sorted(map(tuple, docs.collect()))
