import pyarrow as pa
import pytest
from test_bpe import REFERENCE
from test_decontaminate import brute as spans_of
from test_decontaminate import phrases_of
from test_secrets import brute as secrets_of
from test_simhash import brute_edges, groups, roots_of, with_far_copies

import corpus_pipeline
from corpusmill.llm import quality, simhash


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_passages", "secret_scan", "token_ids"]


def test_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    keep = {r.doc_id for r in quality.verdicts(docs, spark.read.parquet(f"{tiny}/labels.parquet")).collect() if r.keep}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in keep)
    fp, some = simhash.fingerprints(pa.array([t for _, t in rows]))
    roots = groups(len(rows), [e for e in brute_edges(fp) if some[e[0]] and some[e[1]]])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    grams = phrases_of([(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()], 8, 5)
    expected = {}
    for i, text in rows:
        for a, b in reversed(spans_of(text, grams)[0]):
            text = text[:a] + text[b:]
        if any(c.isalnum() for c in text):
            if "token" in text or "AKIA" in text:
                for a, b, name in reversed(secrets_of(text)):
                    text = f"{text[:a]}<{name}>{text[b:]}"
            expected[i] = REFERENCE.encode_ordinary(text)
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, tiny).collect()}
    assert got == expected and len(got) < docs.count()


def test_near_duplicates_leaves_one_row_of_each_group(spark, small):
    rows = with_far_copies(spark.read.parquet(f"{small}/documents.parquet"))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), small)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[k][0] for k, root in enumerate(roots_of(rows)) if root == k)


@pytest.mark.parametrize("empty", [False, True])
def test_edges_through_all_stages(spark, edges, nothing, tiny, empty):
    docs = nothing if empty else edges
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, tiny)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    rows = docs.collect()
    assert (not rows) if empty else {1, 7, 8} <= {r.doc_id for r in rows}
