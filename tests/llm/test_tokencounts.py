from conftest_rows import ROWS

from corpusmill.llm import bpe
from corpusmill.llm import tokencounts as C
from corpusmill.llm.queries import op9_token_counts


def check(rows, lengths):
    assert [r.context_limit for r in rows] == sorted(set(lengths))
    for r in rows:
        limit = r.context_limit
        assert r.documents == lengths.count(limit)
        assert r.documents_over == sum(n > limit for n in lengths) and r.documents_within == len(lengths) - r.documents_over
        assert r.quantile == r.documents_within / len(lengths)
        assert r.tokens_within == sum(n for n in lengths if n <= limit)
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths) and r.total_tokens == sum(lengths)


def test_every_limit_of_documents(spark, tiny):
    encoder = bpe.load()
    lengths = [len(encoder.encode(r.text)) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    check(op9_token_counts(spark, tiny).orderBy("context_limit").collect(), lengths)


def test_edges(edges, nothing):
    encoder = bpe.load()
    lengths = [len(encoder.encode(r[1])) for r in ROWS if r[1] is not None]
    counts = C.histogram(edges)
    check(C.every_limit(counts).orderBy("context_limit").collect(), lengths)
    got = {r.context_limit: r for r in C.at_limits(counts, [0, 3, 7, 10**9]).collect()}
    for limit, r in got.items():
        assert (r.documents_within, r.documents_over, r.truncated_tokens) == (sum(n <= limit for n in lengths), sum(n > limit for n in lengths), sum(min(n, limit) for n in lengths))
    for r in C.quantiles(counts, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == min(n for n in lengths if sum(m <= n for m in lengths) / len(lengths) >= r.share)
    empty = C.histogram(nothing)
    assert empty.count() == 0 and C.every_limit(empty).count() == 0
    assert C.at_limits(empty, [5]).first().truncated_tokens == 0 and C.quantiles(empty, [0.5]).first().n_tokens is None
