import numpy as np
import pyarrow as pa
from conftest_rows import ROWS

from corpusmill.llm import quality as Q
from corpusmill.llm.queries import op2_quality_rules


def stats_of(text):
    """The statistics of one text, counted plainly."""
    import re

    from corpusmill.llm.common import WORD_PATTERN

    words = re.findall(WORD_PATTERN, text.lower())
    n, size = len(words), len(text.encode())
    upper = sum(c.isascii() and c.isupper() for c in text)
    letters = sum(c.isascii() and c.isalpha() for c in text)
    symbols = sum(c in '#$%&*+<=>@[]\\^_`{|}~/!?' for c in text)
    lines = [x for x in text.split("\n") if x]
    odd = sum(x.encode()[-1:] not in [c.encode() for c in ".!?\"');:"] for x in lines)
    seen, again = set(), 0
    for x in lines:
        again += len(x.encode()) if x in seen else 0
        seen.add(x)
    near = sum(any(words[k] == words[k - g] for g in (1, 2, 3) if k >= g) for k in range(n))
    p = Q.PRIOR_WORDS
    return [upper / (letters + 5 * p), min(symbols / (n + p), 4), odd / (len(lines) + Q.PRIOR_LINES), again / (size + 5 * p), near / (n + p)]


def test_statistics():
    texts = ["A line.\nA line.\n\nb b b B\n", "", None, "  ", "!!! WOW!! | x | y", "ß é — ok\nwords words", *(r[1] for r in ROWS)]
    got = Q.statistics(pa.array(texts))
    for row, text in zip(got, texts):
        if not text or np.isnan(row).all():
            assert np.isnan(row).all()
        else:
            assert np.allclose(row, stats_of(text)), text
    assert np.isnan(got[1:4]).all() and not np.isnan(got[0]).any()


def walk(forest, node, x, depth=0):
    """A path by recursion, as in the published method."""
    if forest.feature[node] < 0 or not forest.low[node] <= x[forest.feature[node]] <= forest.high[node]:
        return forest.length[node]
    down = forest.left if x[forest.feature[node]] < forest.cut[node] else forest.right
    return walk(forest, down[node], x, depth + 1)


def test_forest_scores():
    rng = np.random.default_rng(0)
    data = rng.normal(0, 1, (500, 5))
    forest = Q.Forest(data, trees=20)
    rows = np.concatenate([data[:20], rng.normal(0, 1, (5, 5)) + 8])
    score = forest.score(rows)
    for x, s in zip(rows, score):
        assert np.isclose(s, 2 ** (-np.mean([walk(forest, r, x) for r in forest.roots]) / forest.norm))
    assert score[20:].min() > score[:20].max()
    assert forest.score(np.full((1, 5), np.nan)).tolist() == [1.0]
    assert Q.Forest(np.zeros((1, 5))).score(np.zeros((2, 5))).shape == (2,)


def test_threshold_is_the_best_allowed_cut():
    rng = np.random.default_rng(1)
    for _ in range(50):
        good, bad = rng.integers(0, 5, 30), rng.integers(0, 5, 30)
        cut = Q.threshold(good, bad, 0.3)
        over = [(good[k:].sum() / good.sum(), bad[k:].sum() / bad.sum()) for k in range(30)]
        best = max((b - g for g, b in over if g <= 0.3), default=-1)
        if cut < 1:
            k = round(cut * 30)
            assert over[k][0] <= 0.3 and np.isclose(over[k][1] - over[k][0], best)
        else:
            assert best <= 0
    assert Q.threshold(np.zeros(5, int), np.ones(5, int)) == 1.0


def test_labelled_rows_that_were_not_fitted(spark, small):
    """Labels of even ids are given, those of odd ids are held out."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    keep = {r.doc_id: r.keep for r in Q.verdicts(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    good, bad = [keep[r.doc_id] for r in held if r.quality], [keep[r.doc_id] for r in held if not r.quality]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad) and bad


def test_query_and_stage_agree(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = op2_quality_rules(spark, small).collect()
    assert len(rows) == docs.count()
    kept = Q.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.keep}


def test_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 1), (8, 1), (9, 0), (None, 1), (10, None), (99, 0), (8, 0)], "doc_id long, quality long")
    rows = Q.verdicts(edges, labels).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.score, r.keep))
    assert by[1] == by[2] and by[9] and len(by[9]) == 1
    for k in (3, 4, 5, 6, 11):
        assert by[k] == {(1.0, False)}
    kept = Q.keep_good(edges, labels)
    assert kept.columns == edges.columns
    for none in (labels.limit(0), labels.where("quality = 1"), labels.where("quality = 0")):
        assert sorted(str(r.doc_id) for r in Q.keep_good(edges, none).collect()) == sorted(map(str, (1, 2, 7, 8, 9, 9, 10, 10, None, -5)))
    assert Q.verdicts(nothing, labels).count() == 0 and Q.keep_good(nothing, labels).count() == 0
