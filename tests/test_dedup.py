import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import queries
from corpusmill.operators import exact, minhash


def marks(spark, texts, level):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return [(r.is_dup, r.first_key) for r in exact.mark_duplicates(rows, level).orderBy("doc_id").collect()]


def test_levels(spark):
    texts = ["One  text, 12.", "one text 12", "One  text, 12.", "ONE TEXT 7", "Straße", "STRASSE", "a_b", "a b"]
    assert [k for _, k in marks(spark, texts, "raw")] == [0, 1, 0, 3, 4, 5, 6, 7]
    assert [k for _, k in marks(spark, texts, "normalized")] == [0, 0, 0, 3, 4, 4, 6, 7]
    assert [k for _, k in marks(spark, texts, "structural")] == [0, 0, 0, 0, 4, 4, 6, 7]
    assert [d for d, _ in marks(spark, texts, "normalized")] == [False, True, True, False, False, True, False, False]
    with pytest.raises(ValueError):
        exact.canonical(F.lit("x"), "other")


def test_signatures_are_digests(spark):
    row = spark.createDataFrame([("Ab, 1",)], "text string").select(exact.signatures(F.col("text")).alias("s")).first().s
    assert len(row.raw) == len(row.normalized) == 32 and row.raw != row.normalized != row.structural


def plain_signature(text, num_perm, n=5, seed=1):
    import hashlib

    draw = random.Random(seed)
    a = [draw.randrange(1, minhash.PRIME) for _ in range(num_perm)]
    b = [draw.randrange(0, minhash.PRIME) for _ in range(num_perm)]
    hashes = [int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big") for s in minhash.shingle_set(text, n)]
    return [min((((x * h + y) % minhash.PRIME) & 0xFFFFFFFF for h in hashes), default=minhash.EMPTY) for x, y in zip(a, b)]


def test_signature_values():
    a, b = minhash.permutations(16)
    for text in ("", "one", "the quick brown fox jumps over the lazy dog", "x y z " * 50):
        assert minhash.sign(text, a, b).tolist() == plain_signature(text, 16)


def test_modular_arithmetic():
    rng = np.random.default_rng(0)
    a, b, h = (rng.integers(0, minhash.PRIME, 200).astype(np.uint64) for _ in range(3))
    a[0] = b[0] = h[0] = minhash.PRIME - 1
    got = minhash.multiply_add(a, h, b)
    for i in range(0, 200, 7):
        for j in range(0, 200, 11):
            assert int(got[i, j]) == (int(a[j]) * int(h[i]) + int(b[j])) % minhash.PRIME


def test_arithmetic_in_three_blocks():
    """What signing costs is the blocks that it goes through; ends of the range are exact."""
    import tracemalloc

    ends = np.array([0, 1, 7, 8, (1 << 29) - 1, 1 << 29, (1 << 32) - 1, 1 << 32, minhash.PRIME // 2, minhash.PRIME - 2, minhash.PRIME - 1], np.uint64)
    for b in ends:
        got = minhash.multiply_add(ends, ends, np.full(len(ends), b, np.uint64)).tolist()
        assert got == [[(int(x) * int(h) + int(b)) % minhash.PRIME for x in ends] for h in ends]
    a, b = minhash.permutations(128)
    h = np.arange(2048, dtype=np.uint64)
    tracemalloc.start()
    minhash.multiply_add(a, h, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * 2048 * 128 * 8, peak


def test_estimate_is_near_jaccard(spark):
    base = [f"w{k}" for k in range(60)]
    other = base[:30] + ["new"] + base[31:]
    rows = spark.createDataFrame([(" ".join(base), " ".join(other))], "a string, b string")
    sim = minhash.similarity(minhash.signature(F.col("a"), 256), minhash.signature(F.col("b"), 256))
    row = rows.select(minhash.jaccard(minhash.shingles(F.col("a")), minhash.shingles(F.col("b"))).alias("j"), sim.alias("s")).first()
    assert abs(row.j - row.s) < 3 / 16 and row.j == 51 / 61


def corpus(n, seed):
    draw, out = random.Random(seed), []
    for k in range(n):
        if out and draw.random() < 0.6:
            words = draw.choice(out).split()
            for _ in range(draw.randrange(0, 4)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10_000)}"
        else:
            words = [f"v{draw.randrange(5_000)}" for _ in range(60)]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed, threshold", [(1, 0.8), (2, 0.8), (3, 0.6)])
def test_greedy_equals_the_sequential_rule(spark, seed, threshold):
    texts = corpus(120, seed) + ["", "  ", "short"]
    a, b = minhash.permutations(128)
    sigs = [minhash.sign(t, a, b) for t in texts]
    kept, expected = [], {}
    for k, s in enumerate(sigs):
        # candidates share a whole band, which at 0.8 every similar pair does
        near = [(float((s == sigs[j]).mean()), -j) for j in kept if (s == sigs[j]).mean() >= threshold and (s.reshape(32, 4) == sigs[j].reshape(32, 4)).all(axis=1).any()]
        if near:
            expected[k] = (True, -max(near)[1], max(near)[0])
        else:
            expected[k] = (False, None, 0.0)
            kept.append(k)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for parts in (1, 8):
        got = {r.ord: (r.is_dup, r.matched_ord, r.similarity) for r in minhash.deduplicate(docs.repartition(parts), threshold).collect()}
        assert got == expected


def test_pair_queries_cover_every_document(spark, tmp_path):
    texts = corpus(40, 4)
    texts += [texts[0], texts[0].upper(), texts[0], texts[5] + "!", texts[7], "", "", "short", "Short"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    a, b = minhash.permutations(128)
    sigs = [minhash.sign(t, a, b) for t in texts]
    shared = {(i, j): float((sigs[i] == sigs[j]).mean()) for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if (sigs[i] == sigs[j]).reshape(32, 4).all(axis=1).any()}
    assert {(0, 40), (0, 41), (40, 42), (45, 46), (47, 48)} <= set(shared) and len(set(shared.values())) > 3
    assert sorted((r.a, r.b) for r in queries.lsh_candidates(spark, str(tmp_path)).collect()) == sorted(shared)
    got = sorted((r.a, r.b, r.similarity) for r in queries.near_dup_pairs(spark, str(tmp_path)).collect())
    assert got == sorted((*k, s) for k, s in shared.items() if s >= 0.8)


def test_scores_on_labelled_texts(spark):
    from corpusmill.operators import evaluation

    labelled = evaluation.labelled_corpus(spark, 50)
    rows = labelled.orderBy("ord").collect()
    sets = [minhash.shingle_set(r.text) for r in rows]
    for r, s in zip(rows, sets):
        assert len(r.text.split()) == 160 and r.expected_duplicate == (r.ord % 5 == 4)
        if r.expected_duplicate:
            other = sets[r.ord - 1]
            assert rows[r.ord - 1].family == r.family and 0.85 < len(s & other) / len(s | other) < 0.93
    assert len({r.family for r in rows}) == 40
    low = evaluation.dedup_scores(labelled, threshold=0.7).first()
    assert (low.documents, low.expected, low.true_positive, low.false_positive, low.false_negative, low.precision, low.recall) == (50, 10, 10, 0, 0, 1.0, 1.0)
    none = evaluation.dedup_scores(labelled, threshold=1.0).first()
    assert none.recall < 1 and none.precision == 1.0


def test_linear_fit(spark):
    from corpusmill.operators import evaluation

    points = spark.createDataFrame([(1.0, 42.3), (5.0, 85.6), (10.0, 139.7)], "x double, y double")
    fit = evaluation.linear_fit(points, "x", "y").first()
    slope, intercept = np.polyfit([1, 5, 10], [42.3, 85.6, 139.7], 1)
    assert np.isclose(fit.slope, slope) and np.isclose(fit.intercept, intercept)
    assert evaluation.linear_fit(points.where("x = 1"), "x", "y").first().slope is None


def test_later_rows_alone_are_matched(spark):
    a, b = minhash.permutations(8)
    rows = [(k, minhash.sign(t, a, b).astype(int).tolist()) for k, t in [(-2, "one two three four five six"), (-1, "one two three four five six"), (3, "one two three four five six"), (4, "other words are in this text")]]
    signed = spark.createDataFrame(rows, "ord long, sig array<bigint>")
    pairs = minhash.similar_pairs(signed, 0.8, 8, 4, later=signed.where("ord > 0")).collect()
    assert sorted((r.a, r.b) for r in pairs) == [(-2, 3), (-1, 3)]


def test_hot_digests_are_joined_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"d{k % 7 if k % 3 else 0}") for k in range(200)], "ord long, digest string")
    before = sorted(map(tuple, exact.first_of_equal(rows, "ord").collect()))
    monkeypatch.setattr(exact, "HOT_ROWS", 25)
    assert sorted(map(tuple, exact.first_of_equal(rows, "ord").collect())) == before
    assert before == sorted((k, min(j for j in range(200) if (j % 7 if j % 3 else 0) == (k % 7 if k % 3 else 0))) for k in range(200))


def test_chain_keeps_what_no_kept_row_matches(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert {r.k: r.kept for r in minhash.greedy(edges).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_bands(spark):
    with pytest.raises(ValueError):
        minhash.candidates(spark.createDataFrame([(1, [1, 2, 3])], "ord long, sig array<bigint>"), 3, 2)
    assert round(minhash.approximate_threshold(128, 32), 2) == 0.42
    row = spark.createDataFrame([([1, 2], [1, 3])], "a array<bigint>, b array<bigint>")
    assert row.select(minhash.similarity(F.col("a"), F.col("b"))).first()[0] == 0.5
    with pytest.raises(Exception, match="different lengths"):
        row.select(minhash.similarity(F.col("a"), F.array(F.lit(1).cast("long")))).collect()
