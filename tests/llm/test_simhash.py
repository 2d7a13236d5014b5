import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import ROWS

from corpusmill.llm import simhash as S
from corpusmill.llm.queries import op6_simhash_dedup


def groups(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_edges(fp, limit=S.DISTANCE):
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    return [(i, j) for i, j in zip(*np.nonzero(d <= limit)) if i < j]


def test_close_fingerprints_share_two_blocks():
    rng = np.random.default_rng(3)
    for _ in range(200):
        bits = rng.integers(0, 2, 256).astype(np.uint8)
        other = bits.copy()
        other[rng.choice(256, int(rng.integers(0, S.BLOCKS - 1)), replace=False)] ^= 1
        fp = np.stack([np.packbits(bits).view(np.uint64), np.packbits(other).view(np.uint64)])
        keys = S.block_keys(fp)
        assert (keys[0] == keys[1]).any()


@pytest.mark.parametrize("distance, blocks", [(S.DISTANCE, S.BLOCKS), (S.DISTANCE, 18), (0, 6), (7, 3), (60, 6)])
def test_all_fingerprints_within_the_limit_share_a_key(distance, blocks):
    rng = np.random.default_rng(12)
    bits = rng.integers(0, 2, (1000, 256)).astype(np.uint8)
    other = bits.copy()
    for row in other:
        row[rng.choice(256, distance, replace=False)] ^= 1
    a, b = (S.block_keys(np.packbits(x, axis=1).view(np.uint64), blocks, distance) for x in (bits, other))
    assert (a == b).any(axis=1).all()


def flipped(draw, kinds, count, flips):
    """Fingerprints that differ from one of some centres in ``flips`` bits."""
    centres = [[draw.getrandbits(1) for _ in range(256)] for _ in range(kinds)]
    out = []
    for _ in range(count):
        bits = list(draw.choice(centres))
        for b in draw.sample(range(256), flips):
            bits[b] ^= 1
        out.append(np.packbits(np.array(bits, np.uint8)).view(np.uint64))
    return np.array(out)


# pairs about the limit; groups whose keys are hot; one template, whose keys cost more than all pairs
@pytest.mark.parametrize("kinds, flips, sample", [(900, 18, 64), (12, 15, 64), (1, 20, 64), (1, 24, 1)])
def test_close_pairs_connect_what_all_pairs_connect(monkeypatch, kinds, flips, sample):
    monkeypatch.setattr(S, "HOT_SAMPLE", sample)
    fp = flipped(random.Random(13), kinds, 2000, flips)
    a, b, d = S.close_pairs(np.ascontiguousarray(fp.T), S.key_masks(), S.DISTANCE)
    assert (np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1) == d).all() and d.max() <= S.DISTANCE
    assert groups(2000, zip(a.tolist(), b.tolist())) == groups(2000, brute_edges(fp))


@pytest.mark.parametrize("cell", [S.CELL, 400])
def test_no_pair_within_the_limit_is_left_out(spark, monkeypatch, cell):
    monkeypatch.setattr(S, "CELL", cell)
    fp = np.concatenate([flipped(random.Random(k), 1, 2, 18) for k in range(700)])
    pairs = [(k, k + 1) for k in range(0, len(fp), 2) if np.bitwise_count(fp[k] ^ fp[k + 1]).sum() > 30]
    reps = spark.createDataFrame([(k, *f) for k, f in enumerate(fp.view(np.int64).tolist())], "id long, f0 long, f1 long, f2 long, f3 long")
    found = {(r.b, r.a) for r in S.near_pairs(reps).collect()}
    assert set(brute_edges(fp)) == found and len(found.intersection(pairs)) > 300


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (5, 4)).astype(np.uint64)
    for _ in range(20):
        fp = base[rng.integers(0, 5, 60)].copy()
        for row in fp:
            for b in rng.choice(256, int(rng.integers(0, 24)), replace=False):
                row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        edges = S.forest(fp, S.DISTANCE)
        assert all(np.bitwise_count(fp[a] ^ fp[b]).sum() == d <= S.DISTANCE for a, b, d in edges)
        assert groups(60, [e[:2] for e in edges]) == groups(60, brute_edges(fp))


@pytest.mark.parametrize("hot", [S.HOT_ROWS, 5])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_ROWS", hot)
    draw = random.Random(5)
    pairs = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    pairs = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    got = {r.id: r.root for r in S.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    expected = groups(400, pairs)
    assert got == {k: r for k, r in enumerate(expected) if r != k}
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_and_groups_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    ids = [r.doc_id for r in docs]
    fp, some = S.fingerprints(pa.array([r.text for r in docs]))
    edges = [(a, b) for a, b in brute_edges(fp) if some[a] and some[b]]
    roots = groups(len(ids), edges)
    kept = {r.doc_id: r.kept_id for r in op6_simhash_dedup(spark, small).collect()}
    together = sum(kept.get(ids[a], ids[a]) == kept.get(ids[b], ids[b]) for a, b in edges)
    assert together >= 0.95 * len(edges) > 0
    # never more than brute force joins, and each with its group's first
    for k, i in enumerate(ids):
        if i in kept:
            assert kept[i] < i and roots[ids.index(kept[i])] == roots[k]
    assert len(kept) >= 0.95 * sum(r != k for k, r in enumerate(roots))


def with_far_copies(docs):
    """(doc_id, text) of ``docs`` and of copies with a ninth of the words replaced, many of them about the limit."""
    draw, rows = random.Random(14), [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    for i, text in [(i, t) for i, t in rows if t and 40 <= len(t.split()) <= 400][:150]:
        words = text.split()
        for k in draw.sample(range(len(words)), len(words) // 9):
            words[k] = "".join(draw.choices("klmnopqrst", k=8))
        rows.append((1_000_000 + i, " ".join(words)))
    return rows


def roots_of(rows):
    fp, some = S.fingerprints(pa.array([t for _, t in rows]))
    return groups(len(rows), [(a, b) for a, b in brute_edges(fp) if some[a] and some[b]])


def test_groups_are_those_of_brute_force(spark, small):
    rows = with_far_copies(spark.read.parquet(f"{small}/documents.parquet"))
    kept = {r.doc_id: r.kept_id for r in S.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {rows[k][0]: rows[root][0] for k, root in enumerate(roots_of(rows)) if root != k}


def test_large_group_of_copies(spark):
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(300)]
    rows = []
    for k in range(1500):
        w = list(words)
        for _ in range(k % 3):
            w[draw.randrange(300)] = f"changed{k}"
        rows.append((k, " ".join(w)))
    rows.append((5000, " ".join("".join(draw.choices("klmnopqrst", k=6)) for _ in range(300))))
    got = {r.doc_id: r.kept_id for r in S.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(1, 1500), 0)


def test_edges(spark, edges, nothing):
    pairs = sorted((r.doc_id, r.kept_id) for r in S.duplicates(edges).collect())
    assert pairs == [(2, 1), (9, 9)]  # a copy, and a repeated row
    kept = S.deduplicate(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    # both of the different texts of one id stay
    assert sorted(x for x in ids if x is not None) == [-5, 1, 3, 4, 5, 6, 7, 8, 9, 10, 10, 11] and ids.count(None) == 2
    assert {r.text for r in kept.where("doc_id = 10").collect()} == {"one text of a repeated id", "another text of the same id"}
    assert S.duplicates(nothing).count() == 0 and S.deduplicate(nothing).count() == 0
    assert len(ROWS) == edges.count() == len(ids) + len(pairs)


def test_repeated_ids_and_rows(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [("b", base)] * 3 + [("b", "something else altogether is written here"), ("a", base.upper()), ("c", base), ("c", "a text of its own that nothing else is like")] + [("d", "five equal rows of one text")] * 5
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    gone = sorted((r.doc_id, r.kept_id) for r in S.duplicates(docs).collect())
    assert gone == [("b", "a")] * 3 + [("c", "a")] + [("d", "d")] * 4
    kept = sorted((r.doc_id, r.text) for r in S.deduplicate(docs).collect())
    assert kept == sorted({rows[3], rows[4], rows[6], rows[-1]})


def noisy(draw, kinds, count, flips):
    """Fingerprints near some centres, which share their first four blocks."""
    head = [draw.getrandbits(1) for _ in range(60)]
    centres = [head + [draw.getrandbits(1) for _ in range(196)] for _ in range(kinds)]
    out = []
    for k in range(count):
        bits = list(centres[draw.randrange(kinds)])
        for b in draw.sample(range(60, 256), draw.randrange(flips)):
            bits[b] ^= 1
        out.append(np.packbits(np.array(bits, np.uint8)).view(np.int64).tolist())
    return out


def test_hot_keys_lose_no_pair(spark, monkeypatch):
    draw = random.Random(8)
    fps = noisy(draw, 5, 300, 30)
    reps = spark.createDataFrame([(k, *f) for k, f in enumerate(fps)], "id long, f0 long, f1 long, f2 long, f3 long")
    expected = groups(300, brute_edges(np.array(fps).view(np.uint64)))
    cold = groups(300, [(r.b, r.a) for r in S.near_pairs(reps).collect()])
    monkeypatch.setattr(S, "HOT", 20)
    monkeypatch.setattr(S, "HOT_SAMPLE", 1)
    monkeypatch.setattr(S, "CELL", 16)
    pairs = S.near_pairs(reps).collect()
    fp = np.array(fps).view(np.uint64)
    assert all(r.a > r.b and np.bitwise_count(fp[r.a] ^ fp[r.b]).sum() == r.distance <= S.DISTANCE for r in pairs)
    assert groups(300, [(r.b, r.a) for r in pairs]) == cold == expected and len(set(expected)) >= 5


def test_hot_values_in_joins_change_nothing(spark, tiny, monkeypatch):
    before = sorted(map(tuple, op6_simhash_dedup(spark, tiny).collect()))
    monkeypatch.setattr(S, "HOT_ROWS", 1)
    assert sorted(map(tuple, op6_simhash_dedup(spark, tiny).collect())) == before and before


def test_fingerprint_is_the_majority_of_distinct_words():
    a, some = S.fingerprints(pa.array(["x y z", "Z  y, x x x", "", None, "!"]))
    assert (a[0] == a[1]).all() and some.tolist() == [True, True, False, False, False]
