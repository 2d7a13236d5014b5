import math
from collections import Counter

import pytest

from corpusmill.llm import sharding as R
from corpusmill.llm.queries import op10_shards


def brute(keys, shards, points, slack):
    """One key after the other, clockwise round the ring."""
    circle = R.ring(shards, points)
    capacity = math.ceil((1 + slack) * len(keys) / shards)
    load, out = Counter(), []
    placed = [(R.place_of("null" if k is None else str(k)), k) for k in keys]
    n = len(circle)

    def arc(place):
        return next((i for i, (p, _) in enumerate(circle) if p >= place), n) % n

    for at, place, key in sorted(((arc(p), p, k) for p, k in placed), key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0)):
        while load[circle[at][1]] >= capacity:
            at = (at + 1) % n
        load[circle[at][1]] += 1
        out.append((key, circle[at][1]))
    return sorted(map(repr, out)), load


@pytest.mark.parametrize("shards, points, slack", [(4, 3, 0.05), (8, 1, 0.0), (1, 1, 0.1), (16, 8, 0.5)])
def test_against_brute_force(spark, shards, points, slack):
    keys = [*range(300), 5, 5, 5, None, None, -7]
    got = R.assign(spark.createDataFrame([(k, "x") for k in keys], "doc_id long, shard string"), shards=shards, points=points, slack=slack).collect()
    expected, load = brute(keys, shards, points, slack)
    assert sorted(repr((r.doc_id, r.shard)) for r in got) == expected
    assert max(load.values()) <= math.ceil((1 + slack) * len(keys) / shards)


def test_whole_table(spark, small):
    ids = [r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()]
    expected, _ = brute(ids, R.SHARDS, R.POINTS, R.SLACK)
    rows = op10_shards(spark, small).collect()
    assert sorted(repr((r.doc_id, r.shard)) for r in rows) == expected


def test_all_keys_on_one_place(spark, nothing):
    got = Counter(r.shard for r in R.assign(spark.createDataFrame([(1,)] * 100, "doc_id long"), shards=4, slack=0.0).collect())
    assert sorted(got.values()) == [25, 25, 25, 25]
    assert R.assign(nothing).count() == 0


def test_little_moves_when_a_shard_is_added(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in R.assign(keys, shards=20, slack=0.25).collect()}
    after = {r.doc_id: r.shard for r in R.assign(keys, shards=21, slack=0.25).collect()}
    moved = sum(before[k] != after[k] for k in before) / len(before)
    assert 0.02 < moved < 0.2


def test_text_keys_and_a_key_of_a_third_of_all_rows(spark):
    keys = [f"k{k}" for k in range(400)] + ["hot"] * 200 + [None] * 3
    rows = R.assign(spark.createDataFrame([(k,) for k in keys], "doc_id string").repartition(6), shards=8, points=16, slack=0.05).collect()
    expected, load = brute(keys, 8, 16, 0.05)
    assert sorted(repr((r.doc_id, r.shard)) for r in rows) == expected and len({r.shard for r in rows if r.doc_id == "hot"}) > 1
    assert max(Counter(r.shard for r in rows).values()) <= math.ceil(1.05 * len(keys) / 8)
