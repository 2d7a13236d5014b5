"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has many points on a ring of 60-bit hashes. A key belongs to the first point clockwise from
its own hash. No shard takes more than ``ceil((1 + slack) * keys / shards)`` keys: keys
are placed in ring order, and those that find a shard full continue clockwise to the next point of one that is not.

Since keys come in ring order, what a shard takes depends on the number of keys on each arc
alone. So the keys are counted by arc, where they are, the arcs are shared out by walking round the ring
once, and only keys of arcs that are split between shards are numbered, in ring order, to see on which side of the cut they
fall; all others read their shard off a table of the arcs, whose size is fixed by the ring. The numbering
spreads rows of one key over tasks, so a key that a third of all rows have is no more work than others.

Defined results: the bound holds for all inputs, ties included; keys may be of any type that has an order and hash as their text; a null
key hashes like the text "null"; repeated keys have equal hashes, so they are placed next to each other, each counting as one
load; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import small_side
from corpusmill.sources.shards import with_index

SHARDS = 64
POINTS = 128
SLACK = 0.05


def place_of(text: str) -> int:
    """A place on the ring, of 60 bits."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def place_column(key: Column) -> Column:
    """``place_of`` of a key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def ring(shards: int = SHARDS, points: int = POINTS) -> list[tuple[int, int]]:
    """(place, shard) of all points, in ring order."""
    return sorted((place_of(f"shard-{s}-{p}"), s) for s in range(shards) for p in range(points))


def share_out(counts: list[int], owners: list[int], capacity: int) -> list[list[tuple[int, int]]]:
    """For each arc, in ring order, the shards that take its keys and how many each takes, in turn.

    ``counts`` are the arcs' keys and ``owners`` the shards of the points at their ends.
    """
    free = dict.fromkeys(owners, capacity)
    # nxt[i]: the first point at or after i, in ring order, whose shard may still have room
    n = len(owners)
    nxt = list(range(n))

    def find(i: int) -> int:
        start = i
        while True:
            while nxt[i] != i:
                nxt[i] = nxt[nxt[i]]
                i = nxt[i]
            if free[owners[i]]:
                return i
            nxt[i] = (i + 1) % n
            i = nxt[i]
            if i == start:
                raise ValueError("no shard has room")

    out = []
    for arc, count in enumerate(counts):
        taken: list[tuple[int, int]] = []
        while count:
            at = find(arc)
            shard = owners[at]
            size = min(count, free[shard])
            free[shard] -= size
            count -= size
            taken.append((shard, size))
        out.append(taken)
    return out


def assign(keys: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, points: int = POINTS, slack: float = SLACK) -> DataFrame:
    """(id, shard int) of every row."""
    spark = keys.sparkSession
    circle = ring(shards, points)
    places, owners = [p for p, _ in circle], [s for _, s in circle]
    # arcs are looked up by their upper bits, then within the few points that share them
    bits = max(1, math.ceil(math.log2(len(places))) + 2)
    shift = 60 - bits
    cells = [bisect.bisect_left(places, c << shift) for c in range(1 << bits)]
    rows = keys.select(F.col(f"`{id_col}`").alias("id")).withColumn("place", place_column(F.col("id")))
    cell_rows = []
    for c, a in enumerate(cells):
        b = cells[c + 1] if c + 1 < len(cells) else len(places)
        cell_rows.append((c, a, places[a:b]))
    table = small_side(spark.createDataFrame(cell_rows, "cell long, first_arc int, cuts array<long>"), len(cell_rows), 48)
    arc = (F.col("first_arc") + F.size(F.filter("cuts", lambda x: x < F.col("place")))) % len(places)
    located = rows.join(table, F.shiftright("place", shift) == F.col("cell")).select("id", "place", arc.cast("int").alias("arc"))
    counted = {r["arc"]: r["count"] for r in located.groupBy("arc").count().collect()}  # at most one row an arc
    total = sum(counted.values())
    if not total:
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("shard"))
    capacity = math.ceil((1 + slack) * total / shards)
    shares = share_out([counted.get(k, 0) for k in range(len(places))], owners, capacity)
    whole = [(k, s[0][0]) for k, s in enumerate(shares) if len(s) == 1]
    split, below = [], 0
    for k, s in enumerate(shares):
        if len(s) > 1:
            for shard, size in s:
                split.append((k, shard, below, below + size))
                below += size
    one = small_side(spark.createDataFrame(whole, "arc int, shard int"), len(whole), 16)
    out = located.join(one, "arc").select("id", "shard")
    if split:
        cuts = small_side(spark.createDataFrame(split, "arc int, shard int, low long, high long"), len(split), 32)
        arcs = sorted({x[0] for x in split})
        arcs = small_side(spark.createDataFrame([(k,) for k in arcs], "arc int"), len(arcs), 8)
        # numbered over all split arcs in turn; the last column spreads equal keys
        ranked = with_index(located.join(arcs, "arc", "left_semi").withColumn("row", F.monotonically_increasing_id()), "arc", "place", "id", "row")
        parts = ranked.join(cuts, "arc").where((F.col("idx") >= F.col("low")) & (F.col("idx") < F.col("high")))
        out = out.unionByName(parts.select("id", "shard"))
    return out.withColumnRenamed("id", id_col)
