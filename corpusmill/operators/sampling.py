"""Samples of a fixed size."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.shards import with_index


def hash_sample(docs: DataFrame, n: int, key_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """The ``n`` rows with the smallest hashes: a top-n, with no full sort and no shuffle of the rest."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return docs.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string")))).orderBy("_h", key_col).limit(n).drop("_h")


def reservoir_places(total: int, n: int, seed: int = 0) -> list[int]:
    """Which rows, by place, a reservoir of size ``n`` holds after ``total`` rows, in its own order."""
    draw, held = random.Random(seed), []
    for k in range(total):
        if k < n:
            held.append(k)
        elif (at := draw.randrange(k + 1)) < n:
            held[at] = k
    return held


def reservoir_sample(docs: DataFrame, n: int, order_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """The rows that a sequential reservoir would hold: the same draws, made in the driver for the counted rows.

    One draw a row in sequence is what makes it the same sample; for large corpora ``hash_sample`` needs none.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    indexed = with_index(docs, order_col)
    places = reservoir_places(docs.count(), n, seed)
    chosen = docs.sparkSession.createDataFrame([(p, k) for k, p in enumerate(places)], "idx long, slot int")
    return indexed.join(F.broadcast(chosen) if n <= 1_000_000 else chosen, "idx").orderBy("slot").drop("idx", "slot")
