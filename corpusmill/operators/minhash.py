"""Near-duplicates by MinHash, banding and a first-row-wins fixpoint.

Signatures are made in numpy over Arrow batches, with values that agree with the engine this one is compatible
with. Rows that share a whole band are candidates; every candidate is verified on its whole signature.
A row goes if a row that stays, and comes before it, is similar enough. Rows with equal signatures are one row for
all that, so large groups of copies make no quadratic joins.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.pieces import by_pieces
from corpusmill.storage import checkpoint

PRIME = (1 << 61) - 1
EMPTY = (1 << 32) - 1
#: Hashes that are worked on at once, so that a core's cache holds their blocks.
BLOCK = 128
_WORD = re.compile(r"\w+")


def permutations(num_perm: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the hash functions; all factors are drawn first."""
    draw = random.Random(seed)
    factors = [draw.randrange(1, PRIME) for _ in range(num_perm)]
    return np.array(factors, np.uint64), np.array([draw.randrange(0, PRIME) for _ in range(num_perm)], np.uint64)


def _fold(x: np.ndarray) -> np.ndarray:
    """Modulo 2**61 - 1, nearly: at most the prime itself comes out."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(61))
    return np.where(x >= p, x - p, x)


def multiply_add(a: np.ndarray, h: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a * h + b) mod 2**61 - 1, in 64-bit steps; ``a`` and ``b`` along the columns, ``h`` along the rows, all below the prime.

    Terms are added up unreduced, as together they stay below 2**64. Three blocks are worked on in place.
    """
    half, p = np.uint64((1 << 29) - 1), np.uint64(PRIME)
    low, high = (h & half)[:, None], (h >> np.uint64(29))[:, None]  # 29 and 32 bits
    a_low, a_high = a & half, a >> np.uint64(29)
    out = low * a_low  # below 2**58
    middle, t = low * a_high, high * a_low  # below 2**61 each; times 2**29
    middle += t
    # x * 2**29 mod p: what is above 32 bits comes round
    np.right_shift(middle, np.uint64(32), out=t)
    out += t
    middle &= np.uint64((1 << 32) - 1)
    middle <<= np.uint64(29)
    out += middle
    np.multiply(high, a_high, out=t)  # times 2**58: what is above 3 bits comes round
    np.right_shift(t, np.uint64(3), out=middle)
    out += middle
    t <<= np.uint64(61)
    t >>= np.uint64(3)
    out += t
    out += b
    np.right_shift(out, np.uint64(61), out=t)
    out &= p
    out += t  # at most the prime and 7
    if out.size and out.max() >= p:
        out -= np.where(out >= p, p, np.uint64(0))
    return out


def shingle_set(source: str, width: int = 5) -> set[str]:
    found = _WORD.findall(source.lower())
    return {" ".join(found[k : k + width]) for k in range(max(1, len(found) - width + 1))} if found else set()


def sign(text: str, a: np.ndarray, b: np.ndarray, n: int = 5) -> np.ndarray:
    found = shingle_set(text, n)
    best = np.full(len(a), EMPTY, np.uint64)
    if found:
        hashes = np.frombuffer(b"".join(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest() for s in found), ">u8").astype(np.uint64)
        hashes = _fold(hashes)
        for k in range(0, len(hashes), BLOCK):
            values = multiply_add(a, hashes[k : k + BLOCK], b)
            values &= np.uint64(EMPTY)
            np.minimum(best, values.min(axis=0), out=best)
    return best


def signature(text: Column, num_perm: int = 128, ngram: int = 5, seed: int = 1, first: Callable[[str | None], str] | None = None) -> Column:
    """array<bigint> of ``num_perm`` minima. ``first``, if given, is applied to each text before, in the same worker."""

    def run(texts: list[str | None]) -> pa.Array:
        a, b = permutations(num_perm, seed)
        flat = np.empty((len(texts), num_perm), np.int64)
        for k, t in enumerate(texts):
            flat[k] = sign((first(t) if first else t) or "", a, b, ngram)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * num_perm, pa.int32()), pa.array(flat.reshape(-1)))

    return by_pieces("array<bigint>", run)(text)


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of ``n`` lower-case tokens; the whole text's tokens if there are fewer; none if there are none."""

    def runs(found: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(found) - n + 1))
        each = F.transform(places, lambda i: F.array_join(F.slice(found, i, n), " "))
        return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    # the argument of a lambda is evaluated once; named in the inner one, the tokens would be found again for each run
    return F.element_at(F.transform(F.array(T.tokens(text)), runs), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct members; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; 0 for empty ones; an error if their lengths differ."""
    wrong = F.raise_error(F.lit("signatures have different lengths"))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    return F.when(F.size(a) != F.size(b), wrong.cast("double")).when(F.size(a) == 0, F.lit(0.0)).otherwise(equal)


def approximate_threshold(num_perm: int = 128, bands: int = 32) -> float:
    """The similarity at which about half of the pairs become candidates."""
    return (1 / bands) ** (bands / num_perm)


def candidates(signed: DataFrame, num_perm: int = 128, bands: int = 32, key_col: str = "ord", sig_col: str = "sig", later: DataFrame | None = None) -> DataFrame:
    """Distinct (a, b), a before b, of rows that share a whole band. The bands' hashes are joined, not the bands.

    ``later``, if given, are the rows that b may be, of the same columns.
    """
    if bands < 1 or num_perm % bands:
        raise ValueError("bands must divide num_perm")
    rows = num_perm // bands
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice(F.col(sig_col), i * rows + 1, rows))))
    left, right = (df.select(F.col(key_col).alias(side), band.alias("band")) for df, side in ((signed, "a"), (signed if later is None else later, "b")))
    return left.join(right, "band").where("a < b").select("a", "b").distinct()


def similar_pairs(signed: DataFrame, threshold: float = 0.8, num_perm: int = 128, bands: int = 32, key_col: str = "ord", sig_col: str = "sig", later: DataFrame | None = None) -> DataFrame:
    """Verified (a, b, similarity), a before b; ``later`` as in ``candidates``."""
    side = signed.select(F.col(key_col).alias("k"), F.col(sig_col).alias("s"))
    joined = candidates(signed, num_perm, bands, key_col, sig_col, later).join(side.toDF("a", "sa"), "a").join(side.toDF("b", "sb"), "b")
    return joined.select("a", "b", similarity(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)


def with_lead(signed: DataFrame, key_col: str = "ord", sig_col: str = "sig") -> DataFrame:
    """Adds ``lead``, the first key with the same signature."""
    same = Window.partitionBy("_hash", sig_col)
    return signed.withColumn("_hash", F.xxhash64(sig_col)).withColumn("lead", F.min(key_col).over(same)).drop("_hash")


def _every_row(pairs: DataFrame, grouped: DataFrame, *same: Column) -> DataFrame:
    """Pairs (a, b, ...) of leads become those of all rows (ord, lead); rows of one lead are pairs too, with ``same`` as the further columns."""
    members = grouped.select("ord", "lead")
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    across = pairs.join(members.toDF("x", "a"), "a").join(members.toDF("y", "b"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *rest)
    within = members.toDF("a", "lead").join(members.toDF("b", "lead"), "lead").where("a < b").select("a", "b", *same)
    return across.unionByName(within)


def all_candidates(signed: DataFrame, num_perm: int = 128, bands: int = 32) -> DataFrame:
    """``candidates`` of every row (ord, sig), of unique ``ord``; bands are joined once for each distinct signature."""
    grouped = checkpoint(with_lead(signed))
    return _every_row(candidates(grouped.where("ord = lead"), num_perm, bands), grouped)


def all_similar_pairs(signed: DataFrame, threshold: float = 0.8, num_perm: int = 128, bands: int = 32) -> DataFrame:
    """``similar_pairs`` of every row (ord, sig), of unique ``ord``; verified once for each pair of distinct signatures."""
    grouped = checkpoint(with_lead(signed))
    return _every_row(similar_pairs(grouped.where("ord = lead"), threshold, num_perm, bands), grouped, F.lit(1.0).alias("similarity"))


def greedy(edges: DataFrame) -> DataFrame:
    """(k, kept) of every row with an edge to an earlier one: it goes if one of those stays, in input order.

    Each round decides all rows whose earlier neighbours are decided; the first undecided one always is.
    """
    edges = checkpoint(edges)
    state = checkpoint(edges.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(edges.select(F.col("b").alias("k")).distinct().withColumn("later", F.lit(True)), "k", "left").select("k", F.when(F.col("later").isNull(), True).alias("kept")))
    while True:
        open_edges = edges.join(state.where("kept IS NULL").select(F.col("k").alias("b")), "b").join(state.select(F.col("k").alias("a"), "kept"), "a", "left")
        verdict = open_edges.groupBy("b").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.bool_and(F.coalesce(~F.col("kept"), F.lit(False))).alias("free"))
        decided = verdict.select(F.col("b").alias("k"), F.when(F.col("hit"), False).when(F.col("free"), True).alias("new"))
        state = checkpoint(state.join(decided, "k", "left").select("k", F.coalesce("kept", "new").alias("kept")))
        if not state.where("kept IS NULL").limit(1).count():
            return state


def deduplicate(docs: DataFrame, threshold: float = 0.8, num_perm: int = 128, bands: int = 32, ngram: int = 5, order_col: str = "doc_id", text_col: str = "text", first: Callable[[str | None], str] | None = None) -> DataFrame:
    """(ord, is_dup, matched_ord, similarity) of every row; ``order_col`` must be unique and is the input order.

    The match reported is the most similar of the earlier rows that stay, the first of them in a tie. ``first`` as in ``signature``.
    """
    signed = checkpoint(docs.select(F.col(order_col).alias("ord"), signature(F.col(text_col), num_perm, ngram, first=first).alias("sig")))
    grouped = checkpoint(with_lead(signed))
    leads = grouped.where("ord = lead").select("ord", "sig")
    edges = checkpoint(similar_pairs(leads, threshold, num_perm, bands))
    state = greedy(edges.select("a", "b"))
    kept_leads = leads.select("ord").join(state.select(F.col("k").alias("ord"), "kept"), "ord", "left").select("ord", F.coalesce("kept", F.lit(True)).alias("kept"))
    # a lead may be matched by an earlier kept lead; a copy also by its own lead, or by kept leads between the two
    both = edges.select(F.col("b").alias("me"), F.col("a").alias("other"), "similarity").union(edges.select(F.col("a").alias("me"), F.col("b").alias("other"), "similarity"))
    both = both.union(leads.select(F.col("ord").alias("me"), F.col("ord").alias("other"), F.lit(1.0).alias("similarity")))
    usable = both.join(kept_leads.where("kept").select(F.col("ord").alias("other")), "other")
    found = grouped.select("ord", F.col("lead").alias("me")).join(usable, "me").where("other < ord")
    best = found.groupBy("ord").agg(F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("best"))
    return signed.select("ord").join(best, "ord", "left").select("ord", F.col("best").isNotNull().alias("is_dup"), (-F.col("best.o")).alias("matched_ord"), F.coalesce("best.similarity", F.lit(0.0)).alias("similarity"))
