"""Exact duplicates at three levels; the first row in input order stays."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.pieces import by_pieces, strings, structs
from corpusmill.schema import LEVELS
from corpusmill.storage import checkpoint

#: Rows of one digest beyond which it is hot, and hot digests that are broadcast at most (a few megabytes).
HOT_ROWS = 1_000_000
HOT_DIGESTS = 100_000


_GAPS, _DIGITS = re.compile(r"\W+"), re.compile(r"\d+")


def canonical_one(text: str, level: str) -> str:
    """What two texts must share to be equal: the text itself; or its case-folded words; or those with digit runs as 0."""
    if level == "raw":
        return text
    words = _GAPS.sub(" ", text.casefold()).strip(" ")
    return words if level == "normalized" else _DIGITS.sub("0", words)


def _each(level: str, f: Callable[[str], str]) -> Callable[[Column], Column]:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")

    return by_pieces("string", lambda texts: strings([None if t is None else f(canonical_one(t, level)) for t in texts]))


def canonical(text: Column, level: str = "normalized") -> Column:
    return _each(level, str)(text)


def _record_digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def signature(text: Column, level: str = "normalized") -> Column:
    """The digest that the records carry: 32 hexadecimal digits."""
    return _each(level, _record_digest)(text)


def signatures(text: Column) -> Column:
    """The signatures of all levels, made in one worker."""
    run = by_pieces(", ".join(f"{x} string" for x in LEVELS), lambda texts: structs([tuple(None if t is None else _record_digest(canonical_one(t, x)) for x in LEVELS) for t in texts], dict.fromkeys(LEVELS, pa.string())))
    return run(text)


def digest_one(canonical_text: str) -> str:
    return hashlib.sha256(canonical_text.encode("utf-8", "surrogatepass")).hexdigest()


def digest(text: Column, level: str = "normalized") -> Column:
    """A 256-bit digest of the canonical text, so that long texts don't make long keys; of a null text, that of an empty one."""
    filled = F.coalesce(text, F.lit(""))
    return F.sha2(filled, 256) if level == "raw" else _each(level, digest_one)(filled)


def first_of_equal(digests: DataFrame, order_col: str) -> DataFrame:
    """(order, first): the first of the rows (order, digest) with the same digest.

    Firsts are aggregated where the rows are, so that a digest that a third of all rows have is no large group. The rows of
    one that more than ``HOT_ROWS`` have are joined by broadcast, as there are few such digests.
    """
    firsts = checkpoint(digests.groupBy("digest").agg(F.min(order_col).alias("first"), F.count("*").alias("n")))
    hot = firsts.where(F.col("n") > HOT_ROWS).drop("n")
    few = hot.count()
    if not 0 < few <= HOT_DIGESTS:
        return digests.join(firsts.drop("n"), "digest").select(order_col, "first")
    rest = digests.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(firsts.where(F.col("n") <= HOT_ROWS).drop("n"), "digest")
    return digests.join(F.broadcast(hot), "digest").unionByName(rest).select(order_col, "first")


def mark_duplicates(docs: DataFrame, level: str = "normalized", key_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """Adds ``is_dup`` and ``first_key``, the key of the first row with the same text. One shuffle, on the digest."""
    same = Window.partitionBy("_digest").orderBy(order_col or key_col)
    marked = docs.withColumn("_digest", digest(F.col(text_col), level))
    return marked.withColumn("is_dup", F.row_number().over(same) > 1).withColumn("first_key", F.first(key_col).over(same)).drop("_digest")


def keep_first(docs: DataFrame, level: str = "normalized", key_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    return mark_duplicates(docs, level, key_col, text_col, order_col).where(~F.col("is_dup")).drop("is_dup", "first_key")
