"""Token counts for every context limit, from one exact histogram of encoded lengths.

Documents are encoded once and aggregated to the number of documents of each length. Running
sums over that histogram from its long end answer totals, quantiles and truncated totals for
every limit; the corpus isn't looked at again. The histogram has a row for each different
length, so it is bounded by the longest document and not by their number.

Defined results: rows whose text is null are not documents and are not counted; an empty text
is a document of 0 tokens; texts are encoded whole; repeated rows count each; an empty table
has an empty histogram; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import bpe


def histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(n_tokens long, documents long): how many documents have each length."""
    return bpe.lengths(docs, text_col, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("documents"))


def every_limit(counts: DataFrame) -> DataFrame:
    """For each length in the histogram, taken as the limit of a context:

    documents            of just this length
    documents_over       longer than it
    documents_within     no longer
    quantile             share of documents no longer
    tokens_within        tokens of the documents no longer
    truncated_tokens     tokens left when every document is cut at the limit
    total_tokens         of the whole corpus, uncut
    """
    # one partition: the rows are lengths, bounded by the longest document
    above = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    tokens = F.col("n_tokens") * F.col("documents")
    over, over_tokens = F.coalesce(F.sum("documents").over(above), F.lit(0)), F.coalesce(F.sum(tokens).over(above), F.lit(0))
    out = counts.select("n_tokens", "documents", over.alias("documents_over"), over_tokens.alias("__over"), F.sum("documents").over(whole).alias("__all"), F.sum(tokens).over(whole).alias("total_tokens"))
    within = F.col("__all") - F.col("documents_over")
    return out.select(
        F.col("n_tokens").alias("context_limit"),
        "documents",
        "documents_over",
        within.alias("documents_within"),
        (within / F.col("__all")).alias("quantile"),
        (F.col("total_tokens") - F.col("__over")).alias("tokens_within"),
        (F.col("total_tokens") - F.col("__over") + F.col("n_tokens") * F.col("documents_over")).alias("truncated_tokens"),
        "total_tokens",
    )


def at_limits(counts: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, documents_within, documents_over, truncated_tokens) for any limits, in the histogram or not.

    Limits are put between the histogram's lengths, and the running sums are read off there.
    """
    asked = counts.sparkSession.createDataFrame([(int(x), 0, True) for x in sorted(set(limits))], "n_tokens long, documents long, asked boolean")
    rows = asked.unionByName(counts.select("n_tokens", "documents", F.lit(False).alias("asked")))
    # one partition, as above; a limit comes after the length that equals it
    within, whole = Window.orderBy("n_tokens", "asked").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    tokens = F.col("n_tokens") * F.col("documents") * F.when(F.col("asked"), 0).otherwise(1)
    sums = rows.select("n_tokens", "asked", F.sum("documents").over(within).alias("documents_within"), F.sum(tokens).over(within).alias("__tokens"), F.sum("documents").over(whole).alias("__all"))
    over = F.col("__all") - F.col("documents_within")
    return sums.where("asked").select(F.col("n_tokens").alias("context_limit"), "documents_within", over.alias("documents_over"), (F.col("__tokens") + F.col("n_tokens") * over).alias("truncated_tokens"))


def quantiles(counts: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents don't exceed; null if there are none."""
    asked = counts.sparkSession.createDataFrame([(float(x), None) for x in sorted(set(shares))], "share double, n_tokens long")
    known = every_limit(counts).select(F.col("quantile").alias("share"), F.col("context_limit").alias("n_tokens"))
    rows = asked.withColumn("asked", F.lit(True)).unionByName(known.withColumn("asked", F.lit(False)))
    # from the largest share down, a length before a share that equals it: the last length met is the smallest that is enough
    downwards = Window.orderBy(F.desc("share"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("share", "asked", F.min("n_tokens").over(downwards).alias("n_tokens")).where("asked").select("share", "n_tokens")
