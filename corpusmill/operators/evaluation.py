"""How well near-duplicates are found, on a corpus whose duplicates are known; and straight lines through measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import minhash

#: Every so many families there is one with a variant.
VARIANT_EVERY = 4
#: Words at the end of a variant that stand in reverse order.
REVERSED = 8


def labelled_corpus(spark: SparkSession, documents: int, words: int = 160) -> DataFrame:
    """(ord, text, family, expected_duplicate) of ``documents`` texts of unlike words; a variant comes right after its original.

    Of five documents, four begin families and the last is a variant of the fourth.
    """
    five = VARIANT_EVERY + 1
    rows = spark.range(documents).withColumnRenamed("id", "ord").withColumn("expected_duplicate", F.col("ord") % five == VARIANT_EVERY)
    placed = rows.withColumn("family", F.col("ord") - F.floor((F.col("ord") + 1) / five))
    own = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: F.concat(F.lit("w"), F.substring(F.md5(F.concat_ws("-", F.col("family").cast("string"), k.cast("string"))), 1, 6)))
    turned = F.concat(F.slice(own, 1, words - REVERSED), F.reverse(F.slice(own, words - REVERSED + 1, REVERSED)))
    return placed.select("ord", F.array_join(F.when(F.col("expected_duplicate"), turned).otherwise(own), " ").alias("text"), "family", "expected_duplicate")


def dedup_scores(labelled: DataFrame, **settings) -> DataFrame:
    """One row (documents, expected, true_positive, false_positive, false_negative, precision, recall) of near-dedup on labelled texts."""
    found = minhash.deduplicate(labelled.select("ord", "text"), order_col="ord", **settings).select("ord", "is_dup").join(labelled.select("ord", "expected_duplicate"), "ord")
    hit, wanted = F.col("is_dup"), F.col("expected_duplicate")
    counts = {"documents": F.lit(True), "expected": wanted, "true_positive": hit & wanted, "false_positive": hit & ~wanted, "false_negative": ~hit & wanted}
    sums = found.agg(*(F.count_if(v).alias(k) for k, v in counts.items()))

    def share(other: str) -> Column:
        both = F.col("true_positive") + F.col(other)
        return F.when(both > 0, F.col("true_positive") / both).otherwise(F.lit(1.0))

    return sums.withColumn("precision", share("false_positive")).withColumn("recall", share("false_negative"))


def linear_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row (slope, intercept) of the least-squares line y = slope * x + intercept; nulls if x is the same everywhere."""
    return points.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))
