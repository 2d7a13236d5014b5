"""One query for each operator, over its whole table and with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, decontaminate, langid, quality, secrets, sharding, simhash, tokencounts, urlfilter, warc
from corpusmill.storage import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op5_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.normalised_pages(_table(spark, sf_dir, "pages"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.every_limit(tokencounts.histogram(_table(spark, sf_dir, "documents")))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_quality_rules, op3_url_filter, op4_secret_scan, op5_warc_normalise, op6_simhash_dedup, op7_decontaminate, op8_language_id, op9_token_counts, op10_shards)
}

ORACLE_SQL = {"op3_url_filter": urlfilter.oracle_sql()}
