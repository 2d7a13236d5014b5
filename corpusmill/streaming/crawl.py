"""The stages over a stream of crawl lines.

Stateless stages are the same column functions. What a batch run knows of earlier documents is kept
in two tables beside the stream: digests of all texts seen, and signatures of all that stayed. A micro-batch is
decided against them and then adds to them, under its own number, so that a repeated one replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusmill.operators import exact, extract, minhash, quality
from corpusmill.schema import Settings
from corpusmill.sources import jsonl
from corpusmill.sources.shards import open_path
from corpusmill.storage import checkpoint


def crawl_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of rows (ok, url, ...) of the lines of files that arrive in a folder."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return jsonl.parse_lines(reader.load(path))


def _stored(spark: SparkSession, folder: str, batch: int, schema: str) -> DataFrame:
    """What earlier batches have written; this batch's own earlier attempt is left out."""
    system, place = open_path(folder)
    if system.get_file_info(place).type.name != "Directory":
        return spark.createDataFrame([], StructType.fromDDL(schema))
    return spark.read.schema(schema + ", batch bigint").parquet(folder).where(F.col("batch") < batch).drop("batch")


def process_batch(rows: DataFrame, batch: int, out_dir: str, settings: Settings = Settings()) -> None:
    """One micro-batch: rows that stay go to ``out_dir/kept``, counters to ``out_dir/counts``."""
    spark = rows.sparkSession

    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={batch}")

    read = checkpoint(rows.withColumn("ord", F.monotonically_increasing_id()))
    docs = extract.prepare(jsonl.good(read), settings)
    docs = docs.withColumn("digest", exact.digest(F.col("text"), settings.exact_level))
    docs = checkpoint(exact.mark_duplicates(docs, settings.exact_level, "ord", "text", "ord"))
    seen = _stored(spark, f"{out_dir}/digests", batch, "digest string")
    firsts = docs.where("text <> '' AND NOT is_dup").join(seen, "digest", "left_anti")
    if settings.run_quality:
        firsts = quality.assess(firsts, adapt_to_script=settings.adapt_to_script)
    else:
        firsts = firsts.withColumn("report", F.lit(None).cast("struct<passed:boolean,script:string>"))
    firsts = checkpoint(firsts)
    passed = firsts.where(F.coalesce("report.passed", F.lit(True)))
    if settings.run_near_dedup:
        known = _stored(spark, f"{out_dir}/signatures", batch, "sig array<bigint>").select((-F.monotonically_increasing_id() - 1).alias("ord"), "sig")
        signed = checkpoint(passed.select("ord", minhash.signature(F.col("text"), settings.num_perm, settings.ngram).alias("sig")))
        # rows that stayed before come first in the order, and are always kept
        # new rows against new and known ones; known ones aren't joined with each other again
        fresh = checkpoint(minhash.similar_pairs(signed.unionByName(known), settings.near_dup_threshold, settings.num_perm, settings.bands, later=signed))
        old = checkpoint(fresh.where("a < 0").select(F.col("b").alias("ord")).distinct())
        left = fresh.where("a >= 0").select("a", "b").join(old.withColumnRenamed("ord", "a"), "a", "left_anti").join(old.withColumnRenamed("ord", "b"), "b", "left_anti").select("a", "b")
        gone = old.union(minhash.greedy(left).where("NOT kept").select("k"))
        passed = checkpoint(passed.join(gone, "ord", "left_anti"))
        put(signed.join(passed.select("ord"), "ord", "left_semi").select("sig"), "signatures")
    put(docs.where("text <> ''").select("digest").distinct(), "digests")
    put(passed.select("ord", "url", "title", "text", "crawled_at", F.col("report.script").alias("language")), "kept")
    put(read.agg(F.count("*").alias("seen"), F.count_if(~F.col("ok")).alias("malformed")).crossJoin(passed.agg(F.count("*").alias("kept"))), "counts")


def start(spark: SparkSession, path: str, out_dir: str, checkpoint_path: str, settings: Settings = Settings(), files_per_batch: int | None = None, once: bool = False) -> StreamingQuery:
    """Runs the stages over a folder of crawl files; ``once`` takes what is there and ends."""
    writer = crawl_stream(spark, path, files_per_batch).writeStream.option("checkpointLocation", checkpoint_path)
    writer = writer.foreachBatch(lambda rows, batch: process_batch(rows, batch, out_dir, settings))
    return (writer.trigger(availableNow=True) if once else writer).start()
