"""Datasets of shards of an exact number of records, read through their manifest.

The manifest is written last, so it marks a complete dataset. Rows are numbered without passing
through one task: partitions are sorted, counted, and numbered from the counts before them.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.storage import checkpoint

VERSION = 1


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    import os

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def with_index(docs: DataFrame, *order: str) -> DataFrame:
    """Adds ``idx``: 0, 1, 2, ... in the order of some columns. The counts, one for each partition, go to the driver."""
    placed = checkpoint(docs.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"), *(F.col(f"`{c}`") for c in docs.columns)))
    counts = sorted((r["_p"], r["n"], r["first"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("first")).collect())
    if not counts:
        return placed.withColumn("idx", F.lit(0).cast("long")).drop("_p", "_m")
    starts, total = [], 0
    for p, n, first in counts:
        starts.append((p, total - first))
        total += n
    # a row for each partition of the sort
    table = docs.sparkSession.createDataFrame(starts, "_p int, _shift long")
    return placed.join(F.broadcast(table), "_p").withColumn("idx", F.col("_m") + F.col("_shift")).drop("_p", "_m", "_shift")


def shard_assignment(docs: DataFrame, shard_size: int = 10_000, order_col: str = "doc_id") -> DataFrame:
    """Adds ``idx`` and ``shard``."""
    if shard_size < 1:
        raise ValueError("shard_size must be at least 1")
    return with_index(docs, order_col).withColumn("shard", F.floor(F.col("idx") / shard_size).cast("int"))


def record_json(columns: list[str], **more) -> F.Column:
    """A record as JSON text, nulls included."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"})


def write_jsonl(docs: DataFrame, out_dir: str, shard_size: int = 10_000, order_col: str = "doc_id", prefix: str = "shard", compress: bool = True, columns: list[str] | None = None) -> dict:
    """``shard-00000.jsonl.gz`` and so on, each of exactly ``shard_size`` records but the last; returns the manifest."""
    if shard_size < 1:
        raise ValueError("shard_size must be at least 1")
    names = columns or [c for c in docs.columns if c != order_col or c in ("doc_id", "url")]
    rows = shard_assignment(docs, shard_size, order_col).select("shard", "idx", record_json(names).alias("line"))
    suffix = ".jsonl.gz" if compress else ".jsonl"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = open_path(out_dir)
        current, sink, temporary, count = None, None, "", 0

        def finish() -> pd.DataFrame:
            sink.close()
            if raw is not sink:
                raw.close()
            name = f"{prefix}-{current:05d}{suffix}"
            size = system.get_file_info(temporary).size
            system.move(temporary, f"{folder}/{name}")
            return pd.DataFrame({"path": [name], "records": [count], "bytes": [size]})

        raw = None
        for frame in batches:
            for shard, line in zip(frame["shard"], frame["line"]):
                if shard != current:
                    if current is not None:
                        yield finish()
                    current, count = shard, 0
                    temporary = f"{folder}/.{prefix}-{shard:05d}.{uuid.uuid4().hex}"
                    raw = system.open_output_stream(temporary, compression=None)
                    sink = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if compress else raw
                sink.write(line.encode() + b"\n")
                count += 1
        if current is not None:
            yield finish()

    system, folder = open_path(out_dir)
    system.create_dir(folder, recursive=True)
    # a shard is whole in one partition, and a partition writes its shards one after the other
    ordered = rows.repartition("shard").sortWithinPartitions("shard", "idx")
    written = checkpoint(ordered.mapInPandas(run, "path string, records long, bytes long"))
    return _manifest(written, out_dir, "jsonl", shard_size, {})


def write_parquet(docs: DataFrame, out_dir: str, shard_size: int = 10_000, order_col: str = "doc_id", compression: str = "zstd") -> dict:
    """Parquet shards of exactly ``shard_size`` records, all with one schema; returns the manifest."""
    names = docs.columns
    rows = shard_assignment(docs, shard_size, order_col)
    rows.repartition("shard").sortWithinPartitions("shard", "idx").select("shard", *(F.col(f"`{c}`") for c in names)).write.mode("overwrite").option("compression", compression).partitionBy("shard").parquet(out_dir)
    counts = rows.groupBy("shard").agg(F.count("*").alias("records"))
    system, folder = open_path(out_dir)
    sizes = {}
    for info in system.get_file_info(fs.FileSelector(folder, recursive=True)):
        if info.path.endswith(".parquet"):
            part = info.path[len(folder) :].strip("/").split("/")[0]
            sizes[int(part.partition("=")[2])] = (info.path[len(folder) :].strip("/"), info.size)
    shards = [{"path": sizes[r["shard"]][0], "records": r["records"], "bytes": sizes[r["shard"]][1]} for r in counts.orderBy("shard").collect()]
    return _store(out_dir, {"format": "parquet", "compression": compression}, shards, shard_size)


def _manifest(written: DataFrame, out_dir: str, kind: str, shard_size: int, more: dict) -> dict:
    shards = [r.asDict() for r in written.orderBy("path").collect()]  # a row for each shard
    return _store(out_dir, {"format": kind} | more, shards, shard_size)


def _store(out_dir: str, head: dict, shards: list[dict], shard_size: int) -> dict:
    manifest = head | {"total_records": sum(s["records"] for s in shards), "shard_count": len(shards), "shard_size": shard_size, "shards": shards, "version": VERSION}
    write_json(f"{out_dir}/manifest.json", manifest)
    return manifest


def write_json(path: str, value: dict) -> None:
    system, place = open_path(path)
    with system.open_output_stream(place, compression=None) as f:
        f.write((json.dumps(value, indent=2, ensure_ascii=False) + "\n").encode())


def read_manifest(out_dir: str) -> dict:
    system, folder = open_path(out_dir)
    if system.get_file_info(f"{folder}/manifest.json").type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{out_dir} has no manifest")
    with system.open_input_stream(f"{folder}/manifest.json", compression=None) as f:
        return json.loads(f.read())


def read_shards(spark: SparkSession, out_dir: str, schema: str | None = None) -> DataFrame:
    """The records of the shards that the manifest lists, and of no other file; in order within each shard."""
    manifest = read_manifest(out_dir)
    system, folder = open_path(out_dir)
    paths = [f"{folder}/{s['path']}" for s in manifest["shards"]]
    for info in system.get_file_info(paths):
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(info.path)
    prefix = "" if isinstance(system, fs.LocalFileSystem) else out_dir[: len(out_dir) - len(folder)]
    if not paths:
        return spark.createDataFrame([], schema or "doc_id string, text string")
    reader = spark.read.schema(schema) if schema else spark.read
    places = [prefix + p for p in paths]
    return reader.parquet(*places) if manifest["format"] == "parquet" else reader.json(places)
