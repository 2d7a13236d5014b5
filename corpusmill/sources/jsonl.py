"""Crawl lines: one JSON object a line, each bad line counted and none fatal."""

from __future__ import annotations

import json
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Kept as JSON text, since their members are free.
_FREE = ("quality", "signatures", "meta")
_TEXTS = ("url", "text", "html", "title", "language", "crawled_at")
FIELDS = "ok boolean, url string, text string, html string, title string, language string, crawled_at string, quality string, signatures string, embedding array<float>, meta string"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def decode_line(line: str) -> dict:
    """The known keys of a line, with ``ok`` false if it isn't an object that has a text for an address.

    A line counts as malformed, too, if a field has a type that would break a later stage.
    """
    bad = dict.fromkeys(_NAMES) | {"ok": False}
    try:
        found = json.loads(line)
    except ValueError:
        return bad
    if not isinstance(found, dict) or not isinstance(found.get("url"), str):
        return bad
    if any(not isinstance(found.get(k), str | None) for k in _TEXTS):
        return bad
    out = dict.fromkeys(_NAMES) | {"ok": True} | {k: found.get(k) for k in _TEXTS}
    vector = found.get("embedding")
    if vector is not None:
        try:
            out["embedding"] = [float(x) for x in vector]
        except (TypeError, ValueError):
            return bad
    for k in _FREE:
        out[k] = None if found.get(k) is None else json.dumps(found[k], ensure_ascii=False)
    # lone surrogates can be written in JSON but not in UTF-8
    return {k: v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for k, v in out.items()}


def decode(line: Column) -> Column:
    """struct<ok, ...> of a column of lines."""

    @pandas_udf(FIELDS)
    def run(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_line(x) for x in lines], columns=_NAMES)

    return run(line)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Rows (value, ...) to rows of records with ``ok``; blank lines are skipped and not counted."""
    rest = [c for c in lines.columns if c != "value"]
    stripped = lines.withColumn("value", F.regexp_replace("value", r"^[\s\x{85}\p{Z}\x{1c}-\x{1f}]+|[\s\x{85}\p{Z}\x{1c}-\x{1f}]+$", "")).where("value <> ''")
    return stripped.select(*rest, decode(F.col("value")).alias("_d")).select(*rest, "_d.*")


def read_crawl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines, good and malformed, in rows (ord, ok, url, ...). ``ord`` follows files by name and lines by place.

    Lines are numbered within their files by the bytes before them where a file is split, so nothing has to
    pass through one task: the number is the file's rank and the line's place in it, in one struct.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    # within a split, lines come in order and their ids rise
    placed = raw.withColumn("_m", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return parse_lines(placed.select("value", F.struct(F.col("_f").alias("file"), F.col("_b").alias("block"), F.col("_m").alias("line")).alias("ord")))


def good(records: DataFrame) -> DataFrame:
    return records.where("ok").drop("ok")


def count_malformed(records: DataFrame) -> int:
    return records.where(~F.col("ok")).count()


def read_html_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(url, html) of whole files; bytes that aren't UTF-8 become U+FFFD."""

    @pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), text("content").alias("html"))
