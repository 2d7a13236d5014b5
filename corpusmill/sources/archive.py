"""Text records of web archives (WET)."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def conversion_records(data: bytes) -> Iterator[tuple[str, str]]:
    """(address, text) of each record of type ``conversion``; an error if the archive is broken."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a record header")
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        try:
            size = int(fields["content-length"])
        except (KeyError, ValueError):
            raise ValueError("a record has no length") from None
        body = data[end + 4 : end + 4 + size]
        if size < 0 or len(body) < size:
            raise ValueError("a record is cut off")
        if fields.get("warc-type") == "conversion":
            yield fields.get("warc-target-uri", ""), body.decode("utf-8", "replace")
        at = end + 4 + size


def read_wet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(url, text) of all conversion records of WET files, compressed or not. A file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for content in frame["content"]:
                data = bytes(content)
                rows = list(conversion_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                yield pd.DataFrame(rows, columns=["url", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "url string, text string")
