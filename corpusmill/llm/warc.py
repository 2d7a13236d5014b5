"""WARC files: whole-file gzip streams rewritten with one gzip member for each record, and an index.

A monolithic stream can only be read from its start. ``normalise`` inflates it once, piece by
piece, finds the records by their content lengths, deflates each into a member of its own, and
writes beside the new file a sidecar index with a line for each record: offset, length, type, id
and address. From then on any record is one ranged read. A file is one task's work and is never held in
memory; of a record, its compressed bytes are, so that a broken one leaves nothing behind; files go to a temporary name first and are renamed when they are
complete, so that a repeated or doubled task does no harm.

Paths are read and written through ``pyarrow.fs``, so they may be on any shared file system that it knows.

Defined results: an empty stream has no records and an empty index; of a stream that is broken off
or isn't a WARC, the complete records are kept, a row of its index table says in ``error`` what
was wrong, and nothing is lost silently; after a record with a bad header, reading goes on at the next record;
headers may be of any length; streams that have several members already
are read alike; records may be empty or very long and repeat each other; names of header
fields are taken in any case; different files of one name would overwrite each other, so they are an error. In ``pack``, null
addresses have no address field, null bodies are empty records, ids of any type are written as text and null ones not at all; an
empty table gives no files; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import as_type, checkpoint, scratch_path

CHUNK = 1 << 20
LEVEL = 6
#: How each record begins.
MARK = b"WARC/"
INDEX_SCHEMA = "file string, record int, offset long, length long, type string, record_id string, uri string, payload_bytes long, payload_sha1 string, error string"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class Inflated:
    """The bytes of a gzip stream, of one member or many, by pieces."""

    def __init__(self, source: BinaryIO):
        self.source, self.inflater, self.rest = source, zlib.decompressobj(31), b""
        self.buffer, self.ended = bytearray(), False

    def more(self) -> bool:
        """Adds to the buffer; False at the end. Raises if the stream ends within a member."""
        while not self.ended:
            data = self.rest or self.source.read(CHUNK)
            self.rest = b""
            if not data:
                self.ended = True
                if self.started:
                    raise EOFError("the gzip stream is broken off")
                return False
            self.started = True
            out = self.inflater.decompress(data, CHUNK)
            if self.inflater.eof:
                self.rest = self.inflater.unused_data
                self.inflater, self.started = zlib.decompressobj(31), False
            else:
                self.rest = self.inflater.unconsumed_tail
            if out:
                self.buffer += out
                return True
        return False

    started = False

    def take(self, size: int) -> Iterator[bytes]:
        """Exactly ``size`` bytes, by pieces."""
        while size:
            if not self.buffer and not self.more():
                raise EOFError("the stream ends within a record")
            piece = bytes(self.buffer[:size])
            del self.buffer[: len(piece)]
            size -= len(piece)
            yield piece

    def header(self) -> bytes | None:
        """Up to and with the next empty line, however far that is; None at the end. Raises if no record begins here."""
        at = 0
        while True:
            while self.buffer[:2] == b"\r\n":  # between records
                del self.buffer[:2]
                at = 0
            if len(self.buffer) >= len(MARK) and not self.buffer.startswith(MARK):
                raise ValueError("not a WARC record")
            end = self.buffer.find(b"\r\n\r\n", max(0, at - 3))
            if end >= 0:
                head = bytes(self.buffer[: end + 4])
                del self.buffer[: end + 4]
                return head
            at = len(self.buffer)
            if not self.more():
                if self.buffer.strip():
                    raise EOFError("the stream ends within a header")
                return None

    def skip(self) -> bool:
        """Goes on to where the next record seems to begin, behind an empty line; False if there is none."""
        while len(self.buffer) < len(MARK) and self.more():
            pass
        if self.buffer.startswith(MARK):
            return True
        mark = b"\r\n\r\n" + MARK
        while (at := self.buffer.find(mark)) < 0:
            del self.buffer[: -len(mark)]
            if not self.more():
                return False
        del self.buffer[: at + 4]
        return True


def fields(head: bytes) -> dict[str, str]:
    """A record header's fields, by lower-case name; of repeated ones the last."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith(MARK.decode()):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def rewrite(source: BinaryIO, target: BinaryIO, name: str, level: int = LEVEL) -> Iterator[dict]:
    """Writes each record of ``source`` to ``target`` as a member; yields the index row of each, and of an error."""
    stream, offset, number = Inflated(source), 0, 0
    blank = dict.fromkeys(("offset", "length", "type", "record_id", "uri", "payload_bytes", "payload_sha1"))
    while True:
        member: list[bytes] = []
        try:
            head = stream.header()
            if head is None:
                return
            known = fields(head)
            size = int(known["content-length"])
            if size < 0:
                raise ValueError("negative content length")
            deflater, digest = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
            member.append(deflater.compress(head))
            for piece in stream.take(size):
                digest.update(piece)
                member.append(deflater.compress(piece))
            member += [deflater.compress(b"\r\n\r\n"), deflater.flush()]
        except (EOFError, ValueError, KeyError, zlib.error) as e:
            yield {"file": name, "record": number, **blank, "error": f"{type(e).__name__}: {e}"}
            number += 1
            try:
                if not isinstance(e, (EOFError, zlib.error)) and stream.skip():
                    continue
            except (EOFError, zlib.error) as broken:
                yield {"file": name, "record": number, **blank, "error": f"{type(broken).__name__}: {broken}"}
            return
        # only compressed bytes of one record are held, so that a broken one leaves nothing behind
        length = 0
        for piece in member:
            target.write(piece)
            length += len(piece)
        yield {
            "file": name, "record": number, "offset": offset, "length": length, "type": known.get("warc-type"), "record_id": known.get("warc-record-id"),
            "uri": known.get("warc-target-uri"), "payload_bytes": size, "payload_sha1": digest.hexdigest(), "error": None,
        }
        offset += length
        number += 1


def _index_line(row: dict) -> bytes:
    return ("\t".join(str(row[k] if row[k] is not None else "-").replace("\t", "%09") for k in ("offset", "length", "type", "record_id", "uri")) + "\n").encode()


def normalise_file(path: str, folder: str, level: int = LEVEL) -> Iterator[dict]:
    """Rewrites one file into ``folder``, with its index beside it; yields the index rows when both are complete."""
    system, place = open_path(path)
    out_system, out = open_path(folder)
    name = place.rsplit("/", 1)[-1]
    out_system.create_dir(out, recursive=True)
    temporary = f"{out}/.{name}.{uuid.uuid4().hex}"
    with system.open_input_stream(place, compression=None) as source, out_system.open_output_stream(temporary, compression=None) as target, out_system.open_output_stream(temporary + ".idx", compression=None) as index:
        for row in rewrite(source, target, name, level):
            if row["error"] is None:
                index.write(_index_line(row))
            yield row
    out_system.move(temporary, f"{out}/{name}")
    out_system.move(temporary + ".idx", f"{out}/{name}.idx")


def read_record(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """A record's fields and payload by one ranged read of a normalised file."""
    system, place = open_path(path)
    with system.open_input_file(place) as f:
        f.seek(offset)
        data = zlib.decompress(f.read(length), 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    known = fields(head + b"\r\n")
    return known, rest[: int(known["content-length"])]


def normalise(paths: DataFrame, folder: str, path_col: str = "path") -> DataFrame:
    """Normalises every file named in ``paths`` into ``folder``; returns the rows of all the indexes.

    Different files of the same name are an error. The index table is computed once and kept in the shared folder.
    """
    names = checkpoint(paths.select(as_type(paths, path_col, "string").alias("path")).where("path IS NOT NULL").distinct())
    clash = names.groupBy(F.substring_index("path", "/", -1).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1").orderBy("name").first()
    if clash:
        raise ValueError(f"{clash['n']} files are named {clash['name']}, {clash['path']} among them")
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]]) for f in INDEX_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for row in normalise_file(path, folder):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    # a file is a task: round-robin, since hashes of a few paths would leave executors idle
    files = max(1, names.count())
    return checkpoint(names.repartition(files).mapInArrow(run, INDEX_SCHEMA))


def pack(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", level: int = 1) -> DataFrame:
    """Writes pages as WARC files, each one monolithic gzip stream for each partition; returns (path)."""
    rows = pages.select(as_type(pages, id_col, "string").alias("id"), as_type(pages, url_col, "string").alias("url"), as_type(pages, body_col, "string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, out = open_path(folder)
        system.create_dir(out, recursive=True)
        name = f"pages-{TaskContext.get().partitionId():06d}.warc.gz"
        temporary, some = f"{out}/.{name}.{uuid.uuid4().hex}", False
        deflater = zlib.compressobj(level, zlib.DEFLATED, 31)
        with system.open_output_stream(temporary, compression=None) as target:
            for batch in batches:
                for key, url, body in zip(*(c.to_pylist() for c in batch.columns)):
                    some = True
                    data = (body or "").encode()
                    target.write(deflater.compress(record_header(key, url, len(data)) + data + b"\r\n\r\n"))
            target.write(deflater.flush())
        if some:
            system.move(temporary, f"{out}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})
        else:
            system.delete_file(temporary)

    return checkpoint(rows.mapInArrow(run, "path string"))


def record_header(key: str | None, url: str | None, size: int) -> bytes:
    lines = ["WARC/1.0", "WARC-Type: resource", "WARC-Record-ID: <urn:page" + ("" if key is None else ":" + key.replace("\r", "%0D").replace("\n", "%0A")) + ">", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
    if url is not None:
        lines.insert(2, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def normalised_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Pages packed into monolithic files and normalised: the index, with the page's id.

    The monolithic files go afterwards; the normalised ones and their indexes stay in ``folder``.
    """
    spark: SparkSession = pages.sparkSession
    raw, folder = scratch_path(spark, "warc-monolithic"), folder or scratch_path(spark, "warc")
    index = normalise(pack(pages, raw, id_col, url_col, body_col), folder)
    system, place = open_path(raw)
    if system.get_file_info(place).type == fs.FileType.Directory:
        system.delete_dir(place)
    # as it was, but that line ends in ids of text stay escaped
    known = F.when(F.startswith("record_id", F.lit("<urn:page:")), F.regexp_extract("record_id", "^<urn:page:(.*)>$", 1))
    page = known.try_cast(pages.schema[id_col].dataType)
    return index.select(page.alias(id_col), "uri", "file", "record", "offset", "length", "type", "payload_bytes", "payload_sha1", "error")
