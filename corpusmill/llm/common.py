"""Plumbing shared by the training-data operators.

Operators never keep state on one machine: what must outlive a stage goes to the
folder named by ``spark.checkpoint.dir``, which every executor can read again after
another one is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusmill.storage import checkpoint, checkpoint_dir  # noqa: F401  operators take both from here

#: Text bytes that one numpy step works on; bounds the memory of a Python worker.
SLICE_BYTES = 4 << 20
#: A side of a join is broadcast only if its measured size is under this.
BROADCAST_BYTES = 32 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_type(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(f"`{name}`").cast(dtype)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): ids of whatever type they are, texts as strings."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), as_type(docs, text_col, "string").alias("text"))


def with_id(rows: DataFrame, rest: str) -> StructType:
    """A schema of the id, of the type that it has in ``rows``, and of ``rest``."""
    return StructType([StructField("id", rows.schema["id"].dataType), *StructType.fromDDL(rest).fields])


def fits_broadcast(rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * row_bytes <= limit


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df``, of a counted number of rows, broadcast if that fits; else the join is left to shuffle."""
    return F.broadcast(df) if fits_broadcast(rows, row_bytes) else df


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of ``batch`` of about ``limit`` bytes of text, at least one row each."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    start = 0
    for end in [*cuts.tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def replace_texts(docs: DataFrame, text_col: str, chars_col: str, change: Callable[[pa.Array], dict[int, str | None]]) -> DataFrame:
    """The rows of ``docs`` with changed texts; those that ``change`` maps to None go.

    ``change`` gets the texts of a slice of rows and returns the new ones by place. Columns are
    taken by place, so their names may clash with anything.
    """
    names = [f.name for f in docs.schema]
    at = names.index(text_col)
    sized = names.index(chars_col) if chars_col in names and docs.schema[chars_col].dataType.typeName() in ("integer", "long") else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                changed = change(batch.column(at))
                if changed:
                    columns = batch.columns
                    texts = columns[at].to_pylist()
                    for r, text in changed.items():
                        texts[r] = text
                    if sized >= 0:
                        counts = columns[sized].to_pylist()
                        for r, text in changed.items():
                            counts[r] = None if text is None else len(text)
                        columns[sized] = pa.array(counts, columns[sized].type)
                    columns[at] = pa.array(texts, columns[at].type)
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                    gone = [r for r, text in changed.items() if text is None]
                    if gone:
                        keep = np.ones(batch.num_rows, bool)
                        keep[gone] = False
                        batch = batch.filter(pa.array(keep))
                yield batch

    return docs.mapInArrow(run, docs.schema)


#: Word characters: ASCII letters and digits, and what is not ASCII but for the marks below.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: The same words as a regular expression over lower-case text, for small brute-force versions.
WORD_PATTERN = "[0-9A-Za-z\x80-\x9f\xc0-\u1fff\u2080-\u2fff\u3040-\U0010ffff]+"
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once.
_BLOCK = 1 << 20


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(n, base, np.uint64)
        table[0] = 1
        tables.append(np.cumprod(table, dtype=np.uint64))
    return tables[0], tables[1]


_UP, _DOWN = _power_tables(_BLOCK + 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, in order and apart from each other: equal bytes have equal hashes, wherever they stand.

    Spans are taken together in blocks of a fixed size, and a longer span by pieces, so memory is that of a block.
    """
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        to = int(np.searchsorted(ends, ends.dtype.type(min(base + _BLOCK, int(ends[-1]))), side="right"))
        if to <= k:
            total = 0
            for a in range(base, int(ends[k]), _BLOCK):
                piece = data[a : min(a + _BLOCK, int(ends[k]))]
                total += int(((piece + np.uint64(1)) * _UP[: len(piece)]).sum(dtype=np.uint64)) * pow(_BASE, a - base, 1 << 64)
            out[k] = total % (1 << 64)
            k += 1
            continue
        piece = data[base : int(ends[to - 1])]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece + np.uint64(1)) * _UP[: len(piece)], out=sums[1:])
        first = starts[k:to] - base
        out[k:to] = (sums[ends[k:to] - base] - sums[first]) * _DOWN[first]
        k = to
    return mix(out)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser: every input bit moves every output bit."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _places(mask: np.ndarray) -> np.ndarray:
    """Where ``mask`` is set, in the narrowest integers."""
    kind = np.int32 if len(mask) < 1 << 31 else np.int64
    return np.concatenate([np.zeros(0, kind), *((np.flatnonzero(mask[a : a + _BLOCK]) + a).astype(kind) for a in range(0, len(mask), _BLOCK))])


class Words:
    """The lower-case words of a column of texts, found by a few numpy passes over its bytes.

    ``data`` holds the lower-case bytes, ``starts`` and ``ends`` the words' byte places in it,
    ``mask`` whether each byte is in a word, ``rows`` for each text the range of its words,
    ``bounds`` the range of its bytes. Null and
    empty texts have no words. All of it takes about 6 bytes for each byte of text. Lower-casing maps single characters to single characters, so
    counted characters agree with the original text.
    """

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
        bounds = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
        raw = lower.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.data, self.bounds = data, bounds - bounds[0]
        mask = _WORD[data]
        for a in range(0, len(data), _BLOCK):
            for lead, seconds, size in ((0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3), (0xC2, range(0xA0, 0xC0), 2)):
                at = np.flatnonzero(data[a : a + _BLOCK] == lead) + a
                at = at[np.isin(data[at + 1], list(seconds))]
                for k in range(size):
                    mask[at + k] = False
        self.mask = mask
        start, end = mask.copy(), mask.copy()
        start[1:] &= ~mask[:-1]
        end[:-1] &= ~mask[1:]
        first = self.bounds[:-1][np.diff(self.bounds) > 0]
        start[first] = mask[first]
        end[first[1:] - 1] = mask[first[1:] - 1]
        self.starts, self.ends = _places(start), _places(end)
        self.ends += 1
        self.rows = np.searchsorted(self.starts, self.bounds.astype(self.starts.dtype))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        return span_hashes(self.data, self.starts, self.ends)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1, dtype=np.int32), np.diff(self.rows))
