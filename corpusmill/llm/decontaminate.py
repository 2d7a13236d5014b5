"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of documents, and all of its words are indexed: a word's symbol is its
rank in the shard's own vocabulary, so the index knows nothing of any test set. Texts end with
a separator. The shard's suffix array is made by prefix doubling, its Burrows-Wheeler transform becomes
a wavelet matrix, and all test phrases are searched backwards at once through the matrix's ranks.
Occurrences are located by walking to sampled suffix positions, and runs of overlapping or touching occurrences
become one removal span.

``find_leaks`` and ``remove_leaks`` index each shard where its texts are and search it at once. ``build_index``
stores the indexes instead, so that ``search_index`` can search any number of test sets later without the texts.

A phrase is each run of ``n`` words of a test item; an item of fewer words, but ``least`` at
least, is one phrase; shorter items are not searched. Words are compared in lower case and
whatever stands between them is ignored. Words are told apart by 64-bit hashes.

Defined results: null and empty texts and null test texts hold no phrase; texts are searched
whole, however long (a text of more than ``SHARD_WORDS`` words is several shards, which overlap by a phrase); repeated
rows are each searched and each reported; equal phrases of several items are reported for all of them; an empty table
on either side gives no spans; ids of any type, null ones too, are passed through; other columns are not looked at by
``find_leaks`` and are kept as they are, whatever their names, by ``remove_leaks``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from corpusmill.llm.common import BROADCAST_BYTES, Words, as_type, id_and_text, replace_texts, slices, with_id

PHRASE_WORDS = 8
LEAST_WORDS = 5
#: Words of one text that are indexed at once.
SHARD_WORDS = 1 << 20
#: Every so many places of the text, the suffix array keeps its entry.
SAMPLE_STEP = 16


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers, by prefix doubling on the suffixes still tied.

    Ties must end before the end of the sequence, as they do when separators are all different.
    """
    n = len(seq)
    order = np.argsort(seq)
    key = seq[order]
    rank = np.empty(n, np.int64)
    width = 1
    pos, base = order, np.zeros(n, np.int64)
    while len(pos):
        place = np.arange(len(pos))
        start = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(start, place, 0))
        parent = np.maximum.accumulate(np.where(np.r_[True, base[1:] != base[:-1]], place, 0))
        rank[pos] = base + group - parent
        pos = pos[~(start & np.r_[start[1:], True])]
        base = rank[pos]
        key = base * n + rank[np.minimum(pos + width, n - 1)]
        order = np.argsort(key)
        pos, base, key = pos[order], base[order], key[order]
        width *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    return array


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence: one bit plane a level, zeros before ones."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (seq >> shift & 1).astype(bool)
            zeros = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(~ones, out=zeros[1:])
            self.levels.append((shift, zeros, int(zeros[-1])))
            seq = np.concatenate([seq[~ones], seq[ones]])

    def place(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        for shift, zeros, total in self.levels:
            before = zeros[end]
            end = np.where(symbol >> shift & 1, total + end - before, before)
        return end

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each ``symbol`` before each ``end``."""
        return self.place(symbol, end) - self.place(symbol, np.zeros_like(end))


class FMIndex:
    """Over symbols 1 and up, in stretches each ended by a 0."""

    def __init__(self, seq: np.ndarray, symbols: int):
        ends = seq == 0
        array = suffix_array(np.where(ends, np.cumsum(ends) - 1, seq + ends.sum()))
        before = seq[array - 1]  # before the first suffix stands the last separator
        # walks stop at a stretch's first symbol, so they never step over a separator
        sampled = (array % SAMPLE_STEP == 0) | (before == 0)
        self._open(before, symbols, sampled, array[sampled])

    def _open(self, bwt: np.ndarray, symbols: int, sampled: np.ndarray, samples: np.ndarray) -> None:
        self.bwt, self.symbols, self.sampled, self.samples = bwt, symbols, sampled, samples
        self.matrix = WaveletMatrix(bwt, symbols)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=symbols))])
        self.which = np.cumsum(sampled, dtype=np.int32) - 1

    @classmethod
    def stored(cls, bwt: np.ndarray, symbols: int, sampled: np.ndarray, samples: np.ndarray) -> FMIndex:
        """An index of what ``bwt``, ``symbols``, ``sampled`` and ``samples`` of another one were."""
        index = cls.__new__(cls)
        index._open(bwt, symbols, sampled, samples)
        return index

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.starts[symbol] + self.matrix.rank(symbol, row)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the phrases found and their ranges of suffix rows. Phrases are padded behind with 0."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            at = np.flatnonzero(lengths[which] > k)
            symbol = phrases[which[at], k]
            low[at], high[at] = self.step(symbol, low[at]), self.step(symbol, high[at])
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the sequence at which the suffixes of these rows begin."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(at := np.flatnonzero(~self.sampled[rows])):
            rows[at] = self.step(self.bwt[rows[at]], rows[at])
            steps[at] += 1
        return self.samples[self.which[rows]] + steps


class Phrases:
    """The distinct phrases of test items, as symbols; 0 is kept for separators."""

    def __init__(self, items: pa.Table, n: int, least: int):
        words = Words(items.column(1).combine_chunks() if items.num_rows else pa.array([], pa.string()))
        self.vocabulary, symbols = np.unique(words.hashes(), return_inverse=True)
        self.item_ids = items.column(0).to_pylist()
        counts = np.diff(words.rows)
        sizes = np.minimum(n, counts)
        number = np.where(counts >= max(1, least), counts - sizes + 1, 0)
        owners = np.repeat(np.arange(len(counts)), number)
        first = words.rows[owners] + np.arange(len(owners)) - np.repeat(np.cumsum(number) - number, number)
        padded = np.r_[symbols + 1, np.zeros(n, np.int64)].astype(np.int32)
        found = np.where(np.arange(n) < sizes[owners, None], padded[first[:, None] + np.arange(n)], np.int32(0))
        self.rows, which = np.unique(found, axis=0, return_inverse=True) if len(found) else (found, np.zeros(0, np.int64))
        self.lengths = (self.rows > 0).sum(axis=1)
        # each phrase's items stand together
        pairs = np.unique(np.ravel(which) * len(counts) + owners)
        self.owners = (pairs % max(1, len(counts))).astype(np.int32)
        self.bounds = np.searchsorted(pairs, np.arange(len(self.rows) + 1) * len(counts))

    def items(self, phrase: int) -> list:
        return [self.item_ids[k] for k in self.owners[self.bounds[phrase] : self.bounds[phrase + 1]]]


class Shard:
    """The index of the words of some texts, or of a part of a long one: ``hashes`` of the words and ``row``, each word's text."""

    def __init__(self, hashes: np.ndarray, row: np.ndarray):
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        own = np.cumsum(np.r_[0, row[1:] != row[:-1]])
        place = np.arange(len(hashes)) + own  # a separator stands behind each text
        seq = np.zeros(len(hashes) + int(own[-1]) + 1, np.int64)
        seq[place] = symbols + 1
        self.words = np.full(len(seq), -1, np.int32)
        self.words[place] = np.arange(len(hashes))
        self.index = FMIndex(seq, len(self.vocabulary) + 1)

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all occurrences of phrases, and the phrases' numbers."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(phrases.rows):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, phrases.vocabulary), len(self.vocabulary) - 1)
        symbol = np.r_[0, np.where(self.vocabulary[at] == phrases.vocabulary, at + 1, -1)]
        wanted = symbol[phrases.rows]
        known = np.flatnonzero((wanted >= 0).all(axis=1))
        which, low, high = self.index.search(wanted[known], phrases.lengths[known])
        if not len(which):
            return none
        counts = high - low
        flat = np.repeat(low - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        return self.words[self.index.locate(flat)].astype(np.int64), np.repeat(known[which], counts)


def shards_of(hashes: np.ndarray, row: np.ndarray, n: int) -> Iterator[tuple[int, Shard]]:
    """(first word, index) of the shards that words make: one, but for long texts, whose shards overlap by ``n - 1`` words."""
    a = 0
    while a < len(hashes):
        b = min(len(hashes), a + SHARD_WORDS)
        yield a, Shard(hashes[a:b], row[a:b])
        if b == len(hashes):
            return
        a = b - (n - 1)


def find_in_words(hashes: np.ndarray, row: np.ndarray, shards: Iterable[tuple[int, Shard]], parts: Callable[[], Iterable[Phrases]]) -> tuple[np.ndarray, np.ndarray, dict[int, list]]:
    """The first and the last words of the removal spans, in order, and the items found in each text.

    Every part is searched in the text as it is; the occurrences of all parts are merged at once.
    """
    firsts, lasts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
    for offset, shard in shards:
        for phrases in parts():
            begin, phrase = shard.occurrences(phrases)
            begin = begin + offset
            firsts.append(begin)
            lasts.append(begin + phrases.lengths[phrase] - 1)
            for r, k in set(zip(row[begin].tolist(), phrase.tolist())):
                items.setdefault(r, set()).update(phrases.items(k))
    begin, last = np.concatenate(firsts), np.concatenate(lasts)
    order = np.argsort(begin, kind="stable")
    begin = begin[order]
    reach = np.maximum.accumulate(last[order])
    opens = np.r_[True, (begin[1:] > reach[:-1] + 1) | (row[begin[1:]] != row[begin[:-1]])][: len(begin)]
    closes = np.r_[opens[1:], True][: len(begin)]
    return begin[opens], reach[closes], {r: sorted(found, key=lambda x: (x is not None, x)) for r, found in items.items()}


def find_in_column(column: pa.Array, parts: Callable[[], Iterable[Phrases]], n: int) -> dict[int, tuple[list[tuple[int, int]], list]]:
    """For each text that holds a phrase of any part: its removal spans in characters, and the items found."""
    words = Words(column)
    hashes, row = words.hashes(), words.row_of_word()
    begin, end, items = find_in_words(hashes, row, shards_of(hashes, row, n), parts)
    spans: dict[int, list[tuple[int, int]]] = {}
    chars, at, now = 0, 0, -1
    for a, b in zip(begin.tolist(), end.tolist()):
        if row[a] != now:
            now = int(row[a])
            chars, at = 0, int(words.bounds[now])
        edges = []
        for to in (int(words.starts[a]), int(words.ends[b])):
            chars += int(np.count_nonzero((words.data[at:to] & 0xC0) != 0x80))
            at = to
            edges.append(chars)
        spans.setdefault(now, []).append((edges[0], edges[1]))
    return {r: (spans[r], found) for r, found in items.items()}


def _parts(benchmark: DataFrame, id_col: str, text_col: str, n: int, least: int) -> Iterator[Phrases]:
    """Phrases to broadcast: all at once if the test texts are small, else in parts of a bounded size."""
    items = id_and_text(benchmark, id_col, text_col).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size * n * 8 // BROADCAST_BYTES // 4) or 1
    for k in range(parts):
        yield Phrases(items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).toArrow(), n, least)


class Shared:
    """The parts, broadcast. In a worker, one part is kept; of several, each is read again from the executor's disk, so that one is held at a time."""

    def __init__(self, docs: DataFrame, parts: Iterable[Phrases]):
        self.parts: list[Broadcast] = [docs.sparkSession.sparkContext.broadcast(phrases) for phrases in parts]

    def __call__(self) -> Iterator[Phrases]:
        for part in self.parts:
            yield part.value
            if len(self.parts) > 1 and getattr(part, "_path", None):
                vars(part).pop("_value", None)


def _leaks_schema(rows: DataFrame, benchmark: DataFrame, item_col: str) -> StructType:
    spans = with_id(rows, "spans array<struct<start:int,end:int>>")
    return StructType([spans["id"], StructField("item_ids", ArrayType(benchmark.schema[item_col].dataType)), spans["spans"]])


def _leaks_batch(ids: pa.Array, found: dict[int, tuple[list[tuple[int, int]], list]], items: pa.DataType) -> pa.RecordBatch:
    at = sorted(found)
    spans = [[{"start": a, "end": b} for a, b in found[r][0]] for r in at]
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([found[r][1] for r in at], pa.list_(items)), pa.array(spans, pa.list_(struct))], ["id", "item_ids", "spans"])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = PHRASE_WORDS, least: int = LEAST_WORDS
) -> DataFrame:
    """(id, item_ids array, spans array<struct<start:int,end:int>>) of the rows that hold test phrases.

    Spans are in characters, end exclusive. However large the test texts are, a row of ``docs`` has one row at most.
    """
    rows = id_and_text(docs, id_col, text_col)
    schema, items, shared = _leaks_schema(rows, benchmark, item_col), to_arrow_type(benchmark.schema[item_col].dataType), Shared(docs, _parts(benchmark, item_col, item_text, n, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                found = find_in_column(batch.column(1), shared, n)
                if found:
                    yield _leaks_batch(batch.column(0), found, items)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n: int = PHRASE_WORDS) -> DataFrame:
    """Writes the indexes of all shards to ``path`` as Parquet and returns them, for phrases of up to ``n`` words.

    A row is a shard: its texts' ids, the Burrows-Wheeler transform, the vocabulary's hashes, the sampled suffix positions, and
    of each word its text, its first character and its length. About 1.5 to 2 times the texts' size, before compression.
    """
    rows = id_and_text(docs, id_col, text_col)
    kinds = "bwt binary, vocabulary binary, sampled binary, samples binary, row binary, at binary, size binary, phrase_words int"
    schema = StructType([StructField("ids", ArrayType(rows.schema["id"].dataType)), *StructType.fromDDL(kinds).fields])
    ids_type = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                words = Words(batch.column(1))
                hashes, row = words.hashes(), words.row_of_word()
                for first, shard in shards_of(hashes, row, n):
                    part = slice(first, first + len(shard.words[shard.words >= 0]))
                    begin, end = _characters(words, part)
                    texts, own = np.unique(row[part], return_inverse=True)
                    index = shard.index
                    values = [
                        index.bwt.astype(np.int32), shard.vocabulary, np.packbits(index.sampled), index.samples.astype(np.int32), own.astype(np.int32), begin.astype(np.int32), (end - begin).astype(np.int32)
                    ]
                    ids = pa.array([batch.column(0).take(pa.array(texts)).to_pylist()], pa.list_(ids_type))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([v.tobytes()], pa.binary()) for v in values), pa.array([n], pa.int32())], schema.names)

    rows.mapInArrow(run, schema).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _characters(words: Words, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """The first and last characters of words within their texts, ends exclusive."""
    a, b = words.starts[part], words.ends[part]
    base = words.bounds[:-1][words.row_of_word()[part]]
    low = int(a[0])
    before = np.zeros(int(b[-1]) - low + 1, np.int32)  # characters from the first word on before each byte
    np.cumsum((words.data[low : int(b[-1])] & 0xC0) != 0x80, out=before[1:])
    lead = np.count_nonzero((words.data[int(base[0]) : low] & 0xC0) != 0x80)
    base = np.where(base >= low, before[np.maximum(base - low, 0)], -lead)
    return before[a - low] - base, before[b - low] - base


def search_index(index: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text", n: int = PHRASE_WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """What ``find_leaks`` finds, from indexes that ``build_index`` stored; the texts aren't read.

    A text that is several shards has a row for each that holds phrases; their spans may touch.
    """
    id_type = index.schema["ids"].dataType.elementType
    schema = _leaks_schema(index.sparkSession.createDataFrame([], StructType([StructField("id", id_type)])), benchmark, item_col)
    items, shared = to_arrow_type(benchmark.schema[item_col].dataType), Shared(index, _parts(benchmark, item_col, item_text, n, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                stored = {f: batch.column(f)[k] for f in batch.schema.names}
                if stored["phrase_words"].as_py() < n:
                    raise ValueError(f"the index was built for phrases of {stored['phrase_words']} words")
                bwt, row, at, size = (np.frombuffer(stored[f].as_buffer(), np.int32) for f in ("bwt", "row", "at", "size"))
                vocabulary = np.frombuffer(stored["vocabulary"].as_buffer(), np.uint64)
                sampled = np.unpackbits(np.frombuffer(stored["sampled"].as_buffer(), np.uint8), count=len(bwt)).astype(bool)
                shard = Shard.__new__(Shard)
                shard.vocabulary, shard.words = vocabulary, np.full(len(bwt), -1, np.int32)
                shard.words[np.arange(len(row)) + row] = np.arange(len(row))
                shard.index = FMIndex.stored(bwt.astype(np.int64), len(vocabulary) + 1, sampled, np.frombuffer(stored["samples"].as_buffer(), np.int32).astype(np.int64))
                begin, end, found = find_in_words(vocabulary, row, [(0, shard)], shared)
                spans: dict[int, list[tuple[int, int]]] = {}
                for a, b in zip(begin.tolist(), end.tolist()):
                    spans.setdefault(int(row[a]), []).append((int(at[a]), int(at[b] + size[b])))
                if found:
                    yield _leaks_batch(stored["ids"].values, {r: (spans[r], f) for r, f in found.items()}, items)

    return index.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str = "n_chars", item_text: str = "text", n: int = PHRASE_WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """The same rows and columns with all removal spans cut out of the text; no shuffle.

    A document of which no word is left goes. ``chars_col``, if there, is set to the new length
    of changed texts. All phrases are searched in the original text, however large the test set is.
    """
    items = benchmark.select(F.lit(0).alias("id"), F.col(f"`{item_text}`").alias("text"))
    shared = Shared(docs, _parts(items, "id", "text", n, least))

    def change(column: pa.Array) -> dict[int, str | None]:
        changed: dict[int, str | None] = {}
        for r, (spans, _) in find_in_column(column, shared, n).items():
            text, at, kept = column[r].as_py(), 0, []
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            text = "".join([*kept, text[at:]])
            changed[r] = text if any(c.isalnum() for c in text) else None
        return changed

    return replace_texts(docs, text_col, chars_col, change)
