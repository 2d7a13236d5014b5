"""Quality rules: an isolation forest on rule statistics, with a threshold set by labelled rows.

Each document becomes five rule statistics, counted over its whole text and drawn towards
clean prose for short ones: capitals, symbols and exclamations, lines that end oddly, repeated
lines and words repeated within a few places. Trees split
small samples of good labelled rows at random; a document that few random splits isolate,
or that falls outside the range in which a node was seen to split, has a short path and is
anomalous. The score is 2 ** (-mean path / expected path), as published for isolation forests.
The threshold is where labelled bad rows are best told from labelled good ones, subject to
a bound on the share of good rows that it rejects, from exact histograms of all labelled rows' scores.

The forest is fitted on a bounded sample, ``FIT_ROWS`` good labelled rows with the smallest
hashes of their ids; statistics, scores and the threshold cover all rows.

Defined results: a null or empty text, or one without words, has no statistics, scores 1 and is
rejected; texts are read whole; repeated rows get equal verdicts; ids may be of any type; rows with null ids get a verdict
from their text but have no label; labels whose quality is null or whose document is missing are
not used, an id's repeated labels count once each and a repeated label of both kinds counts
as both; without labels of both kinds there is no threshold and only rows without statistics are rejected;
an empty table gives an empty table; other columns are kept by ``keep_good`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Words, checkpoint, fits_broadcast, id_and_text, slices, span_hashes, with_id

#: Good labelled rows that the forest is fitted on, at most.
FIT_ROWS = 20_000
TREES = 128
#: Rows that each tree splits.
TREE_ROWS = 256
#: Share of good labelled rows that the threshold may reject.
GOOD_REJECTED = 0.005
#: Cells of the score histograms; scores lie between 0 and 1.
CELLS = 10_000

STATISTICS = ("upper_letters", "symbols_per_word", "odd_line_ends", "repeated_lines", "repeated_words")
#: Typical words that are added to every text before its shares are taken, so that a few words say little.
PRIOR_WORDS = 40
PRIOR_LINES = 2
_SCHEMA = ", ".join(f"{s} double" for s in STATISTICS)
#: Bytes that are counted at once in a long text.
_BLOCK = 1 << 20


def _table(members: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(members.encode())] = 1
    return table


_UPPER, _LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_SYMBOL = _table("#$%&*+<=>@[]\\^_`{|}~/!?")
_END = _table(".!?\"');:")


def statistics(column: pa.Array) -> np.ndarray:
    """rows x statistics; a row without words is all NaN."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    words = Words(text)
    rows = len(words.rows) - 1
    out = np.full((rows, len(STATISTICS)), np.nan)
    n = np.diff(words.rows)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    raw = np.frombuffer(text.buffers()[2], np.uint8)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + rows + 1]
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]

    n, sizes = n[some], np.diff(offsets)[some]
    tables = {"upper": _UPPER, "letter": _LETTER, "symbol": _SYMBOL}
    if rows == 1:  # it may be very long
        bytes_of = sum((np.bincount(raw[a : a + _BLOCK], minlength=256) for a in range(0, len(raw), _BLOCK)), np.zeros(256, np.int64))
        count = {k: np.array([int(bytes_of @ t)]) for k, t in tables.items()}
    else:
        count = {k: np.diff(np.concatenate([[0], np.cumsum(t[raw])])[offsets])[some] for k, t in tables.items()}
    # lines: between line feeds, within a text, not blank
    newline = np.flatnonzero(raw == 10)
    begins = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    begins = begins[begins < len(raw)]
    ends = np.concatenate([begins[1:], [len(raw)]])
    ends = ends - (raw[np.maximum(ends - 1, 0)] == 10)
    keep = ends > begins
    begins, ends = begins[keep], ends[keep]
    line_row = np.searchsorted(offsets, begins, side="right") - 1
    lines = np.bincount(line_row, minlength=rows)
    odd = np.bincount(line_row, weights=1 - _END[raw[ends - 1]], minlength=rows)
    repeated_line = _repeated(line_row, span_hashes(raw, begins, ends), ends - begins, rows)
    word_row, hashes = words.row_of_word(), words.hashes()
    near = np.zeros(len(hashes), bool)
    for gap in (1, 2, 3):  # the same word again within a few words
        near[gap:] |= (hashes[gap:] == hashes[:-gap]) & (word_row[gap:] == word_row[:-gap])
    smooth, chars_per_word = n + PRIOR_WORDS, 5
    out[some] = np.stack(
        [
            count["upper"] / (count["letter"] + PRIOR_WORDS * chars_per_word),
            np.minimum(count["symbol"] / smooth, 4),
            odd[some] / (lines[some] + PRIOR_LINES),
            repeated_line[some] / (sizes + PRIOR_WORDS * chars_per_word),
            np.diff(np.concatenate([[0], np.cumsum(near)])[words.rows])[some] / smooth,
        ],
        axis=1,
    )
    return out


def _repeated(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """For each row, the weight of its items that were there before."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    again = np.r_[False, (r[1:] == r[:-1]) & (k[1:] == k[:-1])] if len(r) else np.zeros(0, bool)
    return np.bincount(r[again], weights=weight[order][again], minlength=rows)


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Arrays of nodes by tree. A leaf has no feature; a row outside a node's range stops there."""

    def __init__(self, data: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = min(size, len(data))
        self.norm = float(max(_expected(size), 1e-9))
        deepest = int(np.ceil(np.log2(max(size, 2))))
        nodes: list[list] = []
        self.roots = []
        for _ in range(trees):
            self.roots.append(self._grow(nodes, data[rng.choice(len(data), size, replace=False)], 0, deepest, rng))
        feature, cut, low, high, left, right, length = zip(*nodes)
        self.feature, self.left, self.right = (np.array(x, np.int64) for x in (feature, left, right))
        self.cut, self.low, self.high, self.length = (np.array(x, float) for x in (cut, low, high, length))
        self.deepest = deepest

    def _grow(self, nodes: list[list], data: np.ndarray, depth: int, deepest: int, rng: np.random.Generator) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0.0, 0.0, me, me, depth + float(_expected(len(data)))])
        spread = np.flatnonzero(data.max(axis=0) > data.min(axis=0)) if len(data) > 1 and depth < deepest else []
        if len(spread):
            f = int(rng.choice(spread))
            low, high = data[:, f].min(), data[:, f].max()
            cut = rng.uniform(low, high)
            below = data[:, f] < cut
            margin = (high - low) * 0.5
            nodes[me][:4] = [f, cut, low - margin, high + margin]
            nodes[me][4] = self._grow(nodes, data[below], depth + 1, deepest, rng)
            nodes[me][5] = self._grow(nodes, data[~below], depth + 1, deepest, rng)
            nodes[me][6] = depth
        return me

    def score(self, data: np.ndarray) -> np.ndarray:
        """1 for rows without statistics; else between 0 and 1, higher for shorter paths."""
        some = ~np.isnan(data).any(axis=1)
        x = data[some]
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots:
            node, live = np.full(len(x), root), every
            for _ in range(self.deepest):
                at = node[live]
                value = x[live, np.maximum(self.feature[at], 0)]
                go = (self.feature[at] >= 0) & (value >= self.low[at]) & (value <= self.high[at])
                live, at, value = live[go], at[go], value[go]
                if not len(live):
                    break
                node[live] = np.where(value < self.cut[at], self.left[at], self.right[at])
            total += self.length[node]
        out = np.ones(len(data))
        out[some] = 2.0 ** (-total / len(self.roots) / self.norm)
        return out


def threshold(good: np.ndarray, bad: np.ndarray, rejected: float = GOOD_REJECTED) -> float:
    """From histograms of labelled scores: the cut with the best balanced accuracy that rejects no more good rows than allowed.

    Scores above it are rejected. Without rows of both kinds it is 1, which rejects no row that has statistics.
    """
    if not good.sum() or not bad.sum():
        return 1.0
    # suffix sums: rows at or above each cell
    over_good, over_bad = (np.cumsum(h[::-1])[::-1] / h.sum() for h in (good, bad))
    gain = np.where(over_good <= rejected, over_bad - over_good, -1.0)
    best = np.flatnonzero(gain == gain.max())
    if gain.max() <= 0:
        return 1.0
    return float(best.mean() // 1) / len(good)


def measure(rows: DataFrame) -> DataFrame:
    """(id, statistics, ...) of rows (id, text, ...)."""
    rest = [f for f in rows.schema.fields if f.name not in ("id", "text")]
    rows = rows.select("id", "text", *(f.name for f in rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                s = statistics(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[:, k]) for k in range(s.shape[1])), *batch.columns[2:]], ["id", *STATISTICS, *(f.name for f in rest)])

    return rows.mapInArrow(run, with_id(rows, ", ".join([_SCHEMA, *(f"{f.name} {f.dataType.simpleString()}" for f in rest)])))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[Forest | None, float]:
    """The forest, if any row is labelled good, and the threshold. Only labelled rows are measured, if their ids can be broadcast to the documents."""
    mark = F.col(f"`{label_col}`").cast("long")
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), (mark > 0).alias("good")).where("id IS NOT NULL AND good IS NOT NULL")
    marks = checkpoint(marks.groupBy("id", "good").agg(F.count("*").alias("weight")))
    rows = id_and_text(docs, id_col, text_col)
    if fits_broadcast(marks.count(), 64):
        labelled = measure(rows.join(F.broadcast(marks), "id"))
    else:  # statistics move rather than texts
        labelled = checkpoint(measure(rows)).join(marks, "id")
    labelled = checkpoint(labelled)
    # a row that is labelled several times, or of both kinds, is one row to fit on for each good label; the first of them are enough
    some = labelled.where("good AND NOT isnan(upper_letters)").orderBy(F.xxhash64("id"), "id", *STATISTICS).limit(FIT_ROWS).select("weight", *STATISTICS).toArrow()
    if not some.num_rows:
        return None, 1.0
    times = np.minimum(some.column(0).to_numpy(), FIT_ROWS)
    data = np.stack([c.to_numpy() for c in some.columns[1:]], axis=1)
    forest = Forest(np.repeat(data, times, axis=0)[:FIT_ROWS])
    cell = F.least(F.lit(CELLS - 1), F.floor(F.col("score") * CELLS)).cast("int")
    counts = _scored(labelled, forest).groupBy("good", cell.alias("cell")).agg(F.sum("weight").alias("n")).collect()
    good, bad = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    for r in counts:  # at most two rows a cell
        (good if r["good"] else bad)[r["cell"]] = r["n"]
    return forest, threshold(good, bad)


def _scored(table: DataFrame, forest: Forest) -> DataFrame:
    """(id, score, ...) of rows (id, statistics, ...). The forest's size is bounded by its parameters."""
    shared, at = table.sparkSession.sparkContext.broadcast(forest), 1 + len(STATISTICS)
    rest = table.schema.fields[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, at)], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), *batch.columns[at:]], ["id", "score", *(f.name for f in rest)])

    return table.mapInArrow(run, with_id(table, ", ".join(["score double", *(f"{f.name} {f.dataType.simpleString()}" for f in rest)])))


def _scores(column: pa.Array, forest: Forest | None) -> np.ndarray:
    s = statistics(column)
    return np.isnan(s).any(axis=1) * 1.0 if forest is None else forest.score(s)


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score double, keep boolean) of every row."""
    forest, limit = fit(docs, labels, id_col, text_col, label_col)
    rows, shared = id_and_text(docs, id_col, text_col), docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                score = _scores(batch.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score < limit)], ["id", "score", "keep"])

    return rows.mapInArrow(run, with_id(rows, "score double, keep boolean")).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows that aren't rejected, as they are. Once fitted, each row is judged where it is; nothing is joined or shuffled."""
    forest, limit = fit(docs, labels, id_col, text_col, label_col)
    shared, at = docs.sparkSession.sparkContext.broadcast(forest), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                yield batch.filter(pa.array(_scores(batch.column(at), shared.value) < limit))

    return docs.mapInArrow(run, docs.schema)
