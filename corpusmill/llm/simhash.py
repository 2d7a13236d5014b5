"""Near-duplicate removal by SimHash fingerprints and keys that no near pair escapes.

Each document's distinct words vote on 256 bits. Two documents are near when their fingerprints differ in at most 36 bits, and
every such pair is found. A fingerprint is split into 6 blocks; of two near ones some block differs in few bits
(five blocks in at most 5, or one in at most 6). For a block that may differ in r bits, each bit is given a vector of r + 1 bits, and each
of the 2^(r + 1) - 1 vectors v that aren't zero makes a key of the bits whose vector has an odd product with v, about half of them.
The vectors of r bits that differ leave some v orthogonal to all of them, so that key is equal: 442 keys of about 21 bits, and no near pair without one.
Fingerprints that share a key are verified by Hamming distance.

Keys are never shuffled. Fingerprints, 32 bytes each, are dealt into groups of a bounded size, and each two groups meet in one
task, which makes one key after another and sorts by it in memory. Pairs are reported as long as they join what the task has not joined yet, and a key
that many share gets a spanning forest, found breadth first, so a group of thousands of copies costs thousands of pairs and not
millions, and still nothing is capped. Where keys would cost more comparisons than all pairs do, all pairs are compared, so a task
costs twice that at most. The number of tasks grows with the square of the fingerprints. Near-duplicate groups are the connected components of
the verified pairs, made by alternating star contractions.

Only ids, hashes of texts and fingerprints move: texts are read once and never shuffled. Equal fingerprints are one
row from the start, which takes care of large groups of exact copies.

Defined results: rows whose text is null or holds no word, and rows whose id is null, are not
compared and always stay; texts are read whole; repeated rows are copies, and one of them stays; of each group
the row with the smallest id stays, of several with that id the one whose text has the smallest hash; different texts
of one id are different documents, which both stay unless they are near copies; ids may be of any type that has an order; an
empty table has no pairs; other columns are passed through by ``deduplicate`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import Words, checkpoint, id_and_text, mix, slices, small_side, with_id

BITS = 256
BLOCKS = 6
DISTANCE = 36
_FP = [f"f{k}" for k in range(BITS // 64)]
#: Votes counted at once; bounds a worker's memory.
_VOTES = 1 << 16
#: Fingerprints with one key beyond which they get a forest, not all their pairs.
HOT = 64
#: One of so many keys is tried to tell whether comparing all pairs is less work.
HOT_SAMPLE = 64
#: Fingerprints of a group; a task holds two groups.
CELL = 1 << 20
#: Tasks that the keys of a table of few groups are dealt to.
PARTS = 12
#: Rows with one value beyond which a join deals with that value apart, by broadcast.
HOT_ROWS = 1_000_000


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 4 uint64 fingerprints, whether a row has any word): bit set where most distinct words have it."""
    words = Words(column)
    rows = len(words.rows) - 1
    out = np.zeros((rows, BITS // 64), np.uint64)
    row, h = words.row_of_word(), words.hashes()
    if rows == 1:  # it may be very long
        h = np.unique(h)
        row = np.zeros(len(h), np.int32)
    else:
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
        row, h = row[new], h[new]
    bounds = np.searchsorted(row, np.arange(rows + 1))
    for r in np.flatnonzero(np.diff(bounds)):
        votes = np.zeros(BITS, np.int64)
        for a in range(bounds[r], bounds[r + 1], _VOTES):
            x = h[a : min(a + _VOTES, bounds[r + 1])]
            bits = np.unpackbits(np.stack([mix(x, k + 1) for k in range(BITS // 64)], axis=1).view(np.uint8).reshape(len(x), -1), axis=1)
            votes += bits.sum(axis=0, dtype=np.int64)
        out[r] = np.packbits(2 * votes > bounds[r + 1] - bounds[r]).view(np.uint64)
    return out, np.diff(bounds) > 0


@lru_cache
def key_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> np.ndarray:
    """(keys x 4 uint64): the bits that make each key. Fingerprints within ``distance`` agree in all bits of one mask at least.

    ``blocks`` decides on the number of keys and their length, not on the result; there are more where a block would need over 127 keys.
    """
    total = distance + 1
    blocks = min(max(blocks, -(-total // 7)), total)
    # were each block to differ in as many bits as its vectors have, that would be ``total``
    sizes = [total // blocks + (k < total % blocks) for k in range(blocks)]
    cuts = np.rint(np.cumsum([0, *sizes]) * (BITS / total)).astype(int)
    draw, masks = np.random.default_rng(1), []
    for size, a, b in zip(sizes, cuts, cuts[1:]):
        v = np.arange(1, 1 << size)
        best, cost = None, np.inf
        for _ in range(200):  # any vectors are right; even ones make the keys long
            vectors = np.concatenate([draw.permutation(v) for _ in range(-(-(b - a) // len(v)))])[: b - a]
            odd = np.bitwise_count(v[:, None] & vectors) & 1
            if np.exp2(-odd.sum(axis=1, dtype=float)).sum() < cost:
                best, cost = odd, np.exp2(-odd.sum(axis=1, dtype=float)).sum()
        bits = np.zeros((len(v), BITS), np.uint8)
        bits[:, a:b] = best
        masks.append(bits)
    return np.packbits(np.concatenate(masks), axis=1).view(np.uint64)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LOW = np.uint64(32)


def _hashed(words: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """32-bit hashes, as uint64, of the bits in ``mask``. Fingerprints are columns of ``words``."""
    h = np.zeros(words.shape[1], np.uint64)
    for k in np.flatnonzero(mask):
        h += (words[k] & mask[k]) * _ODD[k]
    return h >> _LOW


def block_keys(fp: np.ndarray, blocks: int = BLOCKS, distance: int = DISTANCE) -> np.ndarray:
    """(rows x keys) int64 keys; rows within ``distance`` of each other share one at least, in the same column."""
    words = np.ascontiguousarray(fp.T)
    return np.stack([_hashed(words, mask) for mask in key_masks(distance, blocks)], axis=1).view(np.int64)


def forest(fp: np.ndarray, limit: int, work: list[int] | None = None) -> list[tuple[int, int, int]]:
    """A spanning forest (i, j, distance), i < j, of the pairs within ``limit`` of each other. Adds the comparisons made to ``work``."""
    edges, rest = [], np.arange(len(fp))
    left = fp
    while len(rest):
        queue, rest, left = [int(rest[0])], rest[1:], left[1:]
        while queue and len(rest):
            i = queue.pop()
            d = np.bitwise_count(left ^ fp[i]).sum(axis=1)
            if work is not None:
                work[0] += len(rest)
            near = d <= limit
            if not near.any():
                continue
            for j, x in zip(rest[near].tolist(), d[near].tolist()):
                edges.append((min(i, j), max(i, j), x))
                queue.append(j)
            rest, left = rest[~near], left[~near]
    return edges


def _distances(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((np.bitwise_count(w[a] ^ w[b]).astype(np.int32) for w in words), np.zeros(len(a), np.int32))


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the least label of both to what a[k] and b[k] are in, in place. Labels are places that have themselves as a label."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while ((above := label[label]) != label).any():
            label[:] = above


def close_pairs(words: np.ndarray, masks: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance) of columns of ``words`` that are within ``limit`` and share a key of ``masks``, enough to connect all such."""
    n = words.shape[1]

    def trees(rows: np.ndarray, work: list[int]) -> tuple[np.ndarray, np.ndarray]:
        edges = np.array(forest(np.ascontiguousarray(words[:, rows].T), limit, work), np.int64).reshape(-1, 3)
        return rows[edges[:, 0]], rows[edges[:, 1]]

    def measured(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (np.concatenate([np.zeros(0, np.int64), *(pair[k] for pair in found)]) for k in (0, 1))
        return a, b, _distances(words, a, b)

    if n <= 4 * len(masks):
        return measured([trees(np.arange(n), [0])])
    work, label, place = [0], np.arange(n), np.arange(n, dtype=np.uint64)
    found, pending, joined = [], [], False
    head = np.ascontiguousarray(words[:2].T)  # half of each fingerprint, which tells most candidates apart
    tried = np.arange(len(masks)) % HOT_SAMPLE == 0
    for k, m in enumerate(np.argsort(~tried, kind="stable")):
        both = np.sort((_hashed(words, masks[m]) << _LOW) | place)
        key, at = (both >> _LOW).astype(np.uint32), both.astype(np.uint32)
        same = key[1:] == key[:-1]
        bounds = np.flatnonzero(np.r_[True, ~same, True])
        new = []
        for run in np.flatnonzero(np.diff(bounds) > HOT):
            start, end = bounds[run], bounds[run + 1]
            same[start : end - 1] = False
            rows = at[start:end].astype(np.int64)
            if (label[rows] != label[rows[0]]).any():
                new.append(trees(rows, work))
        step, pos = 1, np.flatnonzero(same)
        while len(pos):  # places of sorted rows that have the key of the row ``step`` places on
            a, b = at[pos].astype(np.int64), at[pos + step].astype(np.int64)
            if joined:
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
            work[0] += len(a)
            half = np.bitwise_count(head.take(a, axis=0) ^ head.take(b, axis=0))
            half = half[:, 0] + half[:, 1] <= limit
            a, b = a[half], b[half]
            near = _distances(words, a, b) <= limit
            new.append((a[near], b[near]))
            step += 1
            pos = pos[pos + step < n]
            pos = pos[key[pos + step] == key[pos]]
        new = [pair for pair in new if len(pair[0])]
        found += new
        pending += new
        if sum(len(pair[0]) for pair in pending) > n // 16:
            for pair in pending:
                _join(label, *pair)
            pending, joined = [], True
        if work[0] * len(masks) > max(k + 1, tried.sum()) * (n * n // 2):
            return measured([trees(np.arange(n), [0])])
    return measured(found)


def _fingerprint_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, f0..f3) of the rows that are compared; h is a hash of the text, which with the id tells a row."""
    rows = id_and_text(docs, id_col, text_col).where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", _text_hash("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                fp, some = fingerprints(batch.column(2))
                columns = [batch.column(0).filter(pa.array(some)), batch.column(1).filter(pa.array(some)), *(pa.array(fp[some, k].view(np.int64)) for k in range(len(_FP)))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h", *_FP])

    return rows.mapInArrow(run, with_id(rows, "h long, " + ", ".join(f"{f} long" for f in _FP)))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], size: Column) -> DataFrame:
    """Inner join with ``right``, whose ``on`` is unique; values that ``size`` says are hot are joined by broadcast, as there are few of them."""
    hot = right.where(size > HOT_ROWS)
    count = hot.count()
    if not count:
        return left.join(right, on)
    hot = small_side(hot, count, 128)
    rest = left.join(hot.select(*on), on, "left_anti").join(right.where(size <= HOT_ROWS), on)
    return left.join(hot, on).unionByName(rest)


def near_pairs(reps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Verified (a, b, distance), a > b, of rows (id, f0..f3) with different fingerprints, enough to connect each group."""
    reps = reps.select("id", *_FP)
    count = reps.count()
    groups = max(2, -(-count // CELL))
    meetings = groups * (groups - 1) // 2
    # few meetings are split by keys; small ones aren't worth it
    parts = min(-(-PARTS // meetings), 1 + count // 4096)
    masks = key_masks(distance, blocks)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [batch for batch in batches if batch.num_rows]
        cell = np.concatenate([np.zeros(0, np.int32), *(batch.column(0).to_numpy() for batch in kept)])
        for c in np.unique(cell).tolist():  # one, unless Spark merges partitions
            here = [batch.filter(pa.array(batch.column(0).to_numpy() == c)) for batch in kept]
            ids = np.concatenate([batch.column(1).to_numpy() for batch in here])
            words = np.stack([np.concatenate([batch.column(2 + k).to_numpy() for batch in here]) for k in range(len(_FP))]).view(np.uint64)
            i, j, d = close_pairs(words, masks[c % parts :: parts], distance)
            a, b = ids[i], ids[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(d)], ["a", "b", "distance"])

    own, other = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("long"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    dealt = reps.select("*", own.alias("own"), other.alias("other")).where("own <> other")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # meetings by number: those of group 0, those of 1 with higher ones, and so on
    before = F.shiftright(low * (2 * groups - 1 - low), 1)
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = dealt.select((before + high - low - 1).alias("meeting"), part.alias("part"), "id", *_FP)
    dealt = dealt.select((F.col("meeting") * parts + F.col("part")).cast("int").alias("cell"), "id", *_FP)
    pairs = dealt.repartitionById(meetings * parts, F.col("cell")).mapInArrow(meet, "a long, b long, distance int")
    return pairs.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id but the roots; the root is the smallest id of the component. Edges are (a, b), a > b."""

    def with_least(rows: DataFrame, some: int) -> DataFrame:
        """Adds m, the least b of the same a. A hot a's is found by partial aggregates, so that no task holds all its rows."""
        if some <= HOT_ROWS:  # no a can be hot
            return rows.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        rows = checkpoint(rows)
        least = checkpoint(rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        return skew_join(rows, least, ["a"], F.col("n")).drop("n")

    stars, before = checkpoint(edges.select("a", "b").distinct()), None
    count = stars.count()
    while True:
        both = stars.union(stars.select("b", "a"))
        large = with_least(both, 2 * count).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = with_least(large, 2 * count).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        stars = checkpoint(small.where("a <> b").distinct())
        state = stars.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s"), F.sum("b").alias("b")).first()
        if state == before:
            return stars.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before, count = state, state["n"]


def _rows_that_go(docs: DataFrame, id_col: str, text_col: str, distance: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Of rows told by (id, h): the (id, h, kept_id) that go, one for each of their rows; the (id, h, n) that stay but are there n > 1 times."""
    prints = checkpoint(_fingerprint_table(docs, id_col, text_col))
    grouped = prints.groupBy(*_FP).agg(F.count("*").alias("rows"), F.min(F.struct("id", "h")).alias("first"))
    # numbers are given once, when the table is stored
    reps = checkpoint(grouped.withColumn("rep", F.monotonically_increasing_id()))
    roots = components(near_pairs(reps.select(F.col("rep").alias("id"), *_FP), distance, blocks))
    named = checkpoint(reps.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    kept = checkpoint(named.groupBy("root").agg(F.min("first").alias("kept"), F.count("*").alias("reps")))
    named = checkpoint(skew_join(named, kept, ["root"], F.col("reps")).where((F.col("rows") > 1) | (F.col("first") != F.col("kept"))).select(*_FP, "rows", "kept"))
    found = skew_join(prints, named, _FP, F.col("rows"))
    stays = (F.col("id") == F.col("kept.id")) & (F.col("h") == F.col("kept.h"))
    gone = checkpoint(found.where(~stays).select("id", "h", F.col("kept.id").alias("kept_id")))
    again = checkpoint(found.where(stays).groupBy("id", "h").count().where("count > 1").withColumnRenamed("count", "n"))
    return gone, again


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(id, kept_id) of every row that goes, with the smallest id of its group, which stays; of a repeated row, all but one go."""
    gone, again = _rows_that_go(docs, id_col, text_col, distance, blocks)
    out = gone.select("id", "kept_id")
    if again.count():
        # all but one: n - 1 rows, spread over a thousand parts, so that no list is long
        parts = F.explode(F.sequence(F.lit(0), F.lit(999)))
        share = F.floor((F.col("n") - 1 + F.col("part")) / 1000)
        each = again.select("id", "n", parts.alias("part")).select("id", share.alias("share")).where("share > 0").select("id", F.explode(F.sequence(F.lit(1).cast("long"), "share")))
        out = out.unionByName(each.select("id", F.col("id").alias("kept_id")))
    return out.withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """The rows that stay: one of each group. Texts aren't shuffled if the keys of the rows that go can be broadcast.

    Of equal repeated rows the one with the smallest hash of all columns stays.
    """
    gone, again = _rows_that_go(docs, id_col, text_col, distance, blocks)
    key, names = (F.col(f"`{id_col}`"), _text_hash(text_col)), docs.columns

    def without(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("id").alias("__id"), F.col("h").alias("__h"))
        return rows.join(small_side(keys, keys.count(), 40), (key[0] == F.col("__id")) & (key[1] == F.col("__h")), how)

    out = without(docs, gone, "left_anti")
    if not again.count():
        return out
    columns = [F.col(f"`{c}`") for c in names]
    one = without(docs, again, "left_semi").groupBy(key[0].alias("__id"), key[1].alias("__h")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row"))
    return without(out, again, "left_anti").unionByName(one.select(*(F.col(f"__row.`{c}`") for c in names)))
