"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its words' runs of 2, 3 and 4 bytes, with a space before and after each
word, hashed into a table of embeddings; their average goes through a linear layer to a softmax.
It is trained here by stochastic gradient descent in numpy. Since all but the softmax is linear,
what the workers get is the table of each bucket's share in every class, a few megabytes whatever the corpus.

Confidences are calibrated on labelled documents that were not trained on: a temperature fits the
softmax to their labels, and a document is rejected if its confidence is lower than that of all
but ``REJECTED`` of those which were rightly named. Without any such document nothing is accepted.

The sample is bounded in rows and in bytes: the ``FIT_ROWS`` labelled ids with the smallest hashes, of which every fifth is held
out. Held-out texts are read whole, where they are, and only their logits are collected. Of each of the others,
``ROW_PIECES`` pieces of up to ``PIECE_WORDS`` words and ``PIECE_CHARS`` characters are trained on, spread evenly over the
text, so that short texts are learnt too.

Defined results: null and empty texts, and texts without words, have no language, confidence 0
and are rejected; texts are read whole, long ones by pieces; repeated rows get equal answers; ties go to the language first in
order; null labels are not trained on, rows of one labelled id count once, as the smallest text, and rows with
null ids are one such row; without any label all rows are rejected, and with fewer than five ids none can be held out, so languages are
named but none is accepted; an empty table gives an empty table; ids of any type, null ones too, are passed through; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Words, as_type, id_and_text, slices, with_id

#: Labelled rows that are trained on or held out, at most.
FIT_ROWS = 4_000
BUCKETS = 1 << 16
DIMENSIONS = 16
SIZES = (2, 3, 4)
PIECE_WORDS = 32
PIECE_CHARS = 512
ROW_PIECES = 6
EPOCHS = 2
#: Of the linear layer; embeddings, of which a piece moves many a little, have a larger one.
RATE = 6.0
EMBEDDING_RATE = 64
#: Pieces of one step of gradient descent.
STEP_PIECES = 64
#: Share of rightly named held-out documents whose confidence may fall below the limit.
REJECTED = 0.002
#: Bytes that one numpy step works on.
_STEP = 1 << 20


def subwords(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each size, the bucket of the subword at each byte (``BUCKETS``: none); where each text begins.

    Every text is led by one space, and the last also followed by some.
    """
    words = Words(column)
    stream = np.concatenate([np.insert(np.where(words.mask, words.data, np.uint8(32)), words.bounds, 32), np.full(4, 32, np.uint8)])
    return _buckets(stream, len(stream) - 4), words.bounds[:-1] + np.arange(len(words.bounds) - 1)


def _buckets(stream: np.ndarray, n: int) -> list[np.ndarray]:
    """The buckets at the first ``n`` bytes of a stream of words between spaces, with three bytes after them."""
    stream = stream.astype(np.uint32)
    gap = stream == 32
    out = []
    for size in SIZES:
        code = np.zeros(n, np.uint32)
        inside = np.ones(n, bool)
        for k in range(size):
            code |= stream[k : k + n] << np.uint32(8 * k)
            if 0 < k < size - 1:
                inside &= ~gap[k : k + n]
        if size == 2:
            inside = ~(gap[:n] & gap[1 : n + 1])
        code = (code ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        code >>= np.uint32(16)
        code[~inside] = BUCKETS
        out.append(code.astype(np.intp))
    return out


class Model(NamedTuple):
    languages: list[str]
    #: (buckets + 1) x languages: what one occurrence adds before averaging; the last row is none.
    table: np.ndarray
    temperature: float = 1.0
    #: Least confidence that is accepted; above 1, none is.
    limit: float = 2.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """rows x languages, and whether a row has any subword."""
        words = Words(texts)
        bounds = words.bounds + np.arange(len(words.bounds))  # of the texts in the stream, each led by a space
        stream = np.insert(words.data, words.bounds, 32)
        stream[np.insert(~words.mask, words.bounds, True)] = 32
        stream = np.concatenate([stream, np.full(4, 32, np.uint8)])
        rows = len(bounds) - 1
        total, count = np.zeros((rows, len(self.languages))), np.zeros(rows, np.int64)
        columns = np.ascontiguousarray(self.table.T)
        for a in range(0, int(bounds[-1]) if rows else 0, _STEP):
            b = min(a + _STEP, int(bounds[-1]))
            first = int(np.searchsorted(bounds, a, side="right")) - 1
            last = int(np.searchsorted(bounds, b, side="left"))
            starts = np.maximum(bounds[first:last] - a, 0)
            for bucket in _buckets(stream[a : b + 4], b - a):
                for k, column in enumerate(columns):
                    total[first:last, k] += np.add.reduceat(column.take(bucket), starts)
                count[first:last] += np.add.reduceat(bucket < BUCKETS, starts, dtype=np.int64)
        return total / np.maximum(count, 1)[:, None], count > 0

    def confidences(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its calibrated probability; 0 for a row without subwords."""
        logits, some = self.logits(column)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
        return best, np.where(some, p[np.arange(len(p)), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return e / e.sum(axis=1, keepdims=True) if len(x) else x


def pieces(text: str) -> list[str]:
    """Up to ``ROW_PIECES`` pieces of a text, of changing sizes, that begin at places spread evenly over it."""
    out, many = [], len(text) > ROW_PIECES * PIECE_CHARS
    for k in range(ROW_PIECES):
        at = k * len(text) // ROW_PIECES
        part = text[at : at + (PIECE_CHARS if many else max(1, len(text) // ROW_PIECES) + 64)].split()
        # the first word may have been cut in two
        part = part[1:] if at and len(part) > 1 else part
        size = 3 + (k * 7 + len(text)) % (PIECE_WORDS - 2)
        if part:
            out.append(" ".join(part[:size]))
    return out


def train(texts: list[str], labels: list[str], seed: int = 11) -> Model:
    """A model of pieces of text, not calibrated yet: gradient descent in steps of ``STEP_PIECES`` pieces."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    target = np.searchsorted(languages, labels)
    buckets, starts = subwords(pa.array(texts, pa.string()))
    flat = np.stack(buckets, axis=1)  # a row a byte, so a text's subwords stand together
    ends = np.r_[starts[1:], len(flat)]
    own = [x[x < BUCKETS] for x in (flat[a:b].ravel() for a, b in zip(starts, ends))]
    some = np.array([k for k, x in enumerate(own) if len(x)], np.int64)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    met = np.zeros(BUCKETS, bool)
    for k in some:
        met[own[k]] = True
    steps, done = EPOCHS * -(-len(some) // STEP_PIECES), 0
    for _ in range(EPOCHS):
        order = rng.permutation(some)
        for a in range(0, len(order), STEP_PIECES):
            part = order[a : a + STEP_PIECES]
            sizes = np.array([len(own[k]) for k in part])
            b = np.concatenate([own[k] for k in part])
            begin = np.r_[0, np.cumsum(sizes)[:-1]]
            hidden = np.add.reduceat(embedding[b], begin, axis=0) / sizes[:, None].astype(np.float32)
            p = softmax(hidden @ weight)
            p[np.arange(len(part)), target[part]] -= 1
            rate = np.float32(RATE * (1 - done / steps) / len(part))
            # the same bucket in several places gets the sum of their gradients
            places, which = np.unique(b, return_inverse=True)
            share = np.repeat(p / sizes[:, None], sizes, axis=0)
            step = np.stack([np.bincount(which, weights=share[:, k], minlength=len(places)) for k in range(len(languages))], axis=1) @ weight.T
            weight -= rate * (hidden.T @ p)
            embedding[places] -= (rate * EMBEDDING_RATE * step).astype(np.float32)
            done += 1
    # a bucket that training never met says nothing; with no bias either, a text of such buckets is equally likely in all languages
    table = np.concatenate([np.where(met[:, None], embedding @ weight, 0.0), np.zeros((1, len(languages)))]).astype(np.float32)
    return Model(languages, table)


def calibrate(model: Model, logits: np.ndarray, y: np.ndarray) -> Model:
    """With the temperature and the limit that logits of held-out rows and their languages' numbers (-1: none of the model's) call for."""
    grid = np.geomspace(0.05, 20, 60)
    known = np.flatnonzero(y >= 0)
    if len(known):
        loss = [-np.log(np.maximum(softmax(logits[known] / t)[np.arange(len(known)), y[known]], 1e-12)).mean() for t in grid]
        model = model._replace(temperature=float(grid[int(np.argmin(loss))]))
    p = softmax(logits / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y]) if len(y) else np.zeros(0)
    return model._replace(limit=float(right[int(REJECTED * len(right))])) if len(right) else model


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """Trains on a bounded sample: pieces of its texts, and logits of the held-out ones, are all that comes to the driver."""
    lang = as_type(labelled, lang_col, "string").alias("lang")
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), as_type(labelled, text_col, "string").alias("text"), lang).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.select(F.xxhash64("id", F.lit("language")).alias("h"), "text", "lang")
    hashes = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(FIT_ROWS).collect()]
    if not hashes:
        return None
    held = F.broadcast(labelled.sparkSession.createDataFrame([(h, k % 5 == 4) for k, h in enumerate(hashes)], "h long, held boolean"))
    sample = rows.join(held, "h").groupBy("h", "held").agg(F.min(F.struct("text", "lang")).alias("r")).select("held", "r.text", "r.lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x, y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in pieces(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.string())], ["text", "lang"])

    parts = sample.where("NOT held").select("text", "lang").mapInArrow(cut, "text string, lang string").orderBy("lang", "text").toArrow()
    if not parts.num_rows:
        return None
    model = train(parts.column(0).to_pylist(), parts.column(1).to_pylist())
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, _STEP):
                logits, some = shared.value.logits(batch.column(0))
                keep = np.flatnonzero(some)
                yield pa.RecordBatch.from_arrays([pa.array(logits[keep].tolist(), pa.list_(pa.float64())), batch.column(1).take(pa.array(keep))], ["logits", "lang"])

    tried = sample.where("held").select("text", "lang").mapInArrow(measure, "logits array<double>, lang string").toArrow()
    if not tried.num_rows:
        return model
    number = {name: k for k, name in enumerate(model.languages)}
    return calibrate(model, np.array(tried.column(0).to_pylist()), np.array([number.get(x, -1) for x in tried.column(1).to_pylist()]))


def identify(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, language string, confidence double, accepted boolean) of every row; trained on ``labelled``, or else on ``docs``."""
    model = fit(docs if labelled is None else labelled, id_col, text_col, lang_col)
    rows = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, 1, _STEP):
                if m is None:
                    best, p, names = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), [None]
                else:
                    (best, p), names = m.confidences(batch.column(1)), m.languages
                known = p > 0
                language = pa.array([names[k] if ok else None for k, ok in zip(best, known)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), language, pa.array(p), pa.array(known & (p >= (m.limit if m else 1)))], ["id", "language", "confidence", "accepted"])

    return rows.mapInArrow(run, with_id(rows, "language string, confidence double, accepted boolean")).withColumnRenamed("id", id_col)
