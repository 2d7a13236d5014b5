"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that can end its encoding.
An automaton over the vocabulary reports, at each byte, all tokens that are a suffix of the
prefix; the one that is compatible with the stored last token of the remaining prefix is the
answer, and following these back-pointers from the end emits the exact ids. Two adjacent
tokens are compatible when byte-pair merging of their joined bytes leaves them as they are;
that is decided by undoing merges next to the border (``PairTest``).

Texts are first cut by the vocabulary's split pattern, as the reference encoders do, and the
pieces' encodings are kept in a bounded table, since pieces recur.

Defined results: a null text has null ids, a null count and a null decoding; an empty text has
no ids; any text, of any length, is encoded whole, a long one piece after piece; repeated rows give repeated results; an
empty table gives an empty one; ids of any type, null ones too, are passed through; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from itertools import batched

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import as_type, id_and_text, slices, with_id

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose encodings a worker keeps; others are encoded again each time.
KEPT_PIECES = 500_000
KEPT_PAIRS = 400_000
#: Characters from which a text, and tokens from which its ids, are worked on in parts, so that no long list of objects is made.
LONG = 1 << 20


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a rank file of base64 tokens."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def split_table(tokens: list[bytes]) -> list[tuple[int, int]]:
    """The two tokens whose merge makes each token; a token that no merge makes has itself twice."""
    ids = {t: i for i, t in enumerate(tokens) if t}
    table = []
    for i, token in enumerate(tokens):
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            ranks = [ids.get(a + b, i) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best >= i:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        pair = (ids.get(parts[0]), ids.get(parts[1])) if len(parts) == 2 else (i, i)
        table.append(pair if None not in pair else (i, i))
    return table


class PairTest(dict):
    """``self[left << 32 | right]``: whether the two tokens stay apart when their bytes are merged."""

    def __init__(self, splits: list[tuple[int, int]]):
        super().__init__()
        self.splits = splits
        self.merged = {a << 32 | b: i for i, (a, b) in enumerate(splits) if a != i}

    def __missing__(self, key: int) -> bool:
        answer = self.apart(key >> 32, key & 0xFFFFFFFF)
        if len(self) < KEPT_PAIRS:
            self[key] = answer
        return answer

    def apart(self, left: int, right: int) -> bool:
        """Undo the latest merge beside the border until bytes are left; no earlier merge may cross it.

        ``bar`` is the id under which a merge across the border would have come first. The left
        part of a tie merges first, so undoing on the right allows equal ids as well.
        """
        bar = len(self.splits)
        while True:
            if self.merged.get(left << 32 | right, bar) < bar:
                return False
            left_leaf, right_leaf = self.splits[left][1] == left, self.splits[right][0] == right
            if left_leaf and right_leaf:
                return True
            if right_leaf or (left > right and not left_leaf):
                bar, left = left, self.splits[left][1]
            else:
                bar, right = right + 1, self.splits[right][0]


class Encoder(dict):
    """``self[piece]``: the ids of a piece, packed as native int32."""

    def __init__(self, tokens: list[bytes], splits: list[tuple[int, int]]):
        super().__init__()
        self.tokens = tokens
        self.sizes = [len(t) for t in tokens]
        self.apart = PairTest(splits)
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            if token:
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.pieces, self.each_piece = regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer

    def last_tokens(self, data: str) -> list[int]:
        """The unique last token of every prefix of ``data``, bytes as Latin-1; of the empty prefix, -2; if there is none, -1.

        The automaton reports the tokens that end at each place, the longest first.
        """
        last, apart, done = ([-1] if len(data) < LONG else array("i", [-1])) * (len(data) + 1), self.apart, -1
        last[0] = -2
        for end, (token, size) in self.automaton.iter(data):
            if end != done:
                before = last[end + 1 - size]
                if before >= 0:
                    if apart[before << 32 | token]:
                        last[end + 1] = token
                        done = end
                elif before == -2:
                    last[end + 1] = token
                    done = end
        return last

    def encode_piece(self, piece: str) -> array:
        data = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last, at, ids, sizes = self.last_tokens(data), len(data), [], self.sizes
        while at:
            token = last[at]
            if token < 0:
                raise ValueError("the vocabulary lacks single bytes of the text")
            ids.append(token)
            at -= sizes[token]
        ids.reverse()
        return array("i", ids)

    def __missing__(self, piece: str) -> bytes:
        packed = self.encode_piece(piece).tobytes()
        if len(self) < KEPT_PIECES and len(piece) < 100:
            self[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        if len(text) < LONG:
            return b"".join(map(self.__getitem__, self.pieces(text)))
        out = bytearray()
        for some in batched(self.each_piece(text), 1 << 16):
            out += b"".join([self[m.group()] for m in some])
        return bytes(out)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")

    def decode_array(self, ids: np.ndarray) -> str:
        if len(ids) < LONG:
            return self.decode(ids.tolist())
        out = bytearray()
        for a in range(0, len(ids), 1 << 16):
            out += b"".join(map(self.tokens.__getitem__, ids[a : a + (1 << 16)].tolist()))
        return out.decode("utf-8", "replace")


def load(path: str = VOCABULARY) -> Encoder:
    tokens = load_ranks(path)
    return Encoder(tokens, split_table(tokens))


class Shared:
    """An encoder that each Python worker builds once, from tables that the driver broadcasts.

    The tables' size is that of the vocabulary, about 2 MB, whatever the corpus.
    """

    _built: dict[str, Encoder] = {}

    def __init__(self, spark: SparkSession, path: str):
        tokens = load_ranks(path)
        self.path, self.tables = path, spark.sparkContext.broadcast((tokens, split_table(tokens)))

    def __call__(self) -> Encoder:
        if self.path not in Shared._built:
            Shared._built.clear()
            Shared._built[self.path] = Encoder(*self.tables.value)
        return Shared._built[self.path]


def _ids(encoder: Encoder, texts: list[str | None]) -> pa.ListArray:
    """Lists of ids; of a null text, null."""
    packed = [b"" if t is None else encoder.encode_packed(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)]).astype(np.int32)
    null = np.fromiter((t is None for t in texts), bool, len(texts))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)), mask=pa.array(null))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens int, token_ids array<int>) of every row; no shuffle."""
    encoder = Shared(docs.sparkSession, vocabulary)
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).to_pylist()
                ids = _ids(e, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(ids), ids], ["id", "n_tokens", "token_ids"])

    out = rows.mapInArrow(run, with_id(rows, "n_tokens int, token_ids array<int>"))
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) of every row of token ids; null ids have a null text. Bytes that aren't UTF-8 become U+FFFD."""
    encoder = Shared(encoded.sparkSession, vocabulary)
    rows = encoded.select(F.col(f"`{id_col}`").alias("id"), as_type(encoded, ids_col, "array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if ids is None else e.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, with_id(rows, "text string")).withColumnRenamed("id", id_col)


def lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens long) of every row whose text is not null; the ids stay in the worker."""
    encoder = Shared(docs.sparkSession, vocabulary)
    rows = docs.select(as_type(docs, text_col, "string").alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for whole in batches:
            for batch in slices(whole, 0):
                counts = [len(e.encode_packed(t)) // 4 for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return rows.mapInArrow(run, "n_tokens long")


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, token_ids, round_trip boolean): ``encode``, with whether decoding the emitted ids gives the text back."""
    encoder = Shared(docs.sparkSession, vocabulary)
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).to_pylist()
                ids = _ids(e, texts)
                values, at = ids.values.to_numpy(), ids.offsets.to_pylist()
                same = [None if t is None else e.decode_array(values[a:b]) == t for t, a, b in zip(texts, at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(ids), ids, pa.array(same, pa.bool_())], ["id", "n_tokens", "token_ids", "round_trip"])

    return rows.mapInArrow(run, with_id(rows, "n_tokens int, token_ids array<int>, round_trip boolean")).withColumnRenamed("id", id_col)
