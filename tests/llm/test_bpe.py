import numpy as np
import tiktoken
from conftest_rows import LONG, ROWS
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import bpe

ENCODER = bpe.load()
REFERENCE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ENCODER.tokens)}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_equal_the_public_encoder(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)
    assert ENCODER.decode(ENCODER.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aehilnorst ", min_size=1, max_size=60))
def test_ids_of_letters(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


def test_one_piece_without_end():
    for text in ("a" * 20_000, "ab" * 5_000, "antidisestablishmentarianism" * 300, " " * 5_000):
        assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


def test_long_texts_go_piece_by_piece(monkeypatch):
    texts = ["Some words, 12 of them — and more…\n" * 400, "a" * 3_000, "x y" * 700, ""]
    monkeypatch.setattr(bpe, "LONG", 100)
    for text in texts:
        ids = ENCODER.encode(text)
        assert ids == REFERENCE.encode_ordinary(text) and ENCODER.decode_array(np.array(ids, np.int32)) == text


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("ab12cd34ef56ab78", "one two"), (None, "three")], "doc_id string, text string")
    encoded = bpe.encode(docs)
    assert sorted(map(str, (r.doc_id for r in encoded.collect()))) == ["None", "ab12cd34ef56ab78"]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in bpe.decode(encoded).collect()))) == sorted(map(repr, [("ab12cd34ef56ab78", "one two"), (None, "three")]))


def test_rows(spark, edges):
    rows = bpe.encode_and_decode(edges).collect()
    expected = sorted((repr((r[0], None if r[1] is None else REFERENCE.encode_ordinary(r[1])))) for r in ROWS)
    assert sorted(repr((r.doc_id, r.token_ids)) for r in rows) == expected
    for r in rows:
        assert (r.n_tokens is None) == (r.token_ids is None) == (r.round_trip is None)
        assert r.token_ids is None or (r.round_trip and r.n_tokens == len(r.token_ids))
    assert any(r.doc_id == 7 and r.n_tokens == len(REFERENCE.encode_ordinary(LONG)) for r in rows)


def test_decode(spark, edges):
    back = bpe.decode(bpe.encode(edges)).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back))) == sorted(map(repr, ((r[0], r[1]) for r in ROWS)))
    broken = bpe.decode(spark.createDataFrame([(1, [ENCODER.tokens.index(b"\xff")])], "doc_id long, token_ids array<int>"))
    assert broken.first().text == "�"


def test_empty_table(nothing):
    assert bpe.encode_and_decode(nothing).count() == 0
    assert bpe.lengths(nothing).count() == 0


def test_whole_table(spark, tiny):
    from corpusmill.llm.queries import op1_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {r.doc_id: r.token_ids for r in op1_bpe(spark, tiny).collect()}
    assert got == {k: REFERENCE.encode_ordinary(t) for k, t in texts.items()}
