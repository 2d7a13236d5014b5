import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import ROWS

from corpusmill.llm import langid as L
from corpusmill.llm.common import Words


def plain_subwords(text):
    """Runs of 2, 3 and 4 bytes of ' word ' in which spaces are at the ends alone."""
    words = Words(pa.array([text]))
    stream = b" " + bytes(np.where(words.mask, words.data, 32).astype(np.uint8)) + b" " * 5
    out = []
    for size in L.SIZES:
        runs = [stream[k : k + size] for k in range(len(words.data) + 1)]
        out.append([(r.strip() != b"") if size == 2 else b" " not in r[1:-1] for r in runs])
    return out


@pytest.mark.parametrize("text", ["a", "ab cd", "Été à l’île", "  x ", "", "...", "word, word"])
def test_subwords(text):
    buckets, starts = L.subwords(pa.array([text]))
    for b, some in zip(buckets, plain_subwords(text)):
        assert (b[: len(some)] < L.BUCKETS).tolist() == some
    same, _ = L.subwords(pa.array(["zz", text, None]))
    a = 3  # the first text and the space before it
    for x, y in zip(buckets, same):
        n = len(text.encode()) + 1
        assert (x[:n] == y[a : a + n]).all()


@pytest.fixture(scope="module")
def answers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, L.identify(docs, docs.where("doc_id % 2 = 0"))


def test_held_out_accuracy(answers):
    docs, found = answers
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1").collect()
    assert len(rows) == 500
    assert sum(r.language == r.lang for r in rows) >= 0.98 * len(rows)
    taken = [r for r in rows if r.accepted]
    assert len(taken) >= 0.95 * len(rows) and sum(r.language == r.lang for r in taken) >= 0.99 * len(taken)


def test_one_pass_is_the_plain_sum():
    rng = np.random.default_rng(0)
    table = np.concatenate([rng.normal(0, 1, (L.BUCKETS, 3)), np.zeros((1, 3))]).astype(np.float32)
    model = L.Model(["a", "b", "c"], table)
    texts = ["one two", None, "", "drei vier fünf " * 50, "x"]
    logits, some = model.logits(pa.array(texts))
    assert some.tolist() == [True, False, False, True, True]
    for text, row in zip(texts, logits):
        buckets, _ = L.subwords(pa.array([text]))
        b = np.concatenate([x[x < L.BUCKETS] for x in buckets])
        assert np.allclose(row, table[b].mean(axis=0) if len(b) else 0, atol=1e-4)


def test_unseen_scripts_are_rejected(spark, answers):
    docs, _ = answers
    foreign = spark.createDataFrame([(1, "Привет, как у вас дела сегодня утром?"), (2, "漢字と仮名の文章です")], "doc_id long, text string")
    assert not any(r.accepted for r in L.identify(foreign, docs).collect())


def test_edges(edges, nothing, answers):
    docs, _ = answers
    rows = L.identify(edges, docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id in (3, 4, 5, 6, 11):
            assert (r.language, r.confidence, r.accepted) == (None, 0.0, False)
    assert len({(r.language, r.confidence) for r in rows if r.doc_id in (1, 2)}) == 1
    assert L.identify(nothing, docs).count() == 0
    assert not any(r.accepted or r.language for r in L.identify(edges, nothing).collect())
    assert L.identify(edges).count() == len(ROWS)


def rows_of(n, draw):
    kinds = {"en": "the house of the river and the people who were there with it", "fr": "la maison de la rivière et les gens qui étaient là avec elle", "de": "das haus am fluss und die leute die dort mit ihm waren"}
    return [(k, " ".join(draw.choices(kinds[x].split(), k=20)), x) for k in range(n) for x in [list(kinds)[k % 3]]]


@pytest.mark.parametrize("n", [1, 2, 4, 5, 12, 24, 30])
def test_few_labels(spark, n):
    """With a held-out row that is rightly named there is a limit; without one nothing is accepted."""
    import random

    docs = spark.createDataFrame(rows_of(n, random.Random(n)), "doc_id long, text string, lang string")
    found = L.identify(docs).collect()
    assert len(found) == n and all(r.language in ("en", "fr", "de") for r in found)
    model = L.fit(docs, "doc_id", "text", "lang")
    assert any(r.accepted for r in found) == (model.limit <= 1)
    if n < 5:
        assert model.limit > 1
    if n >= 24:
        assert sum(r.accepted for r in found) > n / 2


def test_limit_rejects_the_share_asked_for():
    rng = np.random.default_rng(0)
    logits, y = rng.normal(0, 1, (5000, 3)), np.zeros(5000, np.int64)
    logits[:, 0] += 4
    model = L.calibrate(L.Model(["a", "b", "c"], np.zeros((1, 3))), logits, y)
    p = L.softmax(logits / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == 0]
    assert (right < model.limit).sum() == int(L.REJECTED * len(right)) > 0


def test_the_query_over_its_whole_table(spark, tiny):
    """Against one text after the other, with the plain sum over its subwords."""
    from corpusmill.llm.queries import op8_language_id

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = L.fit(docs, "doc_id", "text", "lang")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op8_language_id(spark, tiny).collect()
    assert len(rows) == len(texts)
    for r in rows:
        buckets, _ = L.subwords(pa.array([texts[r.doc_id]]))
        b = np.concatenate([x[x < L.BUCKETS] for x in buckets])
        p = L.softmax(model.table[b].astype(float).mean(axis=0)[None] / model.temperature)[0] if len(b) else np.zeros(1)
        assert np.isclose(r.confidence, p.max(), atol=1e-5) and (not len(b) or p[model.languages.index(r.language)] >= p.max() - 1e-5)
        if abs(p.max() - model.limit) > 1e-5:
            assert r.accepted == (len(b) > 0 and p.max() >= model.limit)


def test_windows_of_long_texts_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    model = L.Model(["a", "b"], np.concatenate([rng.normal(0, 1, (L.BUCKETS, 2)), np.zeros((1, 2))]).astype(np.float32))
    texts = pa.array(["été à l’île " * 40, None, "", "x", "drei vier fünf " * 30, "!!", "漢字 kana"])
    whole = model.logits(texts)
    for step in (1, 7, 64, 400):
        monkeypatch.setattr(L, "_STEP", step)
        for a, b in zip(model.logits(texts), whole):
            assert np.allclose(a, b, atol=1e-4)


def test_ids_of_any_type_and_repeated_labels(spark):
    import random

    rows = [(f"id-{k}", t, x) for k, t, x in rows_of(40, random.Random(3))]
    docs = spark.createDataFrame([*rows, *[rows[0]] * 5, (None, "the people", "en"), ("z", None, "en"), ("y", "the house", None)], "doc_id string, text string, lang string")
    found = L.identify(docs).collect()
    assert len(found) == 48 and {r.doc_id for r in found} == {r[0] for r in rows} | {None, "z", "y"}
    assert next(r for r in found if r.doc_id == "z").accepted is False
