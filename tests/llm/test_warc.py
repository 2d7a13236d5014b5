import gzip
import hashlib
import io
import random

import pytest

from corpusmill.llm import warc as W
from corpusmill.llm.queries import op5_warc_normalise


def archive(bodies):
    return b"".join(W.record_header(str(k), f"http://x/{k}", len(b)) + b + b"\r\n\r\n" for k, b in enumerate(bodies))


BODIES = [b"", b"hello", random.Random(1).randbytes(3_000_000), b"\r\n\r\n", b"WARC/1.0\r\nfake: 1\r\n\r\n", "é漢".encode(), b"hello"]


def run(data):
    out = io.BytesIO()
    rows = list(W.rewrite(io.BytesIO(data), out, "f"))
    return rows, out.getvalue()


@pytest.mark.parametrize("members", [1, 3, 100])
def test_every_record_becomes_a_member(members):
    plain = archive(BODIES)
    step = -(-len(plain) // members)
    rows, out = run(b"".join(gzip.compress(plain[k : k + step]) for k in range(0, len(plain), step)))
    assert [r["payload_bytes"] for r in rows] == [len(b) for b in BODIES]
    assert [r["payload_sha1"] for r in rows] == [hashlib.sha1(b).hexdigest() for b in BODIES]
    assert gzip.decompress(out) == plain
    for r, body in zip(rows, BODIES):
        member = gzip.decompress(out[r["offset"] : r["offset"] + r["length"]])
        assert member.startswith(b"WARC/1.0\r\n") and member.endswith(body + b"\r\n\r\n")
    assert sum(r["length"] for r in rows) == len(out)


def test_broken_streams_keep_what_is_complete():
    plain = archive([b"one", b"two" * 1000])
    rows, out = run(gzip.compress(plain)[:-30])
    assert rows[0]["error"] is None and "EOFError" in rows[-1]["error"] and len(rows) == 2
    assert gzip.decompress(out) == archive([b"one"])
    assert run(b"") == ([], b"")
    assert run(gzip.compress(b"")) == ([], b"")
    for bad in (b"not gzip", gzip.compress(b"no header at all"), gzip.compress(b"HTTP/1.1\r\n\r\n"), gzip.compress(b"WARC/1.0\r\nX: 1\r\n\r\n"), gzip.compress(b"WARC/1.0\r\nContent-Length: x\r\n\r\n")):
        rows, out = run(bad)
        assert len(rows) == 1 and rows[0]["error"] and out == b""


def test_files_and_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.warc.gz").write_bytes(gzip.compress(archive(BODIES[k:])))
    (tmp_path / "in" / "empty.warc.gz").write_bytes(b"")
    paths = spark.createDataFrame([(str(p),) for p in (tmp_path / "in").iterdir()] + [(None,)], "path string")
    index = W.normalise(paths, f"file://{tmp_path}/out")
    rows = index.collect()
    assert len(rows) == sum(len(BODIES) - k for k in range(3)) and not any(r.error for r in rows)
    for r in rows:
        known, body = W.read_record(f"{tmp_path}/out/{r.file}", r.offset, r.length)
        assert known["warc-record-id"] == r.record_id and hashlib.sha1(body).hexdigest() == r.payload_sha1
    for k in range(3):
        lines = (tmp_path / "out" / f"{k}.warc.gz.idx").read_text().splitlines()
        assert [x.split("\t")[:2] for x in lines] == [[str(r.offset), str(r.length)] for r in sorted(rows, key=lambda r: r.record) if r.file == f"{k}.warc.gz"]
    assert (tmp_path / "out" / "empty.warc.gz.idx").read_text() == ""
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]


def test_pages(spark, tiny):
    pages = {r.page_id: r for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    rows = op5_warc_normalise(spark, tiny).collect()
    assert {r.page_id: (r.uri, r.payload_sha1) for r in rows} == {k: (p.url, hashlib.sha1(p.html.encode()).hexdigest()) for k, p in pages.items()}
    assert len(rows) == len(pages)


def test_edges(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: 1", "<p>"), (1, "http://a/\r\nX: 1", "<p>"), (2, None, None), (None, "", ""), (3, "u", "é" * 500_000)]
    pages = spark.createDataFrame([(*r, "f", 1, "e") for r in rows], "page_id long, url string, html string, file string, offset int, error string")
    got = W.normalised_pages(pages, f"file://{tmp_path}/out").collect()
    assert sorted(map(repr, ((r.page_id, r.uri, r.payload_bytes) for r in got))) == sorted(map(repr, [(1, "http://a/%0D%0AX: 1", 3), (1, "http://a/%0D%0AX: 1", 3), (2, None, 0), (None, "", 0), (3, "u", 1_000_000)]))
    assert W.normalised_pages(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_long_header_and_bad_record_lose_no_other(spark, tmp_path):
    long = "http://x/" + "a" * 3_000_000
    pages = spark.createDataFrame([(1, "u", "one"), (2, long, "two"), (3, "v", "three")], "page_id long, url string, html string").coalesce(1)
    got = sorted((r.page_id, r.uri, r.payload_bytes, r.error) for r in W.normalised_pages(pages, f"file://{tmp_path}/out").collect())
    assert got == [(1, "u", 3, None), (2, long, 3, None), (3, "v", 5, None)]
    first, last = archive([b"one"]), archive([b"two", b"three"])
    for bad in (b"WARC/1.0\r\nX: 1\r\n\r\nbody\r\n\r\n", b"WARC/1.0\r\nContent-Length: x\r\n\r\n\r\n\r\n", b"WARC/1.0\r\nContent-Length: -4\r\n\r\nbody\r\n\r\n", b"junk" * 1_000_000 + b"\r\n\r\n"):
        rows, out = run(gzip.compress(first + bad + last))
        assert [r["payload_bytes"] for r in rows] == [3, None, 3, 5] and [r["record"] for r in rows] == [0, 1, 2, 3]
        assert rows[1]["error"] and gzip.decompress(out) == first + last


def test_files_of_one_name_are_an_error(spark, tmp_path):
    for k, folder in enumerate("ab"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.warc.gz").write_bytes(gzip.compress(archive([str(k).encode()])))
    paths = [(f"{tmp_path}/{f}/same.warc.gz",) for f in "ab"]
    with pytest.raises(ValueError, match="2 files are named same.warc.gz"):
        W.normalise(spark.createDataFrame(paths, "path string"), f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()
    assert W.normalise(spark.createDataFrame(paths[:1] * 2, "path string"), f"file://{tmp_path}/out").count() == 1


def test_ids_of_any_type(spark, tmp_path):
    rows = [("ab12cd34ef56ab78", "u", "one"), (None, "u", "two"), ("null", "u", "three"), ("", "u", "four"), ("a>b", "u", "five")]
    got = W.normalised_pages(spark.createDataFrame(rows, "page_id string, url string, html string"), f"file://{tmp_path}/out").collect()
    assert sorted(map(repr, ((r.page_id, r.payload_bytes) for r in got))) == sorted(map(repr, ((i, len(b)) for i, _, b in rows)))
