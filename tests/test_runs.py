import json
import subprocess
import sys

import pytest
from paths import ROOT
from test_quality import GOOD

from corpusmill import cli
from corpusmill.plans import corpus
from corpusmill.schema import Settings
from corpusmill.streaming import crawl

PLACES, THINGS = "mill bridge tower market chapel quarry orchard station library harbour".split(), "wagons lanterns barrels ladders blankets hammers baskets mirrors candles kettles".split()
OTHER = " ".join(f"People near the {p} sold {t} on the {k}th day, and {THINGS[k - 1]} came to the {PLACES[-k]} by night." for k, (p, t) in enumerate(zip(PLACES, THINGS), 1))
NEAR = OTHER.replace("lanterns on", "pictures on", 1)
HTML = f"<html><head><title>Port</title></head><body><nav><a href='/'>Start page of it</a></nav><p>{GOOD}</p></body></html>"
LINES = [
    {"url": "a", "text": GOOD}, {"url": "b", "html": HTML}, {"url": "c", "text": OTHER}, {"url": "d", "text": NEAR}, {"url": "e", "text": "Too short."},
    {"url": "f", "text": "  "}, {"url": "g", "text": "Too short!"}, {"url": "h", "text": GOOD, "crawled_at": "2020-01-01T00:00:00+00:00"},
]
REASONS = {"a": None, "b": "exact_duplicate", "c": None, "d": "near_duplicate", "e": "quality", "f": "empty", "g": "exact_duplicate", "h": "exact_duplicate"}


@pytest.fixture
def crawl_file(tmp_path):
    path = tmp_path / "crawl.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in LINES) + "\nbroken\n")
    return path


def frame(spark):
    rows = [(k, x["url"], x.get("text"), x.get("html"), None, x.get("crawled_at")) for k, x in enumerate(LINES)]
    return spark.createDataFrame(rows, "ord long, url string, text string, html string, title string, crawled_at string")


def test_every_row_is_accounted_for(spark):
    found = corpus.annotate(frame(spark)).cache()
    assert {r.url: r.drop_reason for r in found.collect()} == REASONS
    s = corpus.stats(found, 1)
    assert s["seen"] == s["kept"] + s["dropped"] + s["malformed"] == 9 and s["kept"] == 2 and s["keep_rate"] == 0.2222
    assert s["dropped_by_stage"] == {"empty": 1, "exact_duplicate": 3, "quality": 1, "near_duplicate": 1} and "word_count" in s["quality_failures"]
    assert "kept" in corpus.render(s)
    rows = {r.url: r for r in corpus.kept(found).collect()}
    assert rows["a"].language == "latin" and rows["a"].crawled_at and len(rows["a"].doc_id) == 16 and rows["a"].signatures.raw


def test_switches(spark):
    found = corpus.annotate(frame(spark), Settings(run_quality=False, run_near_dedup=False))
    assert {r.url for r in found.where("drop_reason IS NULL").collect()} == {"a", "c", "d", "e"}
    for bad in ({"exact_level": "x"}, {"bands": 3}, {"unicode_form": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_the_order_decides_whatever_the_partitions(spark):
    one, eight = ({r.url: r.drop_reason for r in corpus.annotate(frame(spark).repartition(n)).collect()} for n in (1, 8))
    assert one == eight == REASONS


def test_build_command(spark, crawl_file, tmp_path, capsys):
    out = tmp_path / "out"
    assert cli.main(["build", str(crawl_file), "-o", str(out), "--shard-size", "1"]) == 0
    report = json.loads((out / "stats.json").read_text())
    assert report["stats"]["seen"] == 9 and report["stats"]["malformed"] == 1 and report["manifest"]["shard_count"] == 2
    assert cli.main(["build", str(crawl_file), "-o", str(tmp_path / "s"), "--strict", "--no-dedup"]) == 1
    assert json.loads((tmp_path / "s" / "stats.json").read_text())["stats"]["kept"] == 3
    assert cli.main(["build", str(crawl_file), "-o", str(tmp_path / "m"), "--max-malformed", "1", "--no-quality", "--no-compress"]) == 0
    for bad in (["--max-malformed", "0"], ["--strict", "--max-malformed", "2"], ["--shard-size", "0"]):
        with pytest.raises(SystemExit) as e:
            cli.main(["build", str(crawl_file), "-o", str(out), *bad])
        assert e.value.code == 2


def test_other_commands(spark, crawl_file, tmp_path, capsys):
    assert cli.main(["assess", str(crawl_file), "-v"]) == 0
    said = capsys.readouterr()
    assert "documents   8" in said.err and "would pass  5" in said.err and "e\tword_count" in said.out
    assert cli.main(["assess", str(crawl_file), "--sample", "3", "--seed", "1"]) == 0
    assert "documents   3" in capsys.readouterr().err
    assert cli.main(["dedup", str(crawl_file)]) == 0
    assert "d\tDUPLICATE_OF\tc\t0." in capsys.readouterr().out
    (tmp_path / "p.html").write_text(HTML)
    assert cli.main(["extract", str(tmp_path / "p.html"), "--json"]) == 0
    assert json.loads(capsys.readouterr().out) == {"title": "Port", "text": GOOD}


def test_piped_lines_versions_and_progress(spark, crawl_file, tmp_path, capsys, monkeypatch):
    import io

    monkeypatch.setattr(cli, "PIPE_LINES", 3)
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(crawl_file.read_bytes())))
    assert cli.main(["build", "-", "-o", str(tmp_path / "out"), "--progress-every", "4"]) == 0
    said = capsys.readouterr().err
    assert json.loads((tmp_path / "out" / "stats.json").read_text())["stats"]["kept"] == 2
    assert "... 4\n... 8\n" in said and "... near_duplicate: 2 left" in said
    for command in ("build", "assess", "dedup", "extract"):
        with pytest.raises(SystemExit) as e:
            cli.main([command, "--version"])
        assert e.value.code == 0 and capsys.readouterr().out.strip() == cli.VERSION


def test_stages_are_reported(spark):
    told = []
    corpus.annotate(frame(spark), on_progress=lambda stage, rows: told.append((stage, rows)))
    assert told == [("prepared", 8), ("exact_duplicate", 4), ("near_duplicate", 2)]


def test_stream_equals_its_batches(spark, tmp_path):
    for k, part in enumerate((LINES[:4], LINES[4:], LINES[:2])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(json.dumps(x) for x in part) + "\nbroken\n")
        crawl.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out" / "kept"))
    assert sorted((r.batch, r.url) for r in kept.collect()) == [(0, "a"), (0, "c")]
    counts = {r.batch: (r.seen, r.malformed, r.kept) for r in spark.read.parquet(str(tmp_path / "out" / "counts")).collect()}
    assert counts == {0: (5, 1, 2), 1: (5, 1, 0), 2: (3, 1, 0)}


def test_entry_without_the_training_data_operators(tmp_path):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("corpus_pipeline", "corpusmill.llm")):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
assert "quality_report" in e.queries() and "pipeline" not in e.queries() and not any(q.startswith("op") for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
