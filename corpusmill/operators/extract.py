"""Main text and title of HTML pages.

A page is cut into blocks by its block elements; each block is scored by its length and by how
much of it is links; the run of blocks with the largest sum, after a share of the mean is taken off,
is the text. It is a state machine over tags, so it runs as an Arrow function over batches of pages.
"""

from __future__ import annotations

import re
import statistics
from html import parser, unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.pieces import by_pieces, structs
from corpusmill.operators import exact
from corpusmill.schema import Settings

#: What is inside these isn't text. ``embed`` has no end tag, so what follows one is lost, as it is in the compatible engine.
SKIPPED = frozenset("aside button canvas embed figcaption figure footer form header iframe nav noscript object script select style svg template".split())
#: These begin and end blocks.
BREAKS = frozenset("article blockquote br dd div dt h1 h2 h3 h4 h5 h6 hr li main p pre section td th tr".split())


class Page(parser.HTMLParser):
    """Collects blocks as [pieces of text, characters inside links, is a heading]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = [[[], 0, False]]
        self.title: list[str] | None = None
        self.skipping = self.linking = 0
        self.titling = False

    def cut(self, heading: bool) -> None:
        if any(not piece.isspace() for piece in self.blocks[-1][0]):
            self.blocks.append([[], 0, heading])
        self.blocks[-1][2] = heading

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping += 1
        elif not self.skipping:
            self.titling = self.titling or tag == "title"
            self.linking += tag == "a"
            if tag in BREAKS:
                # any two letters that begin with h are a heading, hr among them
                self.cut(len(tag) == 2 and tag[0] == "h")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipping -= self.skipping > 0
        elif not self.skipping:
            self.titling = self.titling and tag != "title"
            self.linking -= tag == "a" and self.linking > 0
            if tag in BREAKS:
                self.cut(False)

    def handle_data(self, data):
        if self.skipping:
            return
        if self.titling:
            self.title = [*(self.title or []), data]
            return
        block = self.blocks[-1]
        if not data.isspace() and data:
            block[0].append(data)
            block[1] += len(data.strip()) if self.linking else 0
        elif block[0]:
            block[0].append(" ")


def one_space(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def weight(text: str, linked: int, heading: bool) -> float:
    free = 1.0 - min(linked / len(text), 1.0)
    return len(text) * (0.5 * free if heading else free**2)


def best_run(scores: list[float]) -> tuple[int, int]:
    """The slice with the largest sum once half the mean of the capped scores is taken off each; the first of equals."""
    positive = [s for s in scores if s > 0]
    cap = 4 * statistics.median(positive) if positive else 0.0
    off = 0.5 * (sum(min(s, cap) for s in scores) / len(scores))
    best, found, total, begin = float("-inf"), (0, 1), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += score - off
        if total > best:
            best, found = total, (begin, k + 1)
    return found


def extract_page(source: str | None, min_block_chars: int = 25) -> tuple[str, str | None]:
    if not source or source.isspace():
        return "", None
    page = Page()
    try:
        page.feed(source)
        page.close()
    except Exception:  # noqa: BLE001  what was parsed of a page that the parser can't take is still used
        pass
    title = one_space(unescape("".join(page.title))) if page.title else None
    blocks = [(one_space("".join(pieces)), linked, heading) for pieces, linked, heading in page.blocks]
    blocks = [b for b in blocks if b[0]]
    if not blocks:
        return "", title or None
    begin, end = best_run([weight(*b) for b in blocks])
    while begin and blocks[begin - 1][2]:  # headings right above belong to the text
        begin -= 1
    return "\n\n".join(text for text, _, heading in blocks[begin:end] if heading or len(text) >= min_block_chars), title or None


def extract(source: Column, min_block_chars: int = 25) -> Column:
    """struct<text, title> of a column of HTML."""

    return by_pieces("text string, title string", lambda pages: structs([extract_page(p, min_block_chars) for p in pages], {"text": pa.string(), "title": pa.string()}))(source)


def prepare(docs: DataFrame, settings: Settings = Settings(), digest_col: str | None = None) -> DataFrame:
    """Texts are extracted where only HTML is given, titles filled in, texts normalised; ``html`` goes.

    ``digest_col``, if given, is added: the ``exact.digest`` of the text, made in the same worker.
    """
    only_html = (F.coalesce(F.length("text"), F.lit(0)) == 0) & (F.coalesce(F.length("html"), F.lit(0)) > 0)
    least, form, level = settings.min_block_chars, settings.unicode_form, settings.exact_level
    fields = dict.fromkeys(["text", "title"] + ["digest"] * bool(digest_col), pa.string())

    def run(texts: list[str | None], pages: list[str | None]) -> pa.Array:
        found = [extract_page(page, least) if page else (text, None) for text, page in zip(texts, pages)]
        rows = [(T.normalize_one(text, form), title) for text, title in found]
        return structs([(*row, exact.digest_one(exact.canonical_one(row[0], level))) for row in rows] if digest_col else rows, fields)

    # the source is made null where it isn't needed
    docs = docs.withColumn("_e", by_pieces(", ".join(f"{k} string" for k in fields), run, columns=2)(F.col("text"), F.when(only_html, F.col("html"))))
    title = F.when(only_html, F.coalesce("title", "_e.title")).otherwise(F.col("title"))
    done = {"title": title, "text": F.col("_e.text")} | ({digest_col: F.col("_e.digest")} if digest_col else {})
    return docs.withColumns(done).drop("html", "_e")
