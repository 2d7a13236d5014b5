"""URL filters whose pattern rules are indexed by their rarest literal token.

Rules are written as in public filter lists: ``||host^`` matches from a host label on, ``|``
is an end of the URL, ``*`` anything, ``^`` one separator or the end, ``@@`` begins an exception.
A literal token is a whole run of letters and digits in a rule, one that the URL must
have as a whole token too. Each rule waits under the token of its own that the fewest URLs of the
corpus have, counted over all of them; a URL's tokens fetch their rules from a table that every worker holds, and only those are
tried as regular expressions, where the URL is: nothing is shuffled but the counts of the rules' tokens. Rules without a
literal token are tried on every URL. If the rules are too large to broadcast at once, they are broadcast and tried in parts.

A URL is blocked if some rule matches it and no exception does.

Defined results: a null URL has no tokens, is matched by no rule and isn't blocked; an empty URL can only be
matched by rules without tokens; URLs are matched whole, in lower case; repeated rows are each
decided; equal rules count once; without rules nothing is blocked; an empty table gives an
empty table; ids of any type, null ones too, are passed through; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import BROADCAST_BYTES, as_type, small_side, with_id

RULES = (
    "||cheap-pills.example.com^",
    "||spam-farm.example.org^",
    "||blog.*.example.net^*/en/",
    "||m.thre*.example.*/de/",
    "utm_source=feed",
    "/page/print/",
    "?page=2&ref=x|",
    "|http://www.*.html|",
    "/*.php?*session",
    "||ads.^",
    "@@||blog.ththan.example.net^",
    "@@/en/1*.html|",
)


def to_regex(rule: str) -> str:
    """The regular expression, for Java and RE2 alike, that stands for a rule without its ``@@``."""
    head, body = "", rule.lower()
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    tail = ""
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    parts = {"*": ".*", "^": "([^a-z0-9_.%-]|$)"}
    return head + "".join(parts.get(c) or (c if re.match(r"[a-z0-9_]", c) or ord(c) > 127 else "\\" + c) for c in body) + tail


def literal_tokens(rule: str) -> list[str]:
    """Whole tokens that any URL matched by the rule must have."""
    body = rule.lower()
    start = body.startswith("|")
    body = body.lstrip("|")
    end = body.endswith("|")
    body = body.rstrip("|")
    found = []
    for m in re.finditer(r"[a-z0-9]+", body):
        left = body[m.start() - 1] if m.start() else ("" if start else "*")
        right = body[m.end()] if m.end() < len(body) else ("" if end else "*")
        if "*" not in (left, right):
            found.append(m.group())
    return sorted(set(found))


def rule_table(rules: tuple[str, ...] = RULES) -> list[tuple[int, str, bool, str, list[str]]]:
    """(number, rule, exception, regex, tokens) of the different rules."""
    rows = []
    for k, rule in enumerate(dict.fromkeys(r.strip() for r in rules if r.strip())):
        allow = rule.startswith("@@")
        body = rule[2:] if allow else rule
        rows.append((k, rule, allow, to_regex(body), literal_tokens(body)))
    return rows


class Index:
    """Rules by the token that they wait under; regular expressions are made when they are first tried."""

    def __init__(self, rules: list[tuple[int, str, bool, str, str | None]]):
        self.rules, self.waiting = {}, {}
        for number, rule, allow, pattern, key in rules:
            self.rules[number] = (rule, allow, pattern)
            self.waiting.setdefault(key, []).append(number)
        self.made: dict[int, re.Pattern] = {}
        self.tried = 0

    def __getstate__(self) -> dict:
        return vars(self) | {"made": {}}

    def matches(self, url: str) -> list[int]:
        """Numbers of the rules that match a URL in lower case."""
        found = []
        for token in {None, *TOKEN.findall(url)}:
            for number in self.waiting.get(token, ()):
                self.tried += 1
                pattern = self.made.get(number) or self.made.setdefault(number, re.compile(self.rules[number][2]))
                if pattern.search(url):
                    found.append(number)
        return found


TOKEN = re.compile("[a-z0-9]+")


def _parts(rules: list[tuple], limit: int) -> Iterator[list[tuple]]:
    """Rules in parts of about ``limit`` bytes; one part, if they are no more."""
    part, size = [], 0
    for rule in rules:
        size += 256 + 4 * len(rule[1])
        if part and size > limit:
            yield part
            part, size = [], 256 + 4 * len(rule[1])
        part.append(rule)
    yield part


def filter_urls(pages: DataFrame, rules: tuple[str, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, blocked boolean, rules array<string>) of every row, with all rules that match, in their order."""
    spark = pages.sparkSession
    table = rule_table(rules)
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), as_type(pages, url_col, "string").alias("url"))
    tokens = F.array_remove(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+")), "")
    wanted, counts = sorted({t for *_, own in table for t in own}), Counter()
    if wanted:
        # the tokens of the rules bound this table, and its rows are what is collected
        side = small_side(spark.createDataFrame([(t,) for t in wanted], "token string"), len(wanted), 64)
        counts.update({r["token"]: r["count"] for r in urls.select(F.explode(tokens).alias("token")).join(side, "token", "left_semi").groupBy("token").count().collect()})
    known = [(k, rule, allow, pattern, min(own, key=lambda t: (counts[t], t)) if own else None) for k, rule, allow, pattern, own in table]
    found = urls.select("id", "url", F.lower("url").alias("lower"), F.lit(None).cast("array<int>").alias("hits"))
    for part in _parts(known, BROADCAST_BYTES):
        found = found.mapInArrow(_matcher(spark.sparkContext.broadcast(Index(part))), with_id(found, "url string, lower string, hits array<int>"))
    names = spark.sparkContext.broadcast([(rule, allow) for _, rule, allow, *_ in known])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [[names.value[k] for k in h or ()] for h in batch.column(3).to_pylist()]
            blocked = [bool(h) and not any(allow for _, allow in h) for h in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocked, pa.bool_()), pa.array([[r for r, _ in h] for h in hits], pa.list_(pa.string()))], ["id", "url", "blocked", "rules"])

    out = found.mapInArrow(decide, with_id(found, "url string, blocked boolean, rules array<string>"))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def _matcher(index: Broadcast):
    """Adds the rules of one part that match to a row's hits; parts come in the order of their rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(h or []) + (sorted(index.value.matches(u)) if u is not None else []) for u, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hits, pa.list_(pa.int32()))], ["id", "url", "lower", "hits"])

    return run


def oracle_sql(rules: tuple[str, ...] = RULES) -> str:
    """DuckDB SQL that tries every rule on every URL."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {text(rule)}, {str(allow).lower()}, {text(pattern)})" for k, rule, allow, pattern, _ in rule_table(rules))
    return f"""
WITH known(number, rule, allow, pattern) AS (VALUES {values}),
hits AS (SELECT p.page_id, list(k.rule ORDER BY k.number) AS rules, NOT bool_or(k.allow) AS blocked
         FROM pages p JOIN known k ON regexp_matches(lower(p.url), k.pattern) GROUP BY p.page_id)
SELECT p.page_id, p.url, coalesce(h.blocked, false) AS blocked, coalesce(h.rules, []::VARCHAR[]) AS rules
FROM pages p LEFT JOIN hits h USING (page_id)"""
