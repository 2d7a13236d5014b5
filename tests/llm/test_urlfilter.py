import re
from collections import Counter

import pytest

from corpusmill.llm import urlfilter as U
from corpusmill.llm.queries import op3_url_filter


def brute(url, rules):
    hits = [(rule, allow) for _, rule, allow, pattern, _ in U.rule_table(rules) if url is not None and re.search(pattern, url.lower())]
    return bool(hits) and not any(a for _, a in hits), [r for r, _ in hits]


@pytest.mark.parametrize(
    "rule, yes, no",
    [
        ("||ads.example.com^", ["http://ads.example.com/", "https://x.ads.example.com", "ftp://ads.example.com:8080/a"], ["http://bads.example.com/", "http://ads.example.community/", "http://x.com/ads.example.com/"]),
        ("|http://a", ["http://a.b/"], ["https://http://a"]),
        ("end|", ["http://x/end"], ["http://x/end/"]),
        ("/a*b^", ["http://x/aXXb/", "http://x/ab"], ["http://x/abc"]),
        ("a.b+c?(d)", ["http://x/a.b+c?(d)"], ["http://x/aXb+c?(d)"]),
    ],
)
def test_rules(rule, yes, no):
    pattern = re.compile(U.to_regex(rule))
    assert all(pattern.search(u.lower()) for u in yes) and not any(pattern.search(u.lower()) for u in no)
    tokens = U.literal_tokens(rule)
    for u in yes:  # what a rule waits under is a whole token of all that it matches
        assert set(tokens) <= set(re.split("[^a-z0-9]+", u.lower()))


def test_literal_tokens():
    assert U.literal_tokens("||ads.example.com^") == ["ads", "com", "example"]
    assert U.literal_tokens("utm_source=feed") == ["source"]
    assert U.literal_tokens("*x*") == [] and U.literal_tokens("|a|") == ["a"]


def test_pages_against_brute_force(spark, small):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = op3_url_filter(spark, small).collect()
    assert {r.page_id: (r.blocked, r.rules) for r in rows} == {k: brute(u, U.RULES) for k, u in urls.items()}
    assert any(r.blocked for r in rows) and any(not r.blocked and r.rules for r in rows)


def test_edges(spark):
    rules = ("||b.com^", "||b.com^", "^", "@@keep", " ", "/x/")
    urls = [(1, "http://a.b.com/x/"), (2, None), (3, ""), (1, "http://a.b.com/x/"), (None, "http://b.com/keep"), (4, "HTTP://B.COM"), (5, "http://c.com/" + "x" * 100_000 + "/x/")]
    pages = spark.createDataFrame([(k, u, "h", "r", 1, True) for k, u in urls], "page_id long, url string, id string, rules string, number int, blocked boolean")
    for chosen in (rules, (), ("||b.com^",), ("zzz",)):
        rows = U.filter_urls(pages, chosen).collect()
        assert sorted(map(repr, ((r.page_id, r.url, r.blocked, r.rules) for r in rows))) == sorted(map(repr, ((k, u, *brute(u, chosen)) for k, u in urls)))
    assert U.filter_urls(pages.limit(0), rules).count() == 0


def many_rules(draw, n):
    hosts = [f"{a}{k}.example.{b}" for k in range(n // 8) for a, b in [(draw.choice(["ads", "cdn", "img", "blog", "shop"]), draw.choice(["com", "org", "net"]))]]
    made = []
    for k in range(n):
        kind = draw.randrange(6)
        host, word = draw.choice(hosts), f"w{draw.randrange(n // 4)}"
        made.append([f"||{host}^", f"/{word}/*.js|", f"@@||{host}/{word}^", f"{word}=", f"|https://{host}/*{word}", f"||*.{host.split('.')[0]}*^{word}"][kind])
    urls = [f"{draw.choice(['http', 'HTTPS'])}://{draw.choice(['', 'www.'])}{draw.choice(hosts)}/{draw.choice(['', 'a/', 'A/b/'])}w{draw.randrange(n // 4)}{draw.choice(['', '/', '/x.js', '?w%d=1' % draw.randrange(n // 4)])}" for _ in range(400)]
    return tuple(made), urls


def test_many_rules_against_brute_force(spark, monkeypatch):
    import random

    rules, urls = many_rules(random.Random(2), 2_000)
    table = [(k, rule, allow, re.compile(pattern)) for k, rule, allow, pattern, _ in U.rule_table(rules)]
    expected = {}
    for k, u in enumerate(urls):
        hits = [(rule, allow) for _, rule, allow, p in table if p.search(u.lower())]
        expected[k] = (bool(hits) and not any(a for _, a in hits), [r for r, _ in hits])
    pages = spark.createDataFrame([(f"p{k}", u) for k, u in enumerate(urls)], "page_id string, url string")
    for limit in (U.BROADCAST_BYTES, 60_000):  # at once, and in parts
        monkeypatch.setattr(U, "BROADCAST_BYTES", limit)
        assert {int(r.page_id[1:]): (r.blocked, r.rules) for r in U.filter_urls(pages, rules).collect()} == expected
    assert sum(b for b, _ in expected.values()) > 20 and any(not b and r for b, r in expected.values())


def test_only_fetched_rules_are_tried():
    import random

    rules, urls = many_rules(random.Random(3), 2_000)
    counts = Counter(t for u in urls for t in set(U.TOKEN.findall(u.lower())))
    index = U.Index([(k, rule, allow, pattern, min(own, key=lambda t: (counts[t], t)) if own else None) for k, rule, allow, pattern, own in U.rule_table(rules)])
    for u in urls:
        index.matches(u.lower())
    # beyond the rules without a literal token, which are tried on every URL
    assert index.tried - len(urls) * len(index.waiting[None]) < 0.02 * len(urls) * len(index.rules)
