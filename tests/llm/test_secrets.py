import base64
import json
import random
import string
import zlib

import regex

from corpusmill.llm import secrets as X
from corpusmill.llm.queries import op4_secret_scan


def token(prefix, draw, valid=True):
    body = "".join(draw.choices(string.ascii_letters + string.digits, k=30))
    value, end = zlib.crc32(body.encode()) ^ (not valid), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        end = X.BASE62[d] + end
    return prefix + body + end


def brute(text):
    """Every pattern at every place, with no automaton."""
    found = []
    for k, d in enumerate(X.DETECTORS):
        pattern = regex.compile(d.before + d.pattern)
        for at in range(len(text)):
            m = pattern.match(text, at)
            if m:
                group = "secret" if "secret" in m.re.groupindex else 0
                if d.valid(m.group(group)):
                    found.append((*m.span(group), k))
    kept = []
    for a, b, k in sorted(found, key=lambda f: (f[0] - f[1], f[2], f[0])):
        if all(b <= s or a >= e for s, e, _ in kept):
            kept.append((a, b, k))
    return sorted((a, b, X.DETECTORS[k].name) for a, b, k in kept)


def samples(draw):
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    fake = base64.urlsafe_b64encode(json.dumps({"al": "HS256"}).encode()).decode().rstrip("=")
    alnum = string.ascii_letters + string.digits
    return [
        token("ghp_", draw), token("ghs_", draw, False), token("npm_", draw), token("npm_", draw, False), "x" + token("gho_", draw), token("ghu_", draw) + "z",
        "AKIA" + "".join(draw.choices(string.ascii_uppercase + string.digits, k=16)), "AKIA" + "A" * 16, "AIza" + "".join(draw.choices(alnum, k=35)),
        "xoxb-" + "".join(draw.choices(alnum, k=30)), "sk_live_" + "".join(draw.choices(alnum, k=24)), "glpat-" + "".join(draw.choices(alnum, k=20)),
        f"{head}.eyJzdWIiOiIxMjM0In0.abcdef", f"{fake}.eyJzdWIiOiIxMjM0In0.abcdef", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----",
        'token = "' + "".join(draw.choices("0123456789abcdef", k=40)) + '"', "PASSWORD: 'hunter2hunter2!'", "api_key=xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "tokens are words", "card: 4111 1111 1111 1111", "card: 4111 1111 1111 1112", "İ secret = \"a1b2c3d4e5f6g7\"",
    ]


def test_scan_against_brute_force():
    draw, scanner, seen = random.Random(1), X.Scanner(), set()
    for _ in range(30):
        parts = [draw.choice(["word ", "\n", "—", " é "]) + s for s in draw.sample(samples(draw), 6)]
        text = "".join(parts)
        lower = "".join(c.lower() if c.isascii() else c for c in text)
        got = [tuple(f) for f in scanner.scan(text, lower)]
        assert got == brute(text)
        seen |= {f[2] for f in got}
    assert seen == {d.name for d in X.DETECTORS}


def test_checksums():
    draw = random.Random(2)
    assert X.crc_ok(token("ghp_", draw)) and not X.crc_ok(token("ghp_", draw, False))
    assert X.luhn_ok("4111 1111 1111 1111") and not X.luhn_ok("4111111111111112")
    assert not X.header_ok("eyJ!!.x.y") and not X.header_ok("eyJhbGci.x.y")
    assert X.varied("0123456789abcdef") and not X.varied("x" * 32)


def test_documents_against_brute_force(spark, tiny):
    got = sorted((r.doc_id, r.start, r.end, r.detector) for r in op4_secret_scan(spark, tiny).collect())
    keywords = regex.compile("|".join(regex.escape(w) for d in X.DETECTORS for w in d.keywords), regex.I)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    assert got == sorted((r.doc_id, *f) for r in docs if keywords.search(r.text) for f in brute(r.text))


def test_edges(spark, edges, nothing):
    rows = X.find_secrets(edges).collect()
    assert [(r.doc_id, r.detector, r.start, r.end) for r in rows] == [(-5, "assigned_secret", 18, 50)]
    out = X.redact(edges)
    assert out.schema == edges.schema and out.count() == edges.count()
    r = out.where("doc_id = -5").first()
    assert r.text == 'he wrote token = "<assigned_secret>" there' and r.n_chars == len(r.text) and r.keep is True
    assert out.where("doc_id <> -5 OR doc_id IS NULL").exceptAll(edges.where("doc_id <> -5 OR doc_id IS NULL")).count() == 0
    assert X.find_secrets(nothing).count() == 0 and X.redact(nothing).count() == 0
    twice = spark.createDataFrame([(None, 'token = "0123456789abcdef0"')] * 2, "doc_id long, text string")
    assert X.find_secrets(twice).count() == 2


def test_names_and_short_values_of_assignments():
    found = {
        'SECRET_KEY = "a1b2c3d4e5f6g7"': "a1b2c3d4e5f6g7", 'token_key: "0123456789abcdef"': "0123456789abcdef", "secretKey: 'a1b2c3d4e5f6g7'": "a1b2c3d4e5f6g7",
        "private_key=a1b2c3d4e5f6g7": "a1b2c3d4e5f6g7", "passphrase: 'open-5esame'": "open-5esame", "DB_PWD=hunter42x": "hunter42x",
        "password=Tr0ub4dor-and-3x": "Tr0ub4dor-and-3x", 'password = "s3cr3t!x"': "s3cr3t!x",
    }
    for text, secret in found.items():
        hits = X.Scanner().scan(f"x {text} y", f"x {text} y".lower())
        assert [f"x {text} y"[f.start : f.end] for f in hits] == [secret], text
        assert [tuple(f) for f in hits] == brute(f"x {text} y")
    for text in ("the password: something new", 'tokenizer = "bert-base-uncased"', "token = get_token()", 'password: "required"', "pwd=aaaaaaaa1", "secret: 12345678"):
        assert not X.Scanner().scan(text, text.lower()), text


def test_private_key_without_its_end():
    draw = random.Random(3)
    lines = ["".join(draw.choices(string.ascii_letters + string.digits + "+/", k=64)) for _ in range(4)]
    head = "-----BEGIN RSA PRIVATE KEY-----"
    for body, after in (
        ("\n" + "\n".join(lines), "\n\nThen the text goes on."), ("\r\n" + "\r\n".join([*lines, "c2hvcnQ="]), "\r\nand on"), ("\n" + "\n".join([*lines, "Yw"]), ""), ("\nMIIEv", ""),
        ("\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + "\n".join(lines), "\n"), ("\\n" + "\\n".join(lines), '\\n"}'), ("", "\nno key here"),
    ):
        text = f"see {head}{body}{after}"
        assert [tuple(f) for f in X.Scanner().scan(text, text.lower())] == [(4, 4 + len(head + body), "private_key")] == brute(text), (body, after)


def scan(text):
    return [tuple(f) for f in X.Scanner().scan(text, "".join(c.lower() if c.isascii() else c for c in text))]


def test_secrets_of_any_length():
    draw = random.Random(4)
    alnum = string.ascii_letters + string.digits
    for n in (300, 10_000):
        body = "".join(draw.choices(alnum, k=n))
        for head, tail, name in (
            ('token = "', '"', "assigned_secret"), ("secret: '", "'", "assigned_secret"), ("api_key=", " z", "assigned_secret"), ("see xoxb-", " z", "chat_token"), ("see sk_live_", " z", "payment_key"),
            ("see glpat-", " z", "git_token"),
        ):
            text = head + body + tail
            (start, stop, found), = scan(text)
            assert found == name and stop == len(head) + n and text[start:stop].endswith(body)
        assert scan('token = "' + "".join(draw.choices("0123456789abcdef", k=n)) + '"')[0][1] == 9 + n


def test_work_grows_with_the_text():
    import time

    draw, took = random.Random(5), []
    parts = ['token = "' + "".join(draw.choices("0123456789abcdef", k=20)) + '"\n' for _ in range(32_000)]
    keys = "-----BEGIN PRIVATE KEY-----\nabc\n"
    for n in (4_000, 32_000):
        text = "".join(parts[:n]) + keys * n
        began = time.perf_counter()
        found = scan(text)
        took.append(time.perf_counter() - began)
        assert len(found) >= 1.99 * n  # a few values are too little varied
    assert took[1] < 8 * took[0] * 4


def test_keys_that_end_and_keys_that_do_not_agree_with_the_whole_pattern():
    draw = random.Random(6)
    pieces = ["-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "-----END PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\n", "\n" + "aB3/" * 16 + "\n", " words ", "-----END CERTIFICATE-----", "-----BEGIN ", "\nq8=\n"]
    for _ in range(300):
        text = "".join(draw.choices(pieces, k=8))
        assert scan(text) == brute(text), text


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("ab12cd34ef56ab78", 'token = "0123456789abcdef0"'), (None, "none")], "doc_id string, text string")
    assert [(r.doc_id, r.start) for r in X.find_secrets(docs).collect()] == [("ab12cd34ef56ab78", 9)]
