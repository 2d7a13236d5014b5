"""Secret scanning: a keyword automaton first, anchored patterns only near its hits, then checksums.

One Aho-Corasick automaton over all detectors' keywords passes over each text once. At each hit
the detector's pattern is tried, anchored, at a fixed offset before the keyword, so that no pattern ever
scans a text. What matches is validated: by the checksum that the secret carries (CRC-32 in base 62 for code
hosting and package tokens, Luhn for card numbers, the header of a web token), or, for
secrets without one, by the variety of its characters. Invalid matches are not reported.

An assigned value has six characters at least, as fewer can't be varied enough. So that prose and code stay,
a quoted one under 12 characters needs one that is no letter, and an unquoted one under 24 a letter and a digit. No
secret has a greatest length but those whose format fixes it; between the keyword and the sign of an assignment, a name may go on
for 32 characters.

A text is passed over once: the lines that end private keys are found by the same automaton, and overlaps
are told on a map of the characters taken, so the work grows with the text and not with the square of its findings.

Defined results: null and empty texts have no findings; texts are scanned whole; overlapping
matches are one finding, that of the longest match, and of the first detector among equals; repeated rows are each reported; ids of any
type, null ones too, are passed through; an empty table has no findings; ``redact`` keeps other columns as they are, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import math
import string
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from corpusmill.llm.common import id_and_text, replace_texts, slices, with_id

BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase


def crc_ok(secret: str) -> bool:
    """Whether the last six characters are the CRC-32, in base 62, of the 30 before them."""
    body, told = secret.rpartition("_")[2][:-6], secret[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return told == digits


def luhn_ok(secret: str) -> bool:
    digits = [int(c) for c in secret if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def header_ok(secret: str) -> bool:
    """Whether the first part of a web token is JSON that names an algorithm."""
    head = secret.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def varied(secret: str) -> bool:
    """At least 2.5 bits a character: not a placeholder such as xxxx."""
    return -sum(n / len(secret) * math.log2(n / len(secret)) for n in Counter(secret).values()) >= 2.5


def always(secret: str) -> bool:
    return True


class Detector(NamedTuple):
    name: str
    keywords: tuple[str, ...]
    #: Anchored where the keyword begins; the group ``secret``, if any, is the secret.
    pattern: str
    valid: Callable[[str], bool]
    #: Characters that mustn't stand right before the keyword.
    before: str = r"(?<![0-9A-Za-z_])"
    #: If the pattern is a head, all up to the first end, or else a rest: these three, for one pass over a text.
    parts: tuple[str, str, str] | None = None


#: What follows a key's BEGIN line if the END line is missing: its fields, lines of base 64, and a short last line or the text's end within one.
CUT_KEY = r"(?:(?:\s+|(?:\\r)?\\n)(?:Proc-Type|DEK-Info|Version|Comment):[^\r\n]*)*(?:(?:\s+|(?:\\r)?\\n)[0-9A-Za-z+/]{16,}={0,2}(?![0-9A-Za-z+/=]))*(?:(?:\s*\n\s*|(?:\\r)?\\n)[0-9A-Za-z+/]+={0,2}(?=\s*\Z)|(?<=[0-9A-Za-z+/]{40})(?:\s*\n\s*|(?:\\r)?\\n)[0-9A-Za-z+/]+={0,2}(?=[^\S\n]*(?:\n|\\n|[\"'])))?"
KEY_HEAD, KEY_END = (f"-----{side} (?:[A-Z]+ ){{0,3}}PRIVATE KEY-----" for side in ("BEGIN", "END"))
#: Names, or beginnings of names, of what a secret is assigned to.
ASSIGNED = ("token", "secret", "password", "passwd", "passphrase", "pwd", "api_key", "apikey", "api-key", "access_key", "access-key", "accesskey", "private_key", "private-key", "privatekey")

DETECTORS = (
    Detector("code_host_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z_])", crc_ok),
    Detector("package_token", ("npm_",), r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z_])", crc_ok),
    Detector("cloud_access_key", ("AKIA", "ASIA"), r"A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])", varied),
    Detector("web_api_key", ("AIza",), r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])", varied),
    Detector("chat_token", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), r"xox[abprs]-[0-9A-Za-z-]{10,}+", varied),
    Detector("payment_key", ("sk_live_", "rk_live_", "sk_test_"), r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}+", varied),
    Detector("git_token", ("glpat-",), r"glpat-[0-9A-Za-z_-]{20,}+", varied),
    Detector("web_token", ("eyJ",), r"eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]*+", header_ok),
    Detector("private_key", ("-----BEGIN ",), f"{KEY_HEAD}(?:[\\s\\S]*?{KEY_END}|{CUT_KEY})", always, "", (KEY_HEAD, KEY_END, CUT_KEY)),
    Detector(
        "assigned_secret",
        ASSIGNED,
        rf"""(?i:{"|".join(ASSIGNED)})s?(?:[A-Z0-9_-][0-9A-Za-z_-]{{0,31}})?["']?\s{{0,4}}(?:=|:|:=|=>)\s{{0,4}}(?:"(?P<secret>[^\s"]{{12,}}+|(?=[A-Za-z]*[^\sA-Za-z"])[^\s"]{{6,11}})"|'(?P<secret>[^\s']{{12,}}+|(?=[A-Za-z]*[^\sA-Za-z'])[^\s']{{6,11}})'|(?P<secret>[0-9A-Za-z+/_-]{{24,}}+={{0,2}}|(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[0-9A-Za-z+/_-]{{6,23}}={{0,2}})(?![0-9A-Za-z+/_-]))""",
        varied,
        "(?<![0-9A-Za-z])",
    ),
    Detector("card_number", ("card", "visa", "mastercard"), r"(?i:card|visa|mastercard)[^\S\n]{0,3}(?:no\.?|number)?[^\S\n]{0,3}[:=#]?[^\S\n]{0,3}(?P<secret>\d(?:[ -]?\d){12,18})(?!\d)", luhn_ok, "(?<![0-9A-Za-z])"),
)


class Finding(NamedTuple):
    start: int
    end: int
    detector: str


#: How lines begin that end what a detector's head has begun.
END_KEYWORD = "-----END "


class Scanner:
    def __init__(self, detectors: tuple[Detector, ...] = DETECTORS):
        self.detectors = detectors
        self.patterns = [regex.compile(d.before + d.pattern) for d in detectors]
        # the three parts of a pattern that isn't tried as a whole
        self.parts = {k: tuple(regex.compile(p) for p in (d.before + d.parts[0], d.parts[1], d.parts[2])) for k, d in enumerate(detectors) if d.parts}
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int, bool]]] = {}
        for k, d in enumerate(detectors):
            for word in d.keywords:
                owners.setdefault(word.lower(), []).append((k, len(word), False))
            if d.parts:
                owners.setdefault(END_KEYWORD.lower(), []).append((k, len(END_KEYWORD), True))
        for word, those in owners.items():
            self.automaton.add_word(word, those)
        self.automaton.make_automaton()

    def scan(self, text: str, lower: str) -> list[Finding]:
        """``lower`` is the text with ASCII letters in lower case, of the same length."""
        found, heads, ends = [], [], {}
        for end, those in self.automaton.iter(lower):
            for k, size, closes in those:
                at = end + 1 - size
                if closes:
                    if m := self.parts[k][1].match(text, at):
                        ends.setdefault(k, []).append(m.span())
                elif k in self.parts:
                    if m := self.parts[k][0].match(text, at):
                        heads.append((k, at, m.end()))
                elif m := self.patterns[k].match(text, at):
                    group = "secret" if "secret" in m.re.groupindex else 0
                    if self.detectors[k].valid(m.group(group)):
                        found.append((*m.span(group), k))
        for k, at, after in heads:
            closing = ends.get(k, [])
            place = bisect.bisect_left(closing, (after, 0))
            stop = closing[place][1] if place < len(closing) else self.parts[k][2].match(text, after).end()
            found.append((at, stop, k))
        if len(found) > 1:
            found = self.longest(found)
        return sorted(Finding(start, stop, self.detectors[k].name) for start, stop, k in found)

    @staticmethod
    def longest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Of overlapping ones, the longest; of equally long ones, the first detector's, then the first."""
        found.sort(key=lambda f: (f[0] - f[1], f[2], f[0]))
        base = min(f[0] for f in found)
        taken, kept = bytearray(max(f[1] for f in found) - base), []
        for f in found:
            # what was taken before is no shorter, so if it overlaps, it holds one of the two ends
            a, b = f[0] - base, f[1] - base
            if not taken[a] and not taken[b - 1]:
                taken[a:b] = b"\1" * (b - a)
                kept.append(f)
        return kept


def find_in_column(scanner: Scanner, column: pa.Array) -> dict[int, list[Finding]]:
    lower = pc.ascii_lower(column)
    found = {}
    for r, (text, low) in enumerate(zip(column.to_pylist(), lower.to_pylist())):
        if text:
            hits = scanner.scan(text, low)
            if hits:
                found[r] = hits
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, detector, start int, end int) of every secret, in characters, end exclusive; the secrets themselves aren't told."""
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for whole in batches:
            for batch in slices(whole, 1):
                found = [(r, f) for r, hits in find_in_column(scanner, batch.column(1)).items() for f in hits]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([r for r, _ in found])),
                            pa.array([f.detector for _, f in found]),
                            pa.array([f.start for _, f in found], pa.int32()),
                            pa.array([f.end for _, f in found], pa.int32()),
                        ],
                        ["id", "detector", "start", "end"],
                    )

    return rows.mapInArrow(run, with_id(rows, "detector string, start int, end int")).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns, each secret replaced by its detector's name in angle brackets; no shuffle.

    ``chars_col``, if there, is set to the new length of changed texts.
    """

    def change(column: pa.Array) -> dict[int, str | None]:
        changed: dict[int, str | None] = {}
        for r, hits in find_in_column(_scanner(), column).items():
            text, at, kept = column[r].as_py(), 0, []
            for f in hits:
                kept += [text[at : f.start], f"<{f.detector}>"]
                at = f.end
            changed[r] = "".join([*kept, text[at:]])
        return changed

    return replace_texts(docs, text_col, chars_col, change)


_made: list[Scanner] = []


def _scanner() -> Scanner:
    """One scanner for each worker."""
    if not _made:
        _made.append(Scanner())
    return _made[0]
