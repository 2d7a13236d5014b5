"""Text normalisation as column functions.

The single steps are built-in expressions, but for Unicode normal forms, which have no built-in. ``normalize`` has to visit
Python for those anyway, so it does all its steps in that one Arrow function, each only on texts that need it; that takes a
fraction of the time that the chain of built-in regular expressions takes. The tests hold the two against each other.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.pieces import by_pieces, strings

#: Python's white space, as members of a Java or RE2 character class.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same without the line feed.
FLAT_SPACE = SPACE.replace(r"\t-\r", r"\t\x{0b}-\r")
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"
CONTROL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]"
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’‚‛′", "“”„‟″"
#: Letters and numbers that aren't decimal digits.
LETTER = r"\p{L}\p{Nl}\p{No}"
#: Marks that continue a word: combining accents and the vowel signs of abugidas.
MARKS = (
    r"\x{300}-\x{36f}\x{483}-\x{489}\x{591}-\x{5bd}\x{5bf}\x{5c1}\x{5c2}\x{5c4}\x{5c5}\x{5c7}\x{610}-\x{61a}\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6dc}\x{6df}-\x{6e8}"
    r"\x{900}-\x{903}\x{93a}-\x{94f}\x{951}-\x{957}\x{962}\x{963}\x{981}-\x{983}\x{9bc}\x{9be}-\x{9cd}\x{9d7}\x{9e2}\x{9e3}\x{a01}-\x{a03}\x{a3c}-\x{a51}"
    r"\x{b82}\x{bbe}-\x{bcd}\x{bd7}\x{e31}\x{e34}-\x{e3a}\x{e47}-\x{e4e}\x{f71}-\x{f84}\x{f86}\x{f87}\x{102b}-\x{103e}"
)
#: A word; one class and no group around it, since nested repeats overflow the stack of Java's matcher on long runs.
WORD = rf"[{LETTER}][{LETTER}{MARKS}]*+(?:['\x{{2019}}-][{LETTER}][{LETTER}{MARKS}]*+)*+"
#: The same for RE2, which has no possessive repeats and needs none.
WORD_RE2 = WORD.replace("*+", "*")
#: Letters, numbers and the underscore.
TOKEN = r"[\p{L}\p{N}_]+"


def _form_udf(form: str):
    return by_pieces("string", lambda texts: strings([t if t is None or t.isascii() or unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t) for t in texts]))


def casefold(text: Column) -> Column:
    return by_pieces("string", lambda texts: strings([t if t is None else t.casefold() for t in texts]))(text)


def normalize_unicode(text: Column, form: str = "NFKC") -> Column:
    return _form_udf(form)(text)


def strip_invisible(text: Column) -> Column:
    """Without zero-width and direction marks and control characters; line feeds, tabs and returns stay."""
    return F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), CONTROL, "")


def fold_quotes(text: Column) -> Column:
    return F.translate(text, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * 5 + '"' * 5)


def collapse_space(text: Column) -> Column:
    """One space for any run but line feeds, at most one empty line between lines, no space at ends of lines."""
    one = F.regexp_replace(text, f"[{FLAT_SPACE}]+", " ")
    lines = F.regexp_replace(one, r"\n[ \n]*\n[ \n]*\n", "\n\n")
    return F.btrim(F.regexp_replace(lines, " *\n *", "\n"), F.lit(" \n"))


def python_class(members: str) -> str:
    """A character class's members as Python writes them."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", members)


_DROPPED = re.compile(python_class(f"[{INVISIBLE[1:-1]}{CONTROL[1:-1]}]+"))
_DROPPED_ASCII = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+")
_OTHER_SPACE = python_class(FLAT_SPACE.replace(r"\x{1c}-\x{20}", r"\x{1c}-\x{1f}"))
_ODD_SPACE = re.compile(f"[{_OTHER_SPACE}]")
_SPACES = re.compile(f" ?[{_OTHER_SPACE}][ {_OTHER_SPACE}]*|  [ {_OTHER_SPACE}]*")
_LINE_END = re.compile(" *\n *")
_LINES = re.compile("\n{3,}")
_QUOTES = [(c, "'") for c in SINGLE_QUOTES] + [(c, '"') for c in DOUBLE_QUOTES]


def normalize_one(text: str | None, form: str = "NFKC", quotes: bool = True) -> str:
    """All steps on one text."""
    if not text:
        return ""
    if text.isascii():
        if _DROPPED_ASCII.search(text):
            text = _DROPPED_ASCII.sub("", text)
    else:
        if _DROPPED.search(text):
            text = _DROPPED.sub("", text)
        if not unicodedata.is_normalized(form, text):
            text = unicodedata.normalize(form, text)
        if quotes:
            for mark, plain in _QUOTES:
                if mark in text:
                    text = text.replace(mark, plain)
    if "  " in text or _ODD_SPACE.search(text):
        text = _SPACES.sub(" ", text)
    if " \n" in text or "\n " in text:
        text = _LINE_END.sub("\n", text)
    if "\n\n\n" in text:
        text = _LINES.sub("\n\n", text)
    return text.strip(" \n")


def normalize(text: Column, form: str = "NFKC", quotes: bool = True) -> Column:
    """All of the above, in this order; a null text becomes an empty one."""

    return by_pieces("string", lambda texts: strings([normalize_one(t, form, quotes) for t in texts]))(text)


def normalize_by_expressions(text: Column, form: str = "NFKC", quotes: bool = True) -> Column:
    """The same, step by step."""
    clean = normalize_unicode(strip_invisible(text), form)
    return F.coalesce(collapse_space(fold_quotes(clean) if quotes else clean), F.lit(""))


def bind(docs: DataFrame, prefix: str, values: dict[str, Column]) -> DataFrame:
    """Adds columns, ``prefix`` before their names, that later expressions use many times over.

    A plain projection may be merged into its uses and then be evaluated, or even planned, once for each; the
    generator keeps it apart.
    """
    return docs.select("*", F.inline(F.array(F.struct(*(v.alias(prefix + k) for k, v in values.items())))))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, numbers and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def lines(text: Column) -> Column:
    """Lines that aren't blank, without space at their ends."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def occurrences(text: Column, what: str) -> Column:
    """How often ``what`` occurs, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / F.lit(len(what))).cast("long")


def doc_id(url: Column) -> Column:
    """Sixteen hexadecimal digits that stand for an address."""
    return F.substring(F.sha2(url, 256), 1, 16)
