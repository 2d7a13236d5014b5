"""Quality rules: every rule reports its value and threshold for every document.

The rules that apply depend on the script: text without spaces between words is measured in
letters, scripts without terminal punctuation aren't asked for it, dense scripts may have shorter
words. Words, lines and letters are counted in one Arrow function; the rules are built-in expressions on the counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import script as S
from corpusmill.functions import text as T
from corpusmill.functions.pieces import by_pieces, structs

BULLETS = "-*•‣◦⁃"
ELLIPSES = ("...", "…")
SENTENCE_ENDS = ".!?。！？।॥۔။։"
MARKERS = (
    "404 not found", "all rights reserved", "cookie policy",
    "enable javascript", "javascript is disabled", "lorem ipsum", "403 forbidden", "privacy policy", "access denied", "terms of use",
)
DEFAULT_RULES = (
    "word_count", "mean_word_length", "symbol_to_word_ratio", "alpha_word_ratio", "bullet_line_ratio",
    "ellipsis_line_ratio", "terminal_punctuation_ratio", "repetition_ratio", "boilerplate_markers",
)
UNSPACED_RULES = ("char_count", "symbol_to_char_ratio", "bullet_line_ratio", "ellipsis_line_ratio", "terminal_punctuation_ratio", "repetition_ratio", "boilerplate_markers")
RULES = (*DEFAULT_RULES, *UNSPACED_RULES[:2])
#: (least, most) of each rule's value.
LIMITS: dict[str, tuple[float | None, float | None]] = {
    "word_count": (50, 100_000), "mean_word_length": (3.0, 10.0), "symbol_to_word_ratio": (None, 0.10), "alpha_word_ratio": (0.80, None),
    "bullet_line_ratio": (None, 0.90), "ellipsis_line_ratio": (None, 0.30), "terminal_punctuation_ratio": (0.15, None),
    "repetition_ratio": (None, 0.30), "boilerplate_markers": (None, 2), "char_count": (80, 400_000), "symbol_to_char_ratio": (None, 0.05),
}
#: Least mean word length in dense scripts.
DENSE_WORD_LENGTH = 1.8
RULE_TYPE = "struct<name:string,passed:boolean,value:double,threshold:double>"


COUNTS = ("words", "word_chars", "symbols", "tokens", "alpha_tokens", "lines", "bullet_lines", "ellipsis_lines", "ended_lines", "line_chars", "distinct_line_chars", "markers", "letters")
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:['\u2019-][^\W\d_]+)*")
_MARK = re.compile(f"[{T.python_class(T.MARKS)}]")
_MARKED_WORD = re.compile(_PLAIN_WORD.pattern.replace(r"[^\W\d_]+", rf"[^\W\d_](?:[^\W\d_]|{_MARK.pattern})*"))


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts that all rules are made of, named in ``COUNTS``."""
    text = text or ""
    word = _PLAIN_WORD if text.isascii() or not _MARK.search(text) else _MARKED_WORD
    words, tokens, lower = word.findall(text), text.split(), text.lower()
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    runs = "".join(_LETTERS.findall(text))
    return (
        len(words), sum(map(len, words)), text.count("#") + text.count(ELLIPSES[0]) + text.count(ELLIPSES[1]), len(tokens),
        sum(1 for x in tokens if x[0].isalpha() or any(map(str.isalpha, x))), len(lines), sum(1 for x in lines if x[0] in BULLETS), sum(1 for x in lines if x.endswith(ELLIPSES)),
        sum(1 for x in lines if x[-1] in SENTENCE_ENDS), sum(map(len, lines)), sum(map(len, set(lines))), sum(1 for m in MARKERS if m in lower),
        len(runs) if runs.isalpha() else sum(map(str.isalpha, runs)),
    )


def measure(docs: DataFrame, text_col: str = "text", first: Callable[[str | None], str] | None = None, scripts: bool = False) -> DataFrame:
    """Adds the counts that all rules are made of, as columns named ``_m_...``; one pass over each text, in an Arrow function.

    ``first``, if given, is applied to each text before, in the same worker, and what it returns becomes the text. ``scripts`` adds
    the letters of each script, in columns named ``_n_...``.
    """
    fields = dict.fromkeys([PREFIX + k for k in COUNTS] + [f"_n_{s}" for s in S.RANGES if scripts], pa.int64())
    kind = ", ".join(f"{k} long" for k in fields)

    def of(text: str | None) -> tuple[int, ...]:
        return (*counts_of(text), *S.counts_of(text)) if scripts else counts_of(text)

    if first is None:
        run = by_pieces(kind, lambda texts: structs([of(t) for t in texts], fields))
    else:
        run = by_pieces(f"text string, {kind}", lambda texts: structs([(t, *of(t)) for t in map(first, texts)], {"text": pa.string(), **fields}))
    counted = docs.withColumn("_t_counts", run(F.col(text_col)))
    return counted.select(*(F.col("_t_counts.text").alias(c) if first and c == text_col else c for c in docs.columns), *(F.col(f"_t_counts.{k}").alias(k) for k in fields))


def value_of(rule: str, m: Column) -> Column:
    """The unrounded value of a rule; null where it has nothing to measure."""

    def share(part: Column, of: Column) -> Column:
        return F.when(of > 0, part / of)

    return {
        "word_count": lambda: m.words.cast("double"),
        "mean_word_length": lambda: share(m.word_chars, m.words),
        "symbol_to_word_ratio": lambda: share(m.symbols, m.words),
        "alpha_word_ratio": lambda: share(m.alpha_tokens, m.tokens),
        "bullet_line_ratio": lambda: share(m.bullet_lines, m.lines),
        "ellipsis_line_ratio": lambda: share(m.ellipsis_lines, m.lines),
        "terminal_punctuation_ratio": lambda: share(m.ended_lines, m.lines),
        "repetition_ratio": lambda: F.when(m.lines < 2, F.lit(0.0)).otherwise((m.line_chars - m.distinct_line_chars) / m.line_chars),
        "boilerplate_markers": lambda: m.markers.cast("double"),
        "char_count": lambda: m.letters.cast("double"),
        "symbol_to_char_ratio": lambda: share(m.symbols, m.letters),
    }[rule]()


PREFIX = "_m_"


class Measures:
    """The columns of ``measure`` as attributes."""

    def __getattr__(self, name: str) -> Column:
        return F.col(PREFIX + name)


def rule(name: str, least: float | Column | None = None, most: float | None = None) -> Column:
    """A rule's struct; thresholds other than the usual ones can be given."""
    low, high = LIMITS[name]
    low, high = (low if least is None else least), (high if most is None else most)
    value = value_of(name, Measures())
    bounds = [value >= low] if low is not None else []
    bounds += [value <= high] if high is not None else []
    passed = bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]
    empty = 1.0 if high is not None and low is None else 0.0
    places = 2 if name == "mean_word_length" else 4
    threshold = low if low is not None else high
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.struct(
        F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), F.round(F.coalesce(value, F.lit(empty)), places).alias("value"), threshold.cast("double").alias("threshold")
    )


def assess(docs: DataFrame, text_col: str = "text", rules: dict[str, Callable[[], Column] | Column] | None = None, adapt_to_script: bool = True, first: Callable[[str | None], str] | None = None) -> DataFrame:
    """Adds ``report``: struct<passed, failures, rules map<name, struct>, script, script_confidence, space_delimited>.

    All rules that apply are evaluated, whether others fail or not. ``rules`` gives other ones, by
    name, as struct columns like those of ``rule``; then, and without adaptation, the script fields are null. ``first`` as in ``measure``.
    """
    if rules is not None:
        made = {k: (v() if callable(v) else v) for k, v in rules.items()}
        return _report(measure(docs, text_col, first), F.array(*made.values()) if made else F.array().cast(f"array<{RULE_TYPE}>"), False)
    if not adapt_to_script:
        return _report(measure(docs, text_col, first), F.array(*(rule(r) for r in DEFAULT_RULES)), False)
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = S.profile_of_counts(measure(docs, text_col, first, scripts=True), text, "_s_")
    script, spaced = F.col("_s_script"), F.col("_s_space_delimited")
    dense = S.dense(script)
    every = []
    for name in RULES:
        one = rule(name, F.when(dense, F.lit(DENSE_WORD_LENGTH)).otherwise(F.lit(LIMITS[name][0]))) if name == "mean_word_length" else rule(name)
        applies = F.lit(name in DEFAULT_RULES) & spaced | F.lit(name in UNSPACED_RULES) & ~spaced
        if name == "terminal_punctuation_ratio":
            applies = applies & S.terminal_punctuation(script)
        every.append(F.when(applies, one))
    # the letter rules come before those on lines, as they do in their own list
    order = [RULES.index(r) for r in ("char_count", "symbol_to_char_ratio", *DEFAULT_RULES)]
    return _report(known, F.filter(F.array(*(every[k] for k in order)), lambda x: x.isNotNull()), True)


def _report(measured: DataFrame, rules: Column, script: bool) -> DataFrame:
    held = T.bind(measured, "_r_", {"rules": rules})
    r = F.col("_r_rules")
    out = F.struct(
        F.forall(r, lambda x: x["passed"]).alias("passed"),
        F.transform(F.filter(r, lambda x: ~x["passed"]), lambda x: x["name"]).alias("failures"),
        F.map_from_arrays(F.transform(r, lambda x: x["name"]), F.transform(r, lambda x: F.struct(x["passed"].alias("passed"), x["value"].alias("value"), x["threshold"].alias("threshold")))).alias("rules"),
        (F.col("_s_script") if script else F.lit(None).cast("string")).alias("script"),
        (F.round("_s_confidence", 4) if script else F.lit(None).cast("double")).alias("script_confidence"),
        (F.col("_s_space_delimited") if script else F.lit(None).cast("boolean")).alias("space_delimited"),
    )
    return T.bind(held, "", {"report": out}).drop("_r_rules", *(f"_s_{k}" for k in ("script", "confidence", "space_delimited")), *(c for c in held.columns if c.startswith(PREFIX)))


def failure_histogram(assessed: DataFrame) -> DataFrame:
    """(rule, documents): a document counts under each rule that it fails."""
    return assessed.select(F.explode("report.failures").alias("rule")).groupBy("rule").agg(F.count("*").alias("documents"))
