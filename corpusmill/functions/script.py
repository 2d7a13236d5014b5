"""Which script a text is written in, as column functions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.pieces import by_pieces, structs
from corpusmill.functions.text import python_class, bind

#: Characters that are looked at.
SAMPLE_CHARS = 4096
#: Share of kana from which mixed Han text is Japanese.
KANA_SHARE = 0.05
RANGES = {
    "latin": "\\x{41}-\\x{5a}\\x{61}-\\x{7a}\\x{c0}-\\x{24f}",
    "han": "\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{f900}-\\x{faff}",
    "hiragana": "\\x{3040}-\\x{309f}",
    "katakana": "\\x{30a0}-\\x{30ff}",
    "hangul": "\\x{ac00}-\\x{d7af}",
    "cyrillic": "\\x{400}-\\x{52f}",
    "arabic": "\\x{600}-\\x{6ff}\\x{750}-\\x{77f}",
    "hebrew": "\\x{590}-\\x{5ff}",
    "greek": "\\x{370}-\\x{3ff}",
    "devanagari": "\\x{900}-\\x{97f}",
    "bengali": "\\x{980}-\\x{9ff}",
    "thai": "\\x{e00}-\\x{e7f}",
    "lao": "\\x{e80}-\\x{eff}",
    "khmer": "\\x{1780}-\\x{17ff}",
    "myanmar": "\\x{1000}-\\x{109f}",
    "tibetan": "\\x{f00}-\\x{fff}",
    "ethiopic": "\\x{1200}-\\x{137f}",
    "georgian": "\\x{10a0}-\\x{10ff}",
    "armenian": "\\x{530}-\\x{58f}",
}
UNSPACED = tuple("han hiragana japanese katakana khmer lao myanmar thai tibetan".split())
UNPUNCTUATED = tuple("khmer lao myanmar thai tibetan".split())
DENSE = tuple("bengali devanagari ethiopic hangul khmer lao myanmar thai tibetan".split())


def pattern(script: str, quantifier: str = "") -> str:
    """Letters of one script. Only scripts' ranges that hold other characters than letters need the letter test."""
    return rf"[{RANGES[script]}&&[\p{{L}}]]{quantifier}"


_LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]+")
_OTHERS = {s: re.compile(f"[{python_class(r)}]+") for s, r in RANGES.items() if s != "latin"}


def counts_of(text: str | None, sample: int = SAMPLE_CHARS) -> tuple[int, ...]:
    """Letters of each script, in the order of ``RANGES``, among the first ``sample`` characters."""
    head = (text or "")[:sample]
    latin = sum(map(len, _LATIN.findall(head)))
    rest = "" if head.isascii() else "".join(_BEYOND_LATIN.findall(head))
    if not rest:
        return (latin, *(0 for _ in _OTHERS))
    return (latin, *(sum(map(str.isalpha, "".join(p.findall(rest)))) for p in _OTHERS.values()))


def with_counts(docs: DataFrame, text: Column, prefix: str = "_n_", sample: int = SAMPLE_CHARS) -> DataFrame:
    """Adds the number of letters of each script in the first ``sample`` characters."""

    run = by_pieces(", ".join(f"{s} long" for s in RANGES), lambda texts: structs([counts_of(t, sample) for t in texts], dict.fromkeys(RANGES, pa.int64())))
    # no more than the sample goes to Python
    counted = docs.withColumn("_h_counts", run(F.substring(text, 1, sample)))
    return counted.select(*docs.columns, *(F.col(f"_h_counts.{s}").alias(prefix + s) for s in RANGES))


def with_profile(docs: DataFrame, text: Column, prefix: str = "profile_", sample: int = SAMPLE_CHARS) -> DataFrame:
    """Adds script, confidence and space_delimited, named with a prefix."""
    return profile_of_counts(with_counts(docs, text, "_n_", sample), text, prefix, sample)


def profile_of_counts(counted: DataFrame, text: Column, prefix: str = "profile_", sample: int = SAMPLE_CHARS) -> DataFrame:
    """The same from the counts, which are columns named ``_n_...`` and go."""
    each = {s: F.col(f"_n_{s}") for s in RANGES}
    summed = bind(counted, "_n_", {"total": sum(each.values(), F.lit(0)), "most": F.greatest(*each.values())})
    total, most = F.col("_n_total"), F.col("_n_most")
    head = F.substring(text, 1, sample)
    # among scripts with equally many letters, the one met first; places are looked up only if there is a tie
    tied = F.filter(F.array(*(F.when(n == most, F.lit(s)) for s, n in each.items())), lambda x: x.isNotNull())
    first = F.array_min(F.array(*(F.when(n == most, F.struct(F.regexp_instr(head, F.lit(pattern(s))).alias("at"), F.lit(s).alias("script"))) for s, n in each.items()))).getField("script")
    kana = each["hiragana"] + each["katakana"]
    japanese = (each["han"] > 0) & (kana / total >= KANA_SHARE)
    script = F.when(total == 0, "unknown").when(japanese, "japanese").when(F.size(tied) == 1, tied[0]).otherwise(first)
    confidence = F.when(total == 0, F.lit(0.0)).when(japanese, (kana + each["han"]) / total).otherwise(most / total)
    named = bind(summed, prefix, {"script": script, "confidence": confidence}).drop(*(f"_n_{s}" for s in (*RANGES, "total", "most")))
    return named.withColumn(prefix + "space_delimited", ~F.col(prefix + "script").isin(*UNSPACED))


def terminal_punctuation(script: Column) -> Column:
    return ~script.isin(*UNPUNCTUATED)


def dense(script: Column) -> Column:
    return script.isin(*DENSE)
