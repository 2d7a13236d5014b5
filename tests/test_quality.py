import pytest
from pyspark.sql import functions as F

from corpusmill.functions import script as S
from corpusmill.operators import quality as Q

GOOD = " ".join(["The harbour opened early this morning.", "Boats came in with fish from the northern banks.", "Traders argued about prices near the old customs house.", "By noon the square was quiet again."] * 4)
SCRIPTS = {
    "latin": GOOD,
    "han": "今天早上港口很早就开放了，渔船从北方的渔场带着鱼回来。" * 8,
    "japanese": "今朝は港が早く開きました。船は北の漁場から魚を運んできました。" * 8,
    "hangul": "오늘 아침 항구가 일찍 문을 열었습니다. 배들이 북쪽 어장에서 물고기를 싣고 돌아왔습니다. " * 8,
    "thai": "เช้าวันนี้ท่าเรือเปิดแต่เช้าเรือนำปลากลับมาจากทางเหนือ " * 8,
    "devanagari": "आज सुबह बंदरगाह जल्दी खुल गया। नावें उत्तरी किनारे से मछली लेकर आईं। " * 8,
    "bengali": "আজ সকালে বন্দর তাড়াতাড়ি খুলেছে। নৌকাগুলি উত্তর থেকে মাছ নিয়ে এসেছে। " * 8,
    "arabic": "فتح الميناء مبكرا هذا الصباح. عادت القوارب بالسمك من الشمال. " * 8,
    "cyrillic": "Гавань открылась рано утром. Лодки вернулись с рыбой с северных банок. " * 8,
    "greek": "Το λιμάνι άνοιξε νωρίς σήμερα. Τα καΐκια γύρισαν με ψάρια από τον βορρά. " * 8,
    "hebrew": "הנמל נפתח מוקדם הבוקר. הסירות חזרו עם דגים מהצפון. " * 8,
}


def judge(spark, texts, **more):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.report for r in Q.assess(rows, **more).orderBy("k").collect()]


def test_scripts_are_told_and_pass(spark):
    for (script, _), r in zip(SCRIPTS.items(), judge(spark, SCRIPTS.values())):
        assert r.script == script and r.passed, (script, r.failures)
        assert ("word_count" in r.rules) == r.space_delimited and ("char_count" in r.rules) != r.space_delimited
    reports = dict(zip(SCRIPTS, judge(spark, SCRIPTS.values())))
    assert "terminal_punctuation_ratio" not in reports["thai"].rules
    assert reports["hangul"].rules["mean_word_length"].threshold == 1.8 and reports["latin"].rules["mean_word_length"].threshold == 3.0


JUNK = {
    "word_count": "Too short.",
    "mean_word_length": "a b c d e f. " * 20,
    "symbol_to_word_ratio": GOOD + " #" * 30,
    "alpha_word_ratio": GOOD + " 12" * 60,
    "bullet_line_ratio": "\n".join(f"- {w} point number {k} of the long list." for k, w in enumerate(GOOD.split())),
    "ellipsis_line_ratio": "\n".join(f"Teaser {k} with {w} and more…" for k, w in enumerate(GOOD.split())),
    "terminal_punctuation_ratio": "\n".join(f"Menu {w} entry {k}" for k, w in enumerate(GOOD.split())),
    "repetition_ratio": "\n".join(["This very line is here again."] * 30 + [GOOD]),
    "boilerplate_markers": GOOD + " Privacy Policy. Terms of use. All rights reserved.",
}


def test_each_rule_fails_its_junk_and_the_others_still_report(spark):
    for (rule, _), r in zip(JUNK.items(), judge(spark, JUNK.values())):
        assert rule in r.failures and not r.passed
        assert set(r.rules) == set(Q.DEFAULT_RULES)


def test_empty_and_unknown(spark):
    for r in judge(spark, ["", None, "123 !!"]):
        assert r.script == "unknown" and r.script_confidence == 0.0 and r.space_delimited
        assert set(r.rules) == set(Q.DEFAULT_RULES) and "word_count" in r.failures and "repetition_ratio" not in r.failures
    empty = judge(spark, [""])[0]
    assert {k: v.value for k, v in empty.rules.items()} == {
        "word_count": 0, "mean_word_length": 0, "symbol_to_word_ratio": 1, "alpha_word_ratio": 0, "bullet_line_ratio": 1, "ellipsis_line_ratio": 1,
        "terminal_punctuation_ratio": 0, "repetition_ratio": 0, "boilerplate_markers": 0,
    }


def test_own_rules_and_no_adaptation(spark):
    strict = judge(spark, [GOOD], rules={"word_count": lambda: Q.rule("word_count", 10_000)})[0]
    assert strict.failures == ["word_count"] and strict.rules["word_count"].threshold == 10_000 and strict.script is None
    forced = judge(spark, [SCRIPTS["han"]], adapt_to_script=False)[0]
    assert not forced.passed and forced.script is None
    own = F.struct(F.lit("has_fish").alias("name"), F.contains("text", F.lit("fish")).alias("passed"), F.lit(1.0).alias("value"), F.lit(1.0).alias("threshold"))
    assert judge(spark, [GOOD, "x"], rules={"has_fish": own})[1].failures == ["has_fish"]


def test_histogram(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(JUNK.values())], "k int, text string")
    counts = {r.rule: r.documents for r in Q.failure_histogram(Q.assess(rows)).collect()}
    assert counts.keys() >= JUNK.keys()


@pytest.mark.parametrize("text, script", [("abγδ", "latin"), ("γδab", "greek"), ("漢字漢字かabc", "japanese"), ("漢字abcd", "latin"), ("カナ", "katakana")])
def test_ties_and_kana(spark, text, script):
    row = S.with_profile(spark.createDataFrame([(text,)], "text string"), F.col("text")).first()
    assert row.profile_script == script


def test_only_the_first_characters_count(spark):
    row = S.with_profile(spark.createDataFrame([("a" * 4096 + "д" * 9000,)], "text string"), F.col("text")).first()
    assert (row.profile_script, row.profile_confidence) == ("latin", 1.0)


def test_counts_equal_the_column_functions(spark):
    from corpusmill.functions import text as T

    texts = [*SCRIPTS.values(), *JUNK.values(), "", "a-b c’d 2nd ½ Ⅻ x_y", "e\u0301te\u0301 n'est", "  \n- one\n\n\u3000two…\n... # ##"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    words, lines = T.words(F.col("text")), T.lines(F.col("text"))
    plain = rows.select(F.size(words).alias("words"), F.length(F.array_join(words, "")).alias("word_chars"), F.size(lines).alias("lines"), F.length(F.array_join(lines, "")).alias("line_chars"), F.length(F.regexp_replace("text", r"\P{L}+", "")).alias("letters"))
    for text, r in zip(texts, plain.collect()):
        counts = dict(zip(Q.COUNTS, Q.counts_of(text)))
        assert {k: counts[k] for k in r.asDict()} == r.asDict(), text
