"""Queries of the engine's own operators over the given tables, and DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import script as S
from corpusmill.functions import text as T
from corpusmill.operators import batching, evaluation, exact, extract, minhash, quality, sampling
from corpusmill.plans import corpus
from corpusmill.sources import shards
from corpusmill.storage import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# SQL for the texts. Its constants are typed out here and not taken from the operators, so that a wrong one in either place shows.
# The tables' texts are in normal form NFKC already, so that step is left out.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
FLAT = r"\x09\x0b-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
INVISIBLE = r"[\x{200b}\x{200c}\x{200d}\x{200e}\x{200f}\x{202a}\x{202b}\x{202c}\x{202d}\x{202e}\x{2060}\x{2061}\x{2062}\x{2063}\x{2064}\x{feff}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}]"
LETTER = r"\p{L}\p{Nl}\p{No}"
# combining marks don't occur in the tables, so words are letters, with apostrophes and hyphens between them
WORD = rf"[{LETTER}]+(?:[''\x{{2019}}-][{LETTER}]+)*"
MARKERS = ["javascript is disabled", "enable javascript", "cookie policy", "privacy policy", "terms of use", "all rights reserved", "404 not found", "403 forbidden", "access denied", "lorem ipsum"]
NORM = rf"""trim(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(text, '{INVISIBLE}', '', 'g'), '{CONTROL}', '', 'g'), '‘’‚‛′“”„‟″', '''''''''''""{'"' * 3}'), '[{FLAT}]+', ' ', 'g'), '\n[ \n]*\n[ \n]*\n', chr(10) || chr(10), 'g'), ' *\n *', chr(10), 'g'), ' ' || chr(10))"""
NORMED = f"WITH n AS (SELECT doc_id, lang, source, {NORM} AS text FROM documents)"
FOLDED = "trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"
LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda x: x <> '')"
COUNTED = rf"""{NORMED},
p AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{WORD}') AS w, {LINES} AS l, regexp_extract_all(text, '[^{SPACE}]+') AS tk FROM n),
m AS (SELECT doc_id, lang, text, len(w) AS words, length(array_to_string(w, '')) AS word_chars,
  (length(text) - length(replace(text, '#', ''))) + (length(text) - length(replace(text, '...', ''))) // 3 + (length(text) - length(replace(text, '…', ''))) AS symbols,
  len(tk) AS tokens, len(list_filter(tk, lambda x: regexp_matches(x, '\p{{L}}'))) AS alpha_tokens, len(l) AS lines,
  len(list_filter(l, lambda x: contains('-*•‣◦⁃', x[1]))) AS bullet_lines,
  len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS ellipsis_lines,
  len(list_filter(l, lambda x: contains('.!?。！？।॥۔։።', x[-1]))) AS ended_lines,
  length(array_to_string(l, '')) AS line_chars, length(array_to_string(list_distinct(l), '')) AS distinct_line_chars,
  {" + ".join(f"contains(lower(text), '{x}')::BIGINT" for x in MARKERS)} AS markers,
  length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS letters FROM p)"""
#: (least, most) that a rule's value may be.
BOUNDS = {
    "word_count": (50, 100_000), "mean_word_length": (3, 10), "symbol_to_word_ratio": (None, 0.1), "alpha_word_ratio": (0.8, None), "bullet_line_ratio": (None, 0.9),
    "ellipsis_line_ratio": (None, 0.3), "terminal_punctuation_ratio": (0.15, None), "repetition_ratio": (None, 0.3), "boilerplate_markers": (None, 2),
    "char_count": (80, 400_000), "symbol_to_char_ratio": (None, 0.05),
}
DEFAULTS = list(BOUNDS)[:9]
VALUES = {
    "word_count": "words::DOUBLE",
    "mean_word_length": "word_chars / nullif(words, 0)",
    "symbol_to_word_ratio": "symbols / nullif(words, 0)",
    "alpha_word_ratio": "alpha_tokens / nullif(tokens, 0)",
    "bullet_line_ratio": "bullet_lines / nullif(lines, 0)",
    "ellipsis_line_ratio": "ellipsis_lines / nullif(lines, 0)",
    "terminal_punctuation_ratio": "ended_lines / nullif(lines, 0)",
    "repetition_ratio": "CASE WHEN lines < 2 THEN 0.0::DOUBLE ELSE (line_chars - distinct_line_chars) / line_chars END",
    "boilerplate_markers": "markers::DOUBLE",
    "char_count": "letters::DOUBLE",
    "symbol_to_char_ratio": "symbols / nullif(letters, 0)",
}


def passes(rule: str) -> str:
    low, high = BOUNDS[rule]
    tests = ([f"v >= {low}"] if low is not None else []) + ([f"v <= {high}"] if high is not None else [])
    return f"coalesce({' AND '.join(tests)}, false)"


# 'latin' decides for all texts of the tables, which SQL checks too: the default rules apply.
VERDICTS = COUNTED + ",\nf AS (SELECT doc_id, lang, list_filter([" + ", ".join(f"CASE WHEN NOT {passes(r).replace('v', f'({VALUES[r]})')} THEN '{r}' END" for r in DEFAULTS) + "], lambda x: x IS NOT NULL) AS failures FROM m)"


def normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("text", T.normalize(F.col("text")))


@query("SELECT page_id, url, substr(sha256(url), 1, 16) AS doc_id FROM pages")
def doc_id_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", T.doc_id(F.col("url")).alias("doc_id"))


@query(f"{NORMED} SELECT doc_id, text FROM n")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normed(spark, sf_dir).select("doc_id", "text")


def _exact(name: str, level: str, key: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return exact.mark_duplicates(normed(spark, sf_dir).select("doc_id", "text"), level).select("doc_id", "is_dup", "first_key")

    run.__name__ = name
    query(f"{NORMED}, k AS (SELECT doc_id, {key} AS k FROM n) SELECT doc_id, row_number() OVER w > 1 AS is_dup, first_value(doc_id) OVER w AS first_key FROM k WINDOW w AS (PARTITION BY k ORDER BY doc_id)")(run)


_exact("exact_raw", "raw", "text")
_exact("exact_normalized", "normalized", FOLDED)
_exact("exact_structural", "structural", f"regexp_replace({FOLDED}, '\\p{{Nd}}+', '0', 'g')")


@query()
def content_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normed(spark, sf_dir).select("doc_id", exact.signatures(F.col("text")).alias("s")).select("doc_id", "s.*")


def _rule(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        measured = quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text"), first=T.normalize_one)
        return measured.select("doc_id", quality.value_of(name, quality.Measures()).alias("value"), quality.rule(name)["passed"].alias("passed"))

    run.__name__ = f"rule_{name}"
    query(f"{COUNTED}, v AS (SELECT doc_id, {VALUES[name]} AS v FROM m) SELECT doc_id, v AS value, {passes(name)} AS passed FROM v")(run)


for _name in quality.RULES:
    _rule(_name)


def _in_script(script: str) -> str:
    return f"len(regexp_extract_all(substr(text, 1, {S.SAMPLE_CHARS}), '[{S.RANGES[script]}]'))"


def _profile_sql(source: str, key: str) -> str:
    # in these tables every character of the Latin ranges but the two signs is a letter, and no other script occurs
    latin = f"len(regexp_extract_all(substr(text, 1, {S.SAMPLE_CHARS}), '[A-Za-z\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}\\x{{f8}}-\\x{{24f}}]'))"
    others = " + ".join(_in_script(s) for s in S.RANGES if s != "latin")
    return f"SELECT {key}, CASE WHEN c = 0 THEN 'unknown' ELSE 'latin' END AS script, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE c / (c + o) END AS confidence, true AS space_delimited, c AS latin_letters FROM (SELECT *, {latin} AS c, {others} AS o FROM {source})"


def _profile(docs: DataFrame, *keys: str) -> DataFrame:
    known = S.with_profile(S.with_counts(docs, F.col("text"), "_k_"), F.col("text"), "_s_")
    return known.select(*keys, *(F.col(f"_s_{k}").alias(k) for k in ("script", "confidence", "space_delimited")), F.col("_k_latin").alias("latin_letters"))


@query(_profile_sql("documents", "doc_id"))
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(table(spark, sf_dir, "documents"), "doc_id")


@query(_profile_sql("conversations", "conv_id, turn"))
def script_profile_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), first=T.normalize_one)


@query(f"{VERDICTS} SELECT doc_id, len(failures) = 0 AS passed, array_to_string(failures, ',') AS failures FROM f")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("doc_id", F.col("report.passed").alias("passed"), F.array_join("report.failures", ",").alias("failures"))


@query(f"{VERDICTS} SELECT rule, count(*) AS documents FROM (SELECT unnest(failures) AS rule FROM f) GROUP BY rule")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failure_histogram(judged(spark, sf_dir))


@query(f"{VERDICTS} SELECT lang, count(*) AS documents, count_if(len(failures) = 0) AS passed, count_if(len(failures) = 0) / count(*) AS keep_rate FROM f GROUP BY lang")
def keep_rate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = judged(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("documents"), F.count_if("report.passed").alias("passed"))
    return counts.withColumn("keep_rate", F.col("passed") / F.col("documents"))


@query(f"{VERDICTS} SELECT quality, len(failures) = 0 AS passed, count(*) AS documents FROM f JOIN labels USING (doc_id) GROUP BY ALL")
def quality_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return judged(spark, sf_dir).join(labels, "doc_id").groupBy("quality", F.col("report.passed").alias("passed")).agg(F.count("*").alias("documents"))


def _runs_sql(source: str, key: str, n: int = 5) -> str:
    token = r"[\p{L}\p{N}_]+"
    return f"""t AS (SELECT {key}, regexp_extract_all(lower(text), '{token}') AS t FROM {source}),
s AS (SELECT {key}, CASE WHEN len(t) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(2, len(t) - {n} + 2)), lambda i: array_to_string(t[i:i + {n - 1}], ' '))) END AS s FROM t)"""


@query(f"{NORMED}, {_runs_sql('n', 'doc_id')} SELECT doc_id, len(s) AS shingles FROM s")
def shingle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normed(spark, sf_dir).select("doc_id", F.size(minhash.shingles(F.col("text"))).cast("long").alias("shingles"))


@query(f"WITH {_runs_sql('benchmark', 'item_id', 1)} SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) AS jaccard FROM s a JOIN s b ON a.item_id < b.item_id")
def exact_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of test items, on single words; the table of items is small by nature."""
    sets = table(spark, sf_dir, "benchmark").select("item_id", minhash.shingles(F.col("text"), 1).alias("s"))
    a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", minhash.jaccard(F.col("sa"), F.col("sb")).alias("jaccard"))


@query()
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", minhash.signature(F.col("text"), first=T.normalize_one).alias("signature"))


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of all documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), minhash.signature(F.col("text"), first=T.normalize_one).alias("sig"))


@query()
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.all_candidates(signed(spark, sf_dir))


@query()
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.all_similar_pairs(signed(spark, sf_dir))


@query()
def near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), first=T.normalize_one)


@query()
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extract.extract(F.col("html")).alias("e")).select("page_id", "url", "e.title", "e.text")


def documents_as_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("doc:"), "doc_id").alias("url"), "text")


def pages_as_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "url", "html")


@query(
    f"""{VERDICTS}, k AS (SELECT doc_id, row_number() OVER (PARTITION BY {FOLDED} ORDER BY doc_id) > 1 AS dup, text = '' AS empty FROM n)
SELECT CASE WHEN empty THEN 'empty' WHEN dup THEN 'exact_duplicate' WHEN len(failures) > 0 THEN 'quality' ELSE 'kept' END AS outcome, count(*) AS documents FROM k JOIN f USING (doc_id) GROUP BY outcome"""
)
def stage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what became of them, without near-duplicates."""
    from corpusmill.schema import Settings

    found = corpus.annotate(documents_as_crawl(spark, sf_dir), Settings(run_near_dedup=False))
    return found.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("documents"))


def _stats_frame(annotated: DataFrame) -> DataFrame:
    reasons = [F.count_if(F.col("drop_reason") == s).alias(s) for s in corpus.STAGES]
    return annotated.agg(F.count("*").alias("seen"), F.count_if(F.col("drop_reason").isNull()).alias("kept"), *reasons).withColumn("keep_rate", F.round(F.col("kept") / F.col("seen"), 4))


@query()
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_frame(corpus.annotate(documents_as_crawl(spark, sf_dir)))


@query()
def pages_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.annotate(pages_as_crawl(spark, sf_dir))
    return found.select(F.col("ord").alias("page_id"), "url", "title", "text", "language", "drop_reason")


# one text after the other, in order of length
BATCHES = """WITH RECURSIVE o AS (SELECT doc_id, length(text)::INTEGER AS length, row_number() OVER (ORDER BY length(text), doc_id) AS k FROM documents),
b AS (SELECT k, doc_id, length, 0::BIGINT AS batch_id, 1 AS size FROM o WHERE k = 1
  UNION ALL SELECT n.k, n.doc_id, n.length, n.open_id + (NOT n.fits)::BIGINT, CASE WHEN n.fits THEN n.open_size + 1 ELSE 1 END
  FROM (SELECT o.*, b.batch_id AS open_id, b.size AS open_size, o.length * (b.size + 1) <= 16384 AND b.size < 64 AS fits FROM b JOIN o ON o.k = b.k + 1) n)"""


@query(f"{BATCHES} SELECT doc_id, batch_id, length FROM b")
def adaptive_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return batching.adaptive_batches(docs).select("doc_id", "batch_id", "length")


@query(
    f"""{BATCHES}, e AS (SELECT count(*) AS n, sum(length)::BIGINT AS t, max(length)::BIGINT AS m FROM b GROUP BY batch_id)
SELECT count(*) AS batches, sum(n)::BIGINT AS texts, sum(t)::BIGINT AS tokens, sum(m * n)::BIGINT AS padded_tokens, sum(t) / sum(m * n) AS efficiency FROM e"""
)
def padding_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.padding(batching.adaptive_batches(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query()
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = batching.adaptive_batches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return batching.embed(batched, batching.HashEncoder)


SHARD_SIZE = 300


@query(f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, ((row_number() OVER (ORDER BY doc_id) - 1) // {SHARD_SIZE})::INTEGER AS shard FROM documents")
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_assignment(table(spark, sf_dir, "documents").select("doc_id"), SHARD_SIZE)


@query(
    f"""SELECT shard, printf('shard-%05d.jsonl.gz', shard) AS path, count(*) AS records
FROM (SELECT ((row_number() OVER (ORDER BY doc_id) - 1) // {SHARD_SIZE})::INTEGER AS shard FROM documents) GROUP BY shard"""
)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.shard_assignment(table(spark, sf_dir, "documents").select("doc_id"), SHARD_SIZE)
    return rows.groupBy("shard").agg(F.count("*").alias("records")).withColumn("path", F.format_string("shard-%05d.jsonl.gz", "shard"))


@query("SELECT doc_id, source FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 100")
def sample_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), 100)


@query()
def sample_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.reservoir_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), 100)


@query()
def dedup_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall on a thousand labelled texts, of which two hundred are variants of others."""
    return evaluation.dedup_scores(evaluation.labelled_corpus(spark, 1_000))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = evaluation.linear_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return fit.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))
