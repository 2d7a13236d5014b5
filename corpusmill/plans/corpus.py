"""The whole run: prepare, exact dedup, quality, near dedup; every dropped row is attributed to a stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import exact, extract, minhash, quality
from corpusmill.schema import Settings
from corpusmill.storage import checkpoint

STAGES = ("empty", "exact_duplicate", "quality", "near_duplicate")


NO_REPORT = "struct<passed:boolean,failures:array<string>,script:string>"


def annotate(docs: DataFrame, settings: Settings = Settings(), order_col: str = "ord", on_progress: Callable[[str, int], None] | None = None) -> DataFrame:
    """Every row with ``drop_reason``, null for those that stay, and what was found about it.

    ``docs`` has (order_col, url, text, html, title, crawled_at); the order, which must be unique, decides which of equal rows is
    first. The exact hash is taken of all rows with text, whether they pass quality or not; near-duplicates are
    looked for among rows that pass, and MinHash is computed for them alone. Decisions are made on rows without texts, and
    join the texts once. ``on_progress`` is told each stage that is done and its rows.
    """
    for name in ("url", "text", "html", "title", "crawled_at"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))
    ready = extract.prepare(docs, settings, "_digest").withColumn("crawled_at", F.coalesce("crawled_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")))
    if settings.run_quality:
        ready = quality.assess(ready, adapt_to_script=settings.adapt_to_script)
    else:
        ready = ready.withColumn("report", F.lit(None).cast(NO_REPORT))
    ready = ready.withColumn("empty", F.col("text") == "")
    # prepared texts are computed once: the stages below read them several times
    ready = checkpoint(ready)
    told = on_progress or (lambda stage, rows: None)
    if on_progress:
        told("prepared", ready.count())
    firsts = exact.first_of_equal(ready.where("NOT empty").select(order_col, F.col("_digest").alias("digest")), order_col)
    firsts = checkpoint(firsts.select(order_col, (F.col("first") < F.col(order_col)).alias("is_dup")))
    ready = ready.drop("_digest")
    if on_progress:
        told("exact_duplicate", firsts.where("NOT is_dup").count())
    if settings.run_near_dedup:
        left = ready.where(F.coalesce("report.passed", F.lit(True))).select(order_col, "text").join(firsts.where("NOT is_dup").select(order_col), order_col, "left_semi")
        near = minhash.deduplicate(left, settings.near_dup_threshold, settings.num_perm, settings.bands, settings.ngram, order_col).withColumnRenamed("ord", order_col)
        near = near.select(order_col, F.col("is_dup").alias("near_dup"), "matched_ord", "similarity")
        decided = firsts.join(near, order_col, "left")
    else:
        decided = firsts.select("*", F.lit(False).alias("near_dup"), F.lit(None).cast(firsts.schema[order_col].dataType).alias("matched_ord"), F.lit(None).cast("double").alias("similarity"))
    decided = checkpoint(decided)
    if on_progress:
        told("near_duplicate", decided.where("NOT is_dup AND near_dup = false").count())
    out = ready.join(decided, order_col, "left").withColumn("report", F.when(~F.col("empty") & ~F.col("is_dup"), F.col("report")))
    reason = (
        F.when(F.col("empty"), "empty")
        .when(F.col("is_dup"), "exact_duplicate")
        .when(~F.coalesce("report.passed", F.lit(True)), "quality")
        .when(F.coalesce("near_dup", F.lit(False)), "near_duplicate")
    )
    script = F.col("report.script")
    return out.withColumn("drop_reason", reason).withColumn("language", F.coalesce(script, F.col("language")) if "language" in out.columns else script).drop("empty", "is_dup", "near_dup")


def kept(annotated: DataFrame) -> DataFrame:
    """The rows that stay, with their ids and signatures."""
    return annotated.where("drop_reason IS NULL").withColumn("signatures", exact.signatures(F.col("text"))).withColumn("doc_id", T.doc_id(F.col("url"))).drop("drop_reason", "matched_ord", "similarity")


def stats(annotated: DataFrame, malformed: int = 0) -> dict:
    """Counters that add up: seen = kept + dropped + malformed. One pass."""
    counts = annotated.agg(F.count("*").alias("rows"), *(F.count_if(F.col("drop_reason") == s).alias(s) for s in STAGES)).first()
    failures = {}
    if "failures" in (annotated.schema["report"].dataType.names if "report" in annotated.columns else []):
        rows = quality.failure_histogram(annotated.where("drop_reason = 'quality'")).collect()  # a row for each rule
        failures = {r["rule"]: r["documents"] for r in sorted(rows, key=lambda r: (-r["documents"], quality.RULES.index(r["rule"]) if r["rule"] in quality.RULES else 99))}
    dropped = {s: counts[s] for s in STAGES}
    seen = counts["rows"] + malformed
    stay = counts["rows"] - sum(dropped.values())
    return {
        "seen": seen, "kept": stay, "dropped": sum(dropped.values()), "malformed": malformed, "keep_rate": round(stay / seen, 4) if seen else 0.0,
        "dropped_by_stage": dropped, "quality_failures": failures,
    }


def render(found: dict) -> str:
    """The counters as lines of text."""
    out = [f"{'seen':<18}{found['seen']:>10}", f"{'kept':<18}{found['kept']:>10}   {found['keep_rate']:.1%}"]
    out += [f"  {k.replace('_', ' '):<16}{n:>10}" for k, n in found["dropped_by_stage"].items()]
    out.append(f"{'malformed':<18}{found['malformed']:>10}")
    if found["quality_failures"]:
        out.append("failed rules")
        out += [f"  {k:<28}{n:>8}" for k, n in found["quality_failures"].items()]
    return "\n".join(out)
