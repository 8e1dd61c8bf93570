"""Extraction attempts: when one is due, which may follow which, and what their reviews make of their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCEPTING, CLOSING = ("PASS", "ACCEPT_PARTIAL"), ("NEEDS_OCR", "UNRESOLVED")
MOST_ATTEMPTS = 3


def triggers(documents: DataFrame, runs: DataFrame, extractor: str, prompt: str) -> DataFrame:
    """document, trigger: why a new extraction run is due, null if none is.

    documents(document, availability_status, change_key, current_run), runs(run, document, status, change_key,
    extractor, prompt). Only available files are extracted, and none that a STARTED run is at work on.
    """
    busy = runs.filter("status = 'STARTED'").select("document", F.lit(True).alias("busy")).distinct()
    last = runs.select(F.col("run").alias("current_run"), F.col("change_key").alias("seen_key"), F.col("extractor").alias("by"), F.col("prompt").alias("asked"))
    full = documents.join(busy, "document", "left").join(last, "current_run", "left")
    why = (
        F.when((F.col("availability_status") != "PDF_AVAILABLE") | F.coalesce("busy", F.lit(False)), F.lit(None))
        .when(F.col("current_run").isNull(), "FIRST_AVAILABLE")
        .when(F.col("change_key").isNotNull() & ~F.col("change_key").eqNullSafe(F.col("seen_key")), "FILE_CHANGED")
        .when(F.col("by") != extractor, "EXTRACTOR_CHANGED").when(F.col("asked") != prompt, "PROMPT_CHANGED"))
    return full.select("document", why.alias("trigger"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """attempt, decision: the last review (seq) of each attempt."""
    return reviews.groupBy("attempt").agg(F.max_by("decision", "seq").alias("decision"))


def illegal_attempts(attempts: DataFrame, reviews: DataFrame) -> DataFrame:
    """attempt, problem of attempts(attempt, run, number): numbers outside 1 to 3, gaps, and attempts that follow one
    whose last review is not RETRY."""
    w = Window.partitionBy("run").orderBy("number", "attempt")
    full = attempts.join(latest_reviews(reviews), "attempt", "left").withColumn("before", F.lag("number").over(w)).withColumn("said", F.lag("decision").over(w))
    problem = (
        F.when(~F.col("number").between(1, MOST_ATTEMPTS), "NUMBER").when(F.coalesce("before", F.lit(0)) != F.col("number") - 1, "NO_PREVIOUS")
        .when((F.col("number") > 1) & ~F.col("said").eqNullSafe(F.lit("RETRY")), "NOT_RETRY"))
    return full.withColumn("problem", problem).filter("problem is not null").select("attempt", "problem")


def run_outcomes(attempts: DataFrame, reviews: DataFrame) -> DataFrame:
    """run, status, final_status, accepted_attempt of each run: COMPLETED by the last attempt that a review accepts or
    closes, else STARTED; closing reviews accept nothing."""
    full = attempts.join(latest_reviews(reviews), "attempt", "left")
    ended = F.max(F.when(F.col("decision").isin(*ACCEPTING, *CLOSING), F.struct("number", "attempt", "decision"))).alias("e")
    return full.groupBy("run").agg(ended).select(
        "run", F.when(F.col("e").isNull(), "STARTED").otherwise("COMPLETED").alias("status"), F.col("e.decision").alias("final_status"),
        F.when(F.col("e.decision").isin(*ACCEPTING), F.col("e.attempt")).alias("accepted_attempt"))


def output_statuses(outputs: DataFrame, attempts: DataFrame, reviews: DataFrame) -> DataFrame:
    """output, attempt, status of outputs(output, attempt, status): what becomes of spans, sections and references.

    Those of the attempt that ended its run are ACCEPTED, or REJECTED where the review closed it; those of its earlier
    attempts are SUPERSEDED. Only CANDIDATE and ACCEPTED outputs move; later attempts' stay as they are.
    """
    ends = attempts.join(latest_reviews(reviews), "attempt").filter(F.col("decision").isin(*ACCEPTING, *CLOSING)).groupBy("run").agg(
        F.max(F.struct("number", "attempt", "decision")).alias("e")).select("run", "e.number", "e.decision").withColumnRenamed("number", "ended")
    full = outputs.join(attempts.select("attempt", "run", "number"), "attempt").join(ends, "run", "left")
    moves = F.col("status").isin("CANDIDATE", "ACCEPTED")
    after = (
        F.when(F.col("ended").isNull() | ~moves | (F.col("number") > F.col("ended")), F.col("status")).when(F.col("number") < F.col("ended"), "SUPERSEDED")
        .when(F.col("decision").isin(*ACCEPTING), "ACCEPTED").when(F.col("status") == "CANDIDATE", "REJECTED").otherwise(F.col("status")))
    return full.select("output", "attempt", after.alias("status"))


def spans(blocks: DataFrame) -> DataFrame:
    """attempt, position, kind, text of blocks(attempt, position, kind, text): blank lines squeezed, blank blocks left
    out, positions counted anew."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n\s*\n+", "\n"))
    w = Window.partitionBy("attempt").orderBy("position")
    return blocks.withColumn("text", text).filter("text <> ''").withColumn("position", (F.row_number().over(w) - 1).cast("long")).select("attempt", "position", "kind", "text")


def reference_quality(sections: DataFrame) -> DataFrame:
    """section, section_confidence, segmentation_confidence, entry_text_quality of sections(section, heading,
    confidence, entries): a heading makes a section sure; without entries nothing is said of their segmentation."""
    return sections.select(
        "section", F.when(F.coalesce("heading", F.lit("")) != "", "HIGH").otherwise(F.col("confidence")).alias("section_confidence"),
        F.when(F.col("entries") > 0, F.col("confidence")).alias("segmentation_confidence"), F.lit("UNREVIEWED").alias("entry_text_quality"))
