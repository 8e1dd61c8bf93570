"""Canonical records from append-only observations. Missing data never erases what an earlier export said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_known(value: str, order: str) -> Column:
    """The value of the latest observation that has one."""
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))


def merge_scalars(observations: DataFrame, key: str, order: str, keep_last: list[str], keep_max: list[str] = (), first_seen: str | None = None) -> DataFrame:
    """One row a key: last known values, maxima, and the number, first and last of the observations."""
    aggs = [last_known(c, order).alias(c) for c in keep_last] + [F.max(c).alias(f"max_{c}") for c in keep_max]
    aggs += [F.count(F.lit(1)).alias("observations"), F.min(order).alias("first_batch"), F.max(order).alias("last_batch")]
    if first_seen:
        aggs += [F.min(first_seen).alias("first_imported_at"), F.max(first_seen).alias("last_imported_at")]
    return observations.groupBy(key).agg(*aggs)


def first_wins(values: DataFrame, key: str, value: str, order: list[str], fold: Column | None = None) -> DataFrame:
    """key, value, order_index: each value once (by its folded form), in order of first appearance, spelt as first seen."""
    folded = values.withColumn("__f", F.lower(F.col(value)) if fold is None else fold)
    firsts = folded.filter(F.col(value).isNotNull()).groupBy(key, "__f").agg(F.min(F.struct(*order, value)).alias("m"))
    w = Window.partitionBy(key).orderBy(*[f"m.{c}" for c in order], "__f")
    return firsts.select(key, F.col(f"m.{value}").alias(value), (F.row_number().over(w) - 1).cast("long").alias("order_index"))


def union_references(references: DataFrame, key: str = "source_ut") -> DataFrame:
    """references(key, ref_key, batch, position): existing and new ones, each once, in stable order from 0."""
    firsts = references.groupBy(key, "ref_key").agg(F.min(F.struct("batch", "position")).alias("m"), F.count_distinct("batch").alias("batches"))
    w = Window.partitionBy(key).orderBy("m.batch", "m.position", "ref_key")
    return firsts.select(key, "ref_key", (F.row_number().over(w) - 1).cast("long").alias("order_index"), F.col("m.batch").alias("first_batch"), "batches")


def resolve_targets(references: DataFrame, records: DataFrame) -> DataFrame:
    """references(source_ut, doi) get target_ut where exactly one of records(ut, doi) has the DOI."""
    unique = records.filter(F.col("doi").isNotNull()).groupBy("doi").agg(F.min("ut").alias("target_ut"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return references.join(unique, "doi", "left").select("source_ut", "doi", "target_ut")


def completeness_status(observations: DataFrame, counts: DataFrame) -> DataFrame:
    """ut, canonical_count, status from observations(ut, status, reported) and counts(ut, n) of merged references.

    No references: MISSING_FROM_EXPORT if any export reported some, else COMPLETE_ZERO if one said so, else UNKNOWN.
    Otherwise COMPLETE if the count is the largest that a complete export reported, MERGED if it is another number,
    PARTIAL_OR_UNVERIFIED if no export was complete.
    """
    seen = observations.groupBy("ut").agg(
        F.max("reported").alias("reported"), F.max(F.when(F.col("status") == "COMPLETE", F.col("reported"))).alias("complete"),
        F.bool_or(F.col("status") == "COMPLETE_ZERO").alias("zero"))
    n = F.coalesce("n", F.lit(0))
    return seen.join(counts, "ut", "left").select(
        "ut", n.cast("long").alias("canonical_count"), F.col("reported").cast("long").alias("reported"),
        F.when((n == 0) & (F.col("reported") > 0), "MISSING_FROM_EXPORT").when((n == 0) & F.col("zero"), "COMPLETE_ZERO").when(n == 0, "UNKNOWN")
        .when(n == F.col("complete"), "COMPLETE").when(F.col("complete").isNotNull(), "MERGED").otherwise("PARTIAL_OR_UNVERIFIED").alias("status"))


def match_papers(papers: DataFrame, records: DataFrame) -> DataFrame:
    """paper_id, state, ut, method, candidate_count: conservative matching of papers(paper_id, doi, title, year, venue)
    to records(ut, doi, title, year, venue); ambiguity is never forced.

    A unique DOI decides; a shared one only if the year singles a record out. Without a DOI match, a unique exact
    title of compatible year decides; of several, the one of compatible year if its venue does not disagree.
    """
    full = papers.select(*[F.col(c).alias(f"p_{c}") if c != "paper_id" else F.col(c) for c in ("paper_id", "doi", "title", "year", "venue")])
    for on in ("doi", "title"):
        # Records are added up by value and year first: papers and records that share a value are never paired.
        first = F.min(F.struct("ut", "venue"))
        dated = records.filter(F.col(on).isNotNull()).groupBy(F.col(on).alias(f"p_{on}"), F.col("year").alias("p_year")).agg(F.count(F.lit(1)).alias("n"), first.alias("best"))
        undated = F.col("p_year").isNull()
        whole = dated.groupBy(f"p_{on}").agg(
            F.sum("n").alias(f"{on}_n"), F.min("best").alias("first"), F.sum(F.when(undated, F.col("n"))).alias("undated_n"), F.min(F.when(undated, F.col("best"))).alias("undated"))
        full = full.join(whole, f"p_{on}", "left").join(dated, [f"p_{on}", "p_year"], "left")
        fit = F.when(undated, F.col("first")).otherwise(F.least("best", "undated"))
        full = full.withColumn(f"{on}_fit", F.when(undated, F.col(f"{on}_n")).otherwise(F.coalesce("n", F.lit(0)) + F.coalesce("undated_n", F.lit(0)))).withColumn(
            f"{on}_ut", F.col("first.ut")).withColumn(f"{on}_fit_ut", fit["ut"]).withColumn(f"{on}_venue", fit["venue"]).drop("n", "best", "first", "undated_n", "undated")
    agree = F.col("p_venue").isNull() | F.col("title_venue").isNull() | (F.lower("p_venue") == F.lower("title_venue"))
    pick = lambda state, ut, how, n: F.struct(F.lit(state).alias("state"), ut.alias("ut"), F.lit(how).cast("string").alias("method"), n.cast("long").alias("candidate_count"))
    none = F.lit(None).cast("long")
    d, t = F.col("doi_n"), F.col("title_n")
    choice = (
        F.when(d == 1, pick("MATCHED", F.col("doi_ut"), "DOI_EXACT", F.lit(1)))
        .when((d > 1) & (F.col("doi_fit") == 1), pick("MATCHED", F.col("doi_fit_ut"), "DOI_EXACT", d))
        .when(d > 1, pick("AMBIGUOUS", none, None, d))
        .when((t == 1) & (F.col("title_fit") == 1), pick("MATCHED", F.col("title_ut"), "TITLE_EXACT", F.lit(1)))
        .when((F.col("title_fit") == 1) & agree, pick("MATCHED", F.col("title_fit_ut"), "TITLE_YEAR_JOURNAL", t))
        .when(t > 0, pick("AMBIGUOUS", none, None, t))
        .otherwise(pick("NOT_IN_LOCAL_CORPUS", none, None, F.lit(0)))
    )
    return full.select("paper_id", choice.alias("c")).select("paper_id", "c.*")
