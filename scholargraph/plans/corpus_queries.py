"""Canonical corpus queries: observations are events of a user, references are line items in two batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.operators import corpus
from scholargraph.plans.registry import query
from scholargraph.sources import tables as T

OBS_SQL = """obs AS (SELECT user_id AS ut, event_id AS batch, ts, CASE WHEN event_type <> 'error' THEN value END AS value, event_type AS kind,
 CASE WHEN event_type = 'click' THEN props END AS note, CAST(floor(value) AS BIGINT) AS reported FROM events)"""


def _observations(spark, d) -> DataFrame:
    return T.table(spark, d, "events").select(
        F.col("user_id").alias("ut"), F.col("event_id").alias("batch"), "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.col("event_type").alias("kind"), F.when(F.col("event_type") == "click", F.col("props")).alias("note"), F.floor("value").cast("long").alias("reported"))


@query(f"""WITH {OBS_SQL} SELECT ut, arg_max(value, batch) FILTER (WHERE value IS NOT NULL) AS value, arg_max(note, batch) FILTER (WHERE note IS NOT NULL) AS note,
arg_max(kind, batch) AS kind, max(reported) AS max_reported, count(*) AS observations, min(batch) AS first_batch, max(batch) AS last_batch FROM obs GROUP BY 1""")
def canonical_merge(spark, d) -> DataFrame:
    return corpus.merge_scalars(_observations(spark, d), "ut", "batch", ["value", "note", "kind"], ["reported"])


@query("""WITH r AS (SELECT l_orderkey AS source_ut, l_partkey AS ref_key, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS batch, CAST(l_linenumber AS BIGINT) AS position FROM lineitem),
f AS (SELECT source_ut, ref_key, min((batch, position)) AS m, count(DISTINCT batch) AS batches FROM r GROUP BY 1, 2)
SELECT source_ut, ref_key, row_number() OVER (PARTITION BY source_ut ORDER BY m, ref_key) - 1 AS order_index, m[1] AS first_batch, batches FROM f""")
def reference_union(spark, d) -> DataFrame:
    r = T.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("source_ut"), F.col("l_partkey").alias("ref_key"), F.when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("batch"), F.col("l_linenumber").cast("long").alias("position"))
    return corpus.union_references(r)


@query("""WITH rec AS (SELECT p_partkey AS ut, p_brand || '/' || p_type || '/' || p_size AS doi FROM part),
one AS (SELECT doi, min(ut) AS target_ut FROM rec GROUP BY 1 HAVING count(*) = 1)
SELECT l_orderkey AS source_ut, rec.doi, target_ut FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN rec ON ut = l_partkey LEFT JOIN one ON one.doi = rec.doi""")
def target_resolution(spark, d) -> DataFrame:
    rec = _records(spark, d).select("ut", "doi")
    refs = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_ut"), F.col("l_partkey").alias("ut")).distinct().join(rec, "ut").select("source_ut", "doi")
    return corpus.resolve_targets(refs, rec)


def _records(spark, d) -> DataFrame:
    p = T.table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("ut"), F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("doi"), F.col("p_name").alias("title"),
        F.col("p_size").cast("long").alias("year"), F.col("p_brand").alias("venue"))


@query(f"""WITH {OBS_SQL}, o AS (SELECT ut, CASE kind WHEN 'click' THEN 'COMPLETE' WHEN 'view' THEN 'COMPLETE_ZERO' ELSE 'PARTIAL' END AS status, reported % 40 AS reported FROM obs),
n AS (SELECT l_suppkey AS ut, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_linenumber = 7 GROUP BY 1),
s AS (SELECT ut, max(reported) AS reported, max(reported) FILTER (WHERE status = 'COMPLETE') AS complete, bool_or(status = 'COMPLETE_ZERO') AS zero FROM o GROUP BY 1)
SELECT s.ut, coalesce(n, 0) AS canonical_count, reported, CASE WHEN coalesce(n, 0) = 0 AND reported > 0 THEN 'MISSING_FROM_EXPORT' WHEN coalesce(n, 0) = 0 AND zero THEN 'COMPLETE_ZERO'
 WHEN coalesce(n, 0) = 0 THEN 'UNKNOWN' WHEN n = complete THEN 'COMPLETE' WHEN complete IS NOT NULL THEN 'MERGED' ELSE 'PARTIAL_OR_UNVERIFIED' END AS status FROM s LEFT JOIN n ON n.ut = s.ut""")
def cr_status(spark, d) -> DataFrame:
    o = _observations(spark, d).select(
        "ut", F.when(F.col("kind") == "click", "COMPLETE").when(F.col("kind") == "view", "COMPLETE_ZERO").otherwise("PARTIAL").alias("status"), (F.col("reported") % 40).alias("reported"))
    n = T.table(spark, d, "lineitem").filter("l_linenumber = 7").groupBy(F.col("l_suppkey").alias("ut")).agg(F.count_distinct("l_partkey").alias("n"))
    return corpus.completeness_status(o, n)


@query(f"""WITH {OBS_SQL}, f AS (SELECT ut, lower(kind) AS k, arg_min(kind, batch) AS keyword, min(batch) AS b FROM obs GROUP BY 1, 2)
SELECT ut, keyword, row_number() OVER (PARTITION BY ut ORDER BY b, k) - 1 AS order_index FROM f""")
def first_wins_keywords(spark, d) -> DataFrame:
    return corpus.first_wins(_observations(spark, d).withColumnRenamed("kind", "keyword"), "ut", "keyword", ["batch"])


@query(f"""WITH {OBS_SQL}, m AS (SELECT ut, CAST(ts AS DATE) AS day, arg_max(value, batch) FILTER (WHERE value IS NOT NULL) AS value FROM obs GROUP BY 1, 2)
SELECT ut, strftime(day, '%Y-%m-%d') AS day, value, round(value - lag(value) OVER (PARTITION BY ut ORDER BY day), 6) AS change FROM m""")
def metric_history(spark, d) -> DataFrame:
    m = _observations(spark, d).groupBy("ut", F.to_date("ts").alias("day")).agg(corpus.last_known("value", "batch").alias("value"))
    return m.select("ut", F.date_format("day", "yyyy-MM-dd").alias("day"), "value", F.round(F.col("value") - F.lag("value").over(Window.partitionBy("ut").orderBy("day")), 6).alias("change"))


@query(f"""WITH {OBS_SQL} SELECT strftime(ts, '%Y-%m-%d') AS batch_day, count(*) AS records, count(DISTINCT ut) AS distinct_records, count(*) FILTER (WHERE kind = 'error') AS errors,
count(*) FILTER (WHERE kind = 'click') AS clicks, count(*) FILTER (WHERE value IS NULL) AS without_value FROM obs GROUP BY 1""")
def import_batches(spark, d) -> DataFrame:
    return _observations(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("batch_day")).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("ut").alias("distinct_records"), F.count_if(F.col("kind") == "error").alias("errors"),
        F.count_if(F.col("kind") == "click").alias("clicks"), F.count_if(F.col("value").isNull()).alias("without_value"))


@query(f"""WITH {OBS_SQL} SELECT ut, batch, kind, note, n FROM (SELECT *, row_number() OVER (PARTITION BY ut ORDER BY batch DESC) AS n FROM obs) WHERE n <= 5""")
def observation_listing(spark, d) -> DataFrame:
    w = Window.partitionBy("ut").orderBy(F.desc("batch"))
    return _observations(spark, d).withColumn("n", F.row_number().over(w).cast("long")).filter("n <= 5").select("ut", "batch", "kind", "note", "n")


PAPERS_M = """p AS (SELECT c_custkey AS paper_id, CASE WHEN c_custkey % 3 = 0 THEN 'Brand#' || (c_custkey % 25 + 1) || '/ECONOMY/' || (c_custkey % 50 + 1) END AS doi,
 CASE WHEN c_custkey % 2 = 0 THEN (SELECT any_value(p_name) FROM part WHERE p_partkey = c_nationkey) ELSE c_name END AS title,
 CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 50 END AS year, CASE WHEN c_custkey % 4 = 0 THEN 'Brand#' || (c_custkey % 25 + 1) END AS venue FROM customer)"""
MATCH_SQL = f"""WITH {PAPERS_M}, r AS (SELECT p_partkey AS ut, p_brand || '/' || p_type || '/' || p_size AS doi, p_name AS title, p_size AS year, p_brand AS venue FROM part),
dc AS (SELECT paper_id, count(*) AS n, count(*) FILTER (WHERE p.year IS NULL OR p.year = r.year) AS fit, min(ut) AS u, min(ut) FILTER (WHERE p.year IS NULL OR p.year = r.year) AS fu FROM p JOIN r ON r.doi = p.doi GROUP BY 1),
tc AS (SELECT paper_id, count(*) AS n, count(*) FILTER (WHERE p.year IS NULL OR p.year = r.year) AS fit, min(ut) AS u, min(ut) FILTER (WHERE p.year IS NULL OR p.year = r.year) AS fu,
  arg_min(r.venue, ut) FILTER (WHERE p.year IS NULL OR p.year = r.year) AS fv FROM p JOIN r ON r.title = p.title GROUP BY 1),
m AS (SELECT p.paper_id, CASE WHEN dc.n = 1 THEN 'D1' WHEN dc.n > 1 AND dc.fit = 1 THEN 'D2' WHEN dc.n > 1 THEN 'DA' WHEN tc.n = 1 AND tc.fit = 1 THEN 'T1'
  WHEN tc.fit = 1 AND (p.venue IS NULL OR fv IS NULL OR lower(p.venue) = lower(fv)) THEN 'T2' WHEN tc.n > 0 THEN 'TA' ELSE 'N' END AS c, dc.n AS dn, dc.u AS du, dc.fu AS dfu, tc.n AS tn, tc.u AS tu, tc.fu AS tfu
  FROM p LEFT JOIN dc USING (paper_id) LEFT JOIN tc USING (paper_id))
SELECT paper_id, CASE WHEN c IN ('D1', 'D2', 'T1', 'T2') THEN 'MATCHED' WHEN c IN ('DA', 'TA') THEN 'AMBIGUOUS' ELSE 'NOT_IN_LOCAL_CORPUS' END AS state,
 CASE c WHEN 'D1' THEN du WHEN 'D2' THEN dfu WHEN 'T1' THEN tu WHEN 'T2' THEN tfu END AS ut, CASE c WHEN 'D1' THEN 'DOI_EXACT' WHEN 'D2' THEN 'DOI_EXACT' WHEN 'T1' THEN 'TITLE_EXACT' WHEN 'T2' THEN 'TITLE_YEAR_JOURNAL' END AS method,
 CAST(CASE c WHEN 'D1' THEN 1 WHEN 'D2' THEN dn WHEN 'DA' THEN dn WHEN 'T1' THEN 1 WHEN 'T2' THEN tn WHEN 'TA' THEN tn ELSE 0 END AS BIGINT) AS candidate_count FROM m"""


def _papers_to_match(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    brand = F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"))
    names = T.table(spark, d, "part").select(F.col("p_partkey").alias("slot"), F.col("p_name").alias("slot_name"))
    return T.table(spark, d, "customer").join(names, F.col("c_nationkey") == F.col("slot"), "left").select(
        k.alias("paper_id"), F.when(k % 3 == 0, F.concat(brand, F.lit("/ECONOMY/"), (k % 50 + 1).cast("string"))).alias("doi"),
        F.when(k % 2 == 0, F.col("slot_name")).otherwise(F.col("c_name")).alias("title"), F.when(k % 5 != 0, k % 50).alias("year"), F.when(k % 4 == 0, brand).alias("venue"))


@query(MATCH_SQL)
def paper_match(spark, d) -> DataFrame:
    return corpus.match_papers(_papers_to_match(spark, d), _records(spark, d))


@query(f"SELECT state, count(*) AS papers, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM ({MATCH_SQL}) GROUP BY state")
def coverage(spark, d) -> DataFrame:
    n = corpus.match_papers(_papers_to_match(spark, d), _records(spark, d)).groupBy("state").agg(F.count(F.lit(1)).alias("papers"))
    every = F.sum("papers").over(Window.partitionBy())  # three states
    return n.select("state", "papers", F.round(F.col("papers") / every, 6).alias("fraction"))


@query("""SELECT p_partkey AS ut, p_name AS title, p_brand AS venue FROM part WHERE contains(lower(p_name), 'gear') OR contains(lower(p_brand), 'gear')
OR p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE contains(lower(s_name), '07')) ORDER BY p_size DESC, p_partkey LIMIT 500""")
def search_fields(spark, d) -> DataFrame:
    """Literal substring search over the record and its authors; no fan-out across child tables."""
    p, has = T.table(spark, d, "part"), lambda c, q: F.lower(c).contains(q)
    by_author = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").join(
        T.table(spark, d, "supplier").filter(has("s_name", "07")).select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").select("p_partkey")
    hits = p.filter(has("p_name", "gear") | has("p_brand", "gear")).select("p_partkey").unionByName(by_author).distinct()
    return p.join(hits, "p_partkey", "left_semi").orderBy(F.desc("p_size"), "p_partkey").limit(500).select(F.col("p_partkey").alias("ut"), F.col("p_name").alias("title"), F.col("p_brand").alias("venue"))
