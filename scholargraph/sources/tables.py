"""The engine's scholarly relations, projected from the supplied relational tables.

paper = order, its reference list = the distinct parts of its line items, completeness = the order's status, local
records = parts of size up to 25. The homogeneous citation graph links parts: a part cites another that stands after
it in the same order, if at least two orders say so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SIZE = 25
MIN_SUPPORT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cr_status(column: str = "o_orderstatus"):
    return (
        F.when(F.col(column) == "F", "COMPLETE").when(F.col(column) == "P", "PARTIAL_OR_UNVERIFIED").otherwise("MISSING_FROM_EXPORT")
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ut, year, venue, cr_status, price"""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ut"), F.year("o_orderdate").cast("long").alias("year"),
        F.col("o_orderpriority").alias("venue"), cr_status().alias("cr_status"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_ut, ref_key, cited_year (first), position (first): one row for each distinct reference of a paper."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("source_ut"), F.col("l_partkey").alias("ref_key")).agg(
        F.min(F.year("l_shipdate")).cast("long").alias("cited_year"), F.min("l_linenumber").cast("long").alias("position"))


def local_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the corpus: ut, title, venue (brand), kind, size."""
    return table(spark, sf_dir, "part").filter(F.col("p_size") <= LOCAL_SIZE).select(
        F.col("p_partkey").alias("ut"), F.col("p_name").alias("title"), F.col("p_brand").alias("venue"), F.col("p_type").alias("kind"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ut"), F.col("p_name").alias("title"), F.col("p_brand").alias("venue"),
        F.col("p_type").alias("concept"), F.col("p_size").cast("long").alias("year"))


def citation_edges(spark: SparkSession, sf_dir: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    """src, dst: directed edges between parts, each seen in at least `min_support` orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    a = lines.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("n1"))
    b = lines.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("n2"))
    return (
        a.join(b, "l_orderkey").filter("n1 < n2 and src <> dst").groupBy("src", "dst")
        .agg(F.count_distinct("l_orderkey").alias("support")).filter(F.col("support") >= min_support).select("src", "dst")
    )


#: The same relations as common table expressions, for the SQL that checks the queries.
REFS_SQL = """refs AS (
  SELECT l_orderkey AS source_ut, l_partkey AS ref_key, CAST(min(year(l_shipdate)) AS BIGINT) AS cited_year,
         CAST(min(l_linenumber) AS BIGINT) AS position
  FROM lineitem GROUP BY 1, 2)"""
PAPERS_SQL = """papers AS (
  SELECT o_orderkey AS ut, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS venue,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'P' THEN 'PARTIAL_OR_UNVERIFIED' ELSE 'MISSING_FROM_EXPORT' END AS cr_status
  FROM orders)"""
EDGES_SQL = """edges AS (
  SELECT a.l_partkey AS src, b.l_partkey AS dst
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey
  GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2)"""
