"""Library queries: scans of documents, listings of orders, the tree region - nation - customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.operators import library, listing
from scholargraph.plans.registry import query
from scholargraph.sources import tables as T

SCAN_SQL = """before_scan AS (SELECT doc_id, lang, source, n_chars, lang = 'es' AS was_removed FROM documents WHERE source <> 'src3'),
now_scan AS (SELECT doc_id, lang, CASE WHEN lang = 'de' THEN source || '-moved' ELSE source END AS source, CASE WHEN n_chars > 2000 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE source <> 'src7'),
diff AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'NEW' WHEN b.doc_id IS NULL AND was_removed THEN 'GONE' WHEN b.doc_id IS NULL THEN 'REMOVED' WHEN was_removed THEN 'RESTORED'
 WHEN (a.lang, a.n_chars, a.source) IS DISTINCT FROM (b.lang, b.n_chars, b.source) THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change,
 CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN '' ELSE concat_ws('|', CASE WHEN (a.lang, a.n_chars) IS DISTINCT FROM (b.lang, b.n_chars) THEN 'bibliographic' END, CASE WHEN a.source IS DISTINCT FROM b.source THEN 'organization' END) END AS changed_dimensions
 FROM before_scan a FULL JOIN now_scan b ON a.doc_id = b.doc_id)"""


def _scan(spark, d) -> DataFrame:
    """Two scans of the documents: one source is missing from each, some rows have moved or grown in between."""
    docs = T.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    before = docs.filter("source <> 'src3'").withColumn("gone", F.col("lang") == "es")
    now = docs.filter("source <> 'src7'").withColumn("source", F.when(F.col("lang") == "de", F.concat("source", F.lit("-moved"))).otherwise(F.col("source"))).withColumn(
        "n_chars", F.when(F.col("n_chars") > 2000, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return library.scan_diff(before, now, "doc_id", {"bibliographic": ["lang", "n_chars"], "organization": ["source"]}, "gone")


@query(f"WITH {SCAN_SQL} SELECT * FROM diff")
def scan_diff(spark, d) -> DataFrame:
    return _scan(spark, d)


@query(f"WITH {SCAN_SQL} SELECT change, changed_dimensions, count(*) AS n FROM diff GROUP BY 1, 2")
def scan_counts(spark, d) -> DataFrame:
    return _scan(spark, d).groupBy("change", "changed_dimensions").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS ut, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS venue, CAST(count(*) OVER () AS BIGINT) AS total FROM orders
WHERE lower(o_orderpriority) = '1-urgent' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY year DESC NULLS LAST, ut DESC LIMIT 200 OFFSET 20""")
def list_papers(spark, d) -> DataFrame:
    """A page of the listing: filters, availability by semi-join, the total of the whole selection, stable order."""
    have = T.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ut"))
    chosen = T.papers(spark, d).filter(F.lower("venue") == "1-urgent").join(have, "ut", "left_semi").select("ut", "year", "venue")
    total = chosen.agg(F.count(F.lit(1)).alias("total"))
    return chosen.orderBy(F.desc_nulls_last("year"), F.desc("ut")).offset(20).limit(200).join(F.broadcast(total))


@query("""SELECT s_suppkey AS author, s_name AS name, count(DISTINCT l_orderkey) AS papers, count(DISTINCT l_orderkey) FILTER (WHERE l_linenumber = 1) AS first_papers
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY lower(s_name), author LIMIT 500""")
def list_authors(spark, d) -> DataFrame:
    n = T.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_distinct("l_orderkey").alias("p"), F.count_distinct(F.when(F.col("l_linenumber") == 1, F.col("l_orderkey"))).alias("f"))
    return T.table(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        F.col("s_suppkey").alias("author"), F.col("s_name").alias("name"), F.coalesce("p", F.lit(0)).alias("papers"), F.coalesce("f", F.lit(0)).alias("first_papers")
    ).orderBy(F.lower("name"), "author").limit(500)


@query("SELECT c_custkey AS paper_id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unfiled(spark, d) -> DataFrame:
    """Customers without a pending order."""
    filed = T.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("paper_id"))
    return listing.without(T.table(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("name")), filed, "paper_id")


TREE_SQL = """nodes AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"""


def _tree(spark, d) -> DataFrame:
    mark = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = T.table(spark, d, "region").select(mark("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = T.table(spark, d, "nation").select(mark("n", "n_nationkey").alias("node"), mark("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    c = T.table(spark, d, "customer").select(mark("c", "c_custkey").alias("node"), mark("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return r.unionByName(n).unionByName(c)


@query(f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT node, node AS anc FROM nodes UNION ALL SELECT up.node, n.parent FROM up JOIN nodes n ON n.node = up.anc WHERE n.parent IS NOT NULL),
m AS (SELECT 'c' || o_custkey AS node, o_orderkey AS item FROM orders)
SELECT nodes.node, (SELECT count(DISTINCT item) FROM m WHERE m.node = nodes.node) AS direct_count, coalesce(s, 0) AS subtree_count FROM nodes
LEFT JOIN (SELECT anc, count(DISTINCT item) AS s FROM up JOIN m ON m.node = up.node GROUP BY 1) x ON x.anc = nodes.node""")
def subtree_counts(spark, d) -> DataFrame:
    members = T.table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.col("o_orderkey").alias("item"))
    return library.subtree_counts(_tree(spark, d), members)


@query(f"""WITH RECURSIVE {TREE_SQL}, down AS (SELECT node, name AS path, 0 AS depth FROM nodes WHERE parent IS NULL
UNION ALL SELECT n.node, down.path || '/' || n.name, depth + 1 FROM down JOIN nodes n ON n.parent = down.node) SELECT * FROM down""")
def tree_paths(spark, d) -> DataFrame:
    return library.tree_paths(_tree(spark, d))


ORPHAN_SQL = """nodes AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN -p_partkey WHEN p_partkey % 10 = 2 THEN p_partkey + 1 WHEN p_partkey % 10 = 3 THEN p_partkey - 1
 ELSE p_partkey - 4 END AS parent FROM part)"""


@query(f"""WITH RECURSIVE {ORPHAN_SQL}, down AS (SELECT node FROM nodes WHERE parent IS NULL UNION SELECT n.node FROM down JOIN nodes n ON n.parent = down.node),
up AS (SELECT node, parent AS anc FROM nodes WHERE node NOT IN (SELECT node FROM down) AND parent IS NOT NULL UNION SELECT up.node, n.parent FROM up JOIN nodes n ON n.node = up.anc WHERE n.parent IS NOT NULL)
SELECT node, CASE WHEN parent NOT IN (SELECT node FROM nodes) THEN 'MISSING_PARENT' WHEN EXISTS (SELECT 1 FROM up WHERE up.node = n.node AND up.anc = n.node) THEN 'PARENT_CYCLE' ELSE 'DISCONNECTED' END AS reason
FROM nodes n WHERE node NOT IN (SELECT node FROM down)""")
def tree_orphans(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    parent = F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, -k).when(k % 10 == 2, k + 1).when(k % 10 == 3, k - 1).otherwise(k - 4)
    return library.tree_orphans(T.table(spark, d, "part").select(k.alias("node"), parent.cast("long").alias("parent")))


@query("""WITH ranked AS (SELECT p_partkey AS document_id, l_orderkey AS paper_id, CASE p_type WHEN 'PROMO' THEN 'SUPPLEMENTARY' WHEN 'SMALL' THEN 'UNKNOWN' ELSE 'PRIMARY_ARTICLE' END AS role, p_size AS confidence
 FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey)
SELECT paper_id, document_id, role FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY CASE role WHEN 'PRIMARY_ARTICLE' THEN 0 WHEN 'UNKNOWN' THEN 1 ELSE 2 END, confidence DESC, document_id) AS k FROM ranked) WHERE k = 1""")
def primary_document(spark, d) -> DataFrame:
    docs = T.table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_type") == "PROMO", "SUPPLEMENTARY").when(F.col("p_type") == "SMALL", "UNKNOWN").otherwise("PRIMARY_ARTICLE").alias("role"), F.col("p_size").alias("confidence"))
    of = T.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().join(docs, "l_partkey")
    rank = F.when(F.col("role") == "PRIMARY_ARTICLE", 0).when(F.col("role") == "UNKNOWN", 1).otherwise(2)
    w = Window.partitionBy("l_orderkey").orderBy(rank, F.desc("confidence"), "l_partkey")
    return of.withColumn("k", F.row_number().over(w)).filter("k = 1").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("document_id"), "role")
