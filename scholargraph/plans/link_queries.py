"""Links by name, accepted links and reviews on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.operators import linking, listing
from scholargraph.plans.registry import query
from scholargraph.sources import tables as T
from scholargraph.sources import tagged


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS ut, l_partkey AS child, 'n' || l_suppkey % 6 AS name FROM lineitem WHERE l_linenumber <= 3), a AS (SELECT DISTINCT l_orderkey AS ut, l_linenumber AS order_index, 'n' || l_suppkey % 6 AS name FROM lineitem WHERE l_linenumber > 2)
SELECT DISTINCT c.ut, child, order_index FROM c JOIN a ON a.ut = c.ut AND a.name = c.name""")
def address_links(spark, d) -> DataFrame:
    lines = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ut"), F.col("l_partkey").alias("child"), F.col("l_linenumber").alias("order_index"), F.concat(F.lit("n"), (F.col("l_suppkey") % 6).cast("string")).alias("name"))
    return linking.link_by_name(lines.filter("order_index <= 3").select("ut", "child", "name").distinct(), lines.filter("order_index > 2").select("ut", "order_index", "name").distinct())


@query("""WITH n AS (SELECT l_orderkey AS ut, l_partkey AS k, l_linenumber AS i, ['a', 'an', 'ann', 'bo', ''][CAST(l_suppkey % 5 + 1 AS INTEGER)] AS f, 'l' || l_suppkey % 3 AS l FROM lineitem),
w AS (SELECT DISTINCT ut, k AS wanted, f, l FROM n WHERE i <= 2), u AS (SELECT DISTINCT ut, wanted, min(f) AS f, min(l) AS l FROM w GROUP BY ut, wanted), a AS (SELECT ut, i AS order_index, min(f) AS f, min(l) AS l FROM n WHERE i > 1 GROUP BY 1, 2),
j AS (SELECT u.ut, wanted, order_index, u.f = a.f AS ex FROM u JOIN a ON a.ut = u.ut AND a.l = u.l WHERE u.f = a.f OR (u.f <> '' AND a.f <> '' AND (starts_with(u.f, a.f) OR starts_with(a.f, u.f)))),
g AS (SELECT ut, wanted, count(*) FILTER (WHERE ex) AS s, count(*) AS n, min(order_index) FILTER (WHERE ex) AS o, min(order_index) AS y FROM j GROUP BY 1, 2)
SELECT ut, wanted, CASE WHEN s = 1 THEN o ELSE y END AS order_index FROM g WHERE s = 1 OR (s = 0 AND n = 1)""")
def corresponding_authors(spark, d) -> DataFrame:
    first = F.get(F.array(*[F.lit(x) for x in ("a", "an", "ann", "bo", "")]), (F.col("l_suppkey") % 5).cast("int"))
    n = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ut"), F.col("l_partkey").alias("wanted"), F.col("l_linenumber").alias("order_index"), first.alias("first"), F.concat(F.lit("l"), (F.col("l_suppkey") % 3).cast("string")).alias("last"))
    named = [F.min("first").alias("first"), F.min("last").alias("last")]
    return linking.unique_matches(n.filter("order_index <= 2").groupBy("ut", "wanted").agg(*named), n.filter("order_index > 1").groupBy("ut", "order_index").agg(*named))


LINKS_SQL = """l AS (SELECT o_orderkey AS link, o_custkey AS paper, o_orderkey % 50 AS ut, CASE WHEN o_orderstatus = 'P' THEN 'REJECTED' ELSE 'ACCEPTED' END AS status FROM orders), r AS (SELECT s_suppkey AS ut FROM supplier WHERE s_suppkey % 3 <> 0)"""


def _links(spark, d) -> tuple[DataFrame, DataFrame]:
    links = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), F.col("o_custkey").alias("paper"), (F.col("o_orderkey") % 50).alias("ut"), F.when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("ACCEPTED").alias("status"))
    return links, T.table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("ut"))


@query(f"WITH {LINKS_SQL} SELECT link, paper, ut, status FROM l WHERE status = 'ACCEPTED' AND ut NOT IN (SELECT ut FROM r)")
def stale_links(spark, d) -> DataFrame:
    return linking.stale_links(*_links(spark, d)).select("link", "paper", "ut", "status")


@query(f"""WITH {LINKS_SQL}, x AS (SELECT paper, arg_max(ut, link) AS ut FROM l WHERE status = 'ACCEPTED' GROUP BY 1)
SELECT c_custkey AS paper, CASE WHEN x.ut IN (SELECT ut FROM r) THEN 'IN_CORPUS' WHEN x.ut IS NOT NULL THEN 'STALE_LINK' WHEN c_custkey % 4 = 0 THEN 'AMBIGUOUS' ELSE 'NOT_CHECKED' END AS state FROM customer LEFT JOIN x ON x.paper = c_custkey""")
def corpus_states(spark, d) -> DataFrame:
    papers = T.table(spark, d, "customer").select(F.col("c_custkey").alias("paper"))
    links, records = _links(spark, d)
    return linking.corpus_states(papers, links, papers.filter("paper % 4 = 0").withColumn("state", F.lit("AMBIGUOUS")), records)


@query(f"""WITH {LINKS_SQL}, o AS (SELECT paper, max(ut) AS ut FROM l GROUP BY 1), n AS (SELECT c_custkey AS paper, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_custkey + 1000 ELSE o.ut END AS ut FROM customer LEFT JOIN o ON o.paper = c_custkey WHERE c_custkey % 2 = 0)
SELECT o.paper, o.ut, CASE WHEN n.paper IS NOT NULL AND n.ut IS DISTINCT FROM o.ut THEN 'SUPERSEDED' ELSE 'ACCEPTED' END AS status FROM o LEFT JOIN n ON n.paper = o.paper
UNION ALL SELECT n.paper, n.ut, 'ACCEPTED' FROM n LEFT JOIN o ON o.paper = n.paper WHERE n.ut IS NOT NULL AND n.ut IS DISTINCT FROM o.ut""")
def superseded_links(spark, d) -> DataFrame:
    old = _links(spark, d)[0].groupBy("paper").agg(F.max("ut").alias("ut"))
    k = F.col("paper")
    new = T.table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("paper")).join(old.withColumnRenamed("ut", "was"), "paper", "left").withColumn(
        "ut", F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, k + 1000).otherwise(F.col("was")))
    return linking.superseded_links(old, new.select("paper", "ut", F.when(F.col("ut").isNull(), "AMBIGUOUS").otherwise("MATCHED").alias("state")))


@query("""WITH m AS (SELECT l_orderkey AS paper, l_orderkey * 10 + l_linenumber AS mention, l_linenumber AS position, 's' || min(l_suppkey) AS name FROM lineitem GROUP BY 1, 2, 3), f AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY position, mention) = 1 AS is_first FROM m),
q AS (SELECT o_orderkey AS item, CAST(o_orderkey * 10 + 1 AS VARCHAR) AS subject, o_custkey AS candidate, round(o_totalprice) AS priority FROM orders WHERE o_orderstatus = 'O')
SELECT item, subject, candidate, priority, f.name AS mention_name, paper, is_first, c_name AS candidate_name FROM q LEFT JOIN f ON CAST(mention AS VARCHAR) = subject LEFT JOIN customer ON c_custkey = candidate ORDER BY priority DESC, item LIMIT 300""")
def review_details(spark, d) -> DataFrame:
    m = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention"), F.col("l_linenumber").alias("position")).agg(F.concat(F.lit("s"), F.min("l_suppkey").cast("string")).alias("name"))
    q = T.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("item"), (F.col("o_orderkey") * 10 + 1).cast("string").alias("subject"), F.col("o_custkey").alias("candidate"), F.round("o_totalprice").alias("priority"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("DONE").alias("status"))
    return linking.review_details(q, m, T.table(spark, d, "customer").select(F.col("c_custkey").alias("author"), F.col("c_name").alias("name")), 300)


@query("""SELECT p_partkey AS item, p_type AS item_type, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS deleted FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')""")
def bibliographic_items(spark, d) -> DataFrame:
    gone = T.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("item"))
    return linking.active_items(T.table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("item_type")), gone, ["PROMO", "SMALL"], include_deleted=True)


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS k, max_by(l_partkey, l_quantity) FILTER (WHERE l_returnflag <> 'N') AS a, max_by(l_suppkey, l_quantity) FILTER (WHERE l_suppkey % 2 = 0) AS b FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2, 3, 4) GROUP BY 1)
SELECT k, a, b FROM x WHERE k IN (SELECT k FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem)) GROUP BY k HAVING count(*) = count(DISTINCT l_quantity))""")
def upserted_children(spark, d) -> DataFrame:
    """Child rows merged over batches (the quantity stands for the batch); keys of two rows in one batch are left out."""
    rows = T.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("batch"), F.when(F.col("l_returnflag") != "N", F.col("p")).alias("a"), F.when(F.col("s") % 2 == 0, F.col("s")).alias("b"))
    once = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("batch").alias("m")).filter("n = m").select("k")
    return linking.upsert_children(rows.join(once, "k", "left_semi"), ["k"], "batch", ["a", "b"])


@query("""WITH n AS (SELECT DISTINCT doc_id AS paper, lower(word) AS family FROM (SELECT doc_id, unnest(string_split(split_part(text, chr(10), 1), ' ')[1:3]) AS word FROM documents WHERE text IS NOT NULL) WHERE length(lower(word)) >= 2)
SELECT n.paper, count(*) FILTER (WHERE contains(lower(text), family)) / count(*) AS coverage FROM n JOIN documents ON doc_id = paper GROUP BY 1""")
def surname_coverage(spark, d) -> DataFrame:
    """The first words of each document as surnames, looked for in its text in lower case."""
    docs = T.table(spark, d, "documents").filter("text is not null")
    names = docs.select(F.col("doc_id").alias("paper"), F.explode(F.slice(F.split(F.split("text", "\n")[0], " "), 1, 3)).alias("w")).select("paper", F.lower("w").alias("family"))
    return linking.surname_coverage(names, docs.select(F.col("doc_id").alias("paper"), F.lower("text").alias("text")))


@query("""WITH s AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT coalesce(s.k, t.k) AS k, s.n AS stored, t.n AS derived FROM s FULL JOIN t ON s.k = t.k WHERE s.n IS DISTINCT FROM t.n""")
def projection_mismatches(spark, d) -> DataFrame:
    o = T.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    n = F.count(F.lit(1)).alias("n")
    return linking.mismatched(o.filter("o_orderstatus <> 'P'").groupBy("k").agg(n), o.groupBy("k").agg(n), ["k"], "n")


@query("""WITH m AS (SELECT o_custkey AS collection, o_orderkey % 400 AS ut, min(o_orderkey % 7) AS order_index FROM orders GROUP BY 1, 2) SELECT collection, ut, order_index FROM m JOIN part ON p_partkey = ut ORDER BY order_index, p_size DESC NULLS LAST, ut DESC, collection LIMIT 500""")
def collection_listing(spark, d) -> DataFrame:
    members = T.table(spark, d, "orders").select(F.col("o_custkey").alias("collection"), (F.col("o_orderkey") % 400).alias("ut"), (F.col("o_orderkey") % 7).alias("order_index"))
    return listing.collection_papers(members, T.table(spark, d, "part").select(F.col("p_partkey").alias("ut"), F.col("p_size").alias("year")))


@query("""WITH s AS (SELECT l_orderkey AS k, l_suppkey AS s, l_linenumber AS i, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2, 3), a AS (SELECT k, count(*) AS authors, arg_min(s, (i, s)) AS first, count(*) FILTER (WHERE p % 2 = 0) AS refs FROM s GROUP BY 1)
SELECT 'WOS:' || k AS ut, 'A study of ' || k || ' parts' AS title, CAST(year(o_orderdate) AS INTEGER) AS year, authors, 'Supplier ' || first AS first_author, refs AS cited, CASE WHEN refs = 0 THEN 'MISSING_FROM_EXPORT' WHEN refs >= authors THEN 'COMPLETE' ELSE 'PARTIAL' END AS cr_status,
o_orderpriority AS keyword, CAST(k % 50 AS INTEGER) AS times_cited, 'V' || k % 9 AS volume FROM a JOIN orders ON o_orderkey = k WHERE k % 10 <> 3""")
def tagged_records(spark, d) -> DataFrame:
    """Orders written as tagged records (continued titles, one author a line, no accession number for some) and read again."""
    one = T.table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    lines = one.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "p"))).alias("all"))
    full = lines.join(T.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("l_orderkey").cast("string")
    mark = lambda tag, values: F.transform(values, lambda v, i: F.concat(F.when(i == 0, F.lit(f"{tag} ")).otherwise(F.lit("   ")), v))
    text = lambda tag, value: F.array(F.concat(F.lit(f"{tag} "), value))
    cited = F.transform(F.filter("all", lambda x: x["p"] % 2 == 0), lambda x: F.concat(F.lit("Supplier "), x["l_suppkey"].cast("string"), F.lit(", 1999, J PART")))
    record = F.concat(
        F.array(F.lit("ignored"), F.lit("PT J ")), mark("AU", F.transform("all", lambda x: F.concat(F.lit("Supplier "), x["l_suppkey"].cast("string")))),
        F.array(F.lit("TI A study of"), F.concat(F.lit("   "), k, F.lit("  parts"))), text("PY", F.year("o_orderdate").cast("string")), text("DE", F.col("o_orderpriority")), mark("CR", cited),
        text("NR", F.size("all").cast("string")), text("TC", (F.col("l_orderkey") % 50).cast("string")), text("VL", F.concat(F.lit("V"), (F.col("l_orderkey") % 9).cast("string"))),
        F.when(F.col("l_orderkey") % 10 != 3, text("UT", F.concat(F.lit("WOS:"), k))).otherwise(F.array().cast("array<string>")))
    out = tagged.interpret(tagged.parse_records(full.select(F.lit("orders").alias("file"), record.alias("lines"))))
    return out.select("ut", "title", "year", F.size("authors").cast("long").alias("authors"), F.col("authors")[0]["au_name"].alias("first_author"), F.size("references").cast("long").alias("cited"), "cr_status",
                      F.col("keywords")[0].alias("keyword"), "times_cited", "volume")


@query(f"""WITH {LINKS_SQL}, x AS (SELECT paper, arg_max(ut, link) AS ut FROM l WHERE status = 'ACCEPTED' GROUP BY 1), st AS (SELECT c_custkey AS paper, ut, CASE WHEN x.ut IN (SELECT ut FROM r) THEN 'IN_CORPUS' WHEN x.ut IS NOT NULL THEN 'STALE_LINK' ELSE 'NOT_CHECKED' END AS state FROM customer LEFT JOIN x ON x.paper = c_custkey),
co AS (SELECT l_suppkey AS ut, l_linenumber AS g, min(l_orderkey) AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'NAME' ELSE 'name' END || l_linenumber // 2 AS name FROM lineitem GROUP BY 1, 2), f AS (SELECT ut, lower(name) AS low, min((g, pos, name)) AS f FROM co GROUP BY 1, 2),
a AS (SELECT ut, string_agg(f[3], '|' ORDER BY f) AS names FROM f GROUP BY 1), kd AS (SELECT l_suppkey AS ut, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1)
SELECT paper, state, r.ut, coalesce(names, '') AS corresponding, coalesce(flags, '') AS flags FROM st LEFT JOIN r ON r.ut = st.ut LEFT JOIN a ON a.ut = r.ut LEFT JOIN kd ON kd.ut = r.ut""")
def paper_details(spark, d) -> DataFrame:
    """Customers as papers: their state, record, corresponding authors at their first place, and another child."""
    links, records = _links(spark, d)
    papers = T.table(spark, d, "customer").select(F.col("c_custkey").alias("paper"))
    states = linking.corpus_states(papers, links, papers.limit(0).withColumn("state", F.lit("")), records)
    lines, i = T.table(spark, d, "lineitem"), F.col("l_linenumber")
    name = F.concat(F.when(i % 2 == 0, "NAME").otherwise("name"), F.expr("l_linenumber div 2").cast("string"))
    corresponding = lines.groupBy(F.col("l_suppkey").alias("ut"), "l_linenumber").agg(F.min("l_orderkey").alias("position")).select("ut", F.col("l_linenumber").alias("group"), "position", name.alias("name"))
    flags = lines.select(F.col("l_suppkey").alias("ut"), F.col("l_returnflag").alias("flag")).distinct()
    out = linking.paper_details(states, linking.paper_records(links), records, corresponding, {"flags": (flags, ["flag"])})
    return out.select("paper", "state", "ut", F.array_join(F.transform("corresponding", lambda c: c["name"]), "|").alias("corresponding"), F.array_join(F.transform("flags", lambda c: c["flag"]), "|").alias("flags"))
