"""Stored state: listings, canonical hashes, scans of items and children, decision logs and extraction attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.operators import attempts, canonical, decisions, listing, scan
from scholargraph.plans.registry import query
from scholargraph.sources import tables as T


def _key(column: str):
    return F.col(column).cast("string")


# Parts as listed papers, suppliers as authors whose spellings are those of their nation.
def _listed(spark, d) -> tuple[DataFrame, DataFrame]:
    p = T.table(spark, d, "part").select(
        F.col("p_partkey").alias("ut"), F.col("p_name").alias("title"), F.concat(F.lit("10.1/P"), _key("p_partkey")).alias("doi"), F.col("p_brand").alias("venue"), (F.col("p_size") + 1970).cast("long").alias("year"))
    return p, T.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("ut"))


PAPERS_SQL = """p AS (SELECT p_partkey AS ut, p_name AS title, '10.1/P' || p_partkey AS doi, p_brand AS venue, CAST(p_size + 1970 AS BIGINT) AS year FROM part)"""


@query(f"""WITH {PAPERS_SQL} SELECT *, CAST(count(*) OVER () AS BIGINT) AS total FROM p WHERE (contains(lower(title), 'widget') OR contains(lower(doi), 'widget') OR contains(lower(venue), 'widget'))
AND ut IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY year DESC NULLS LAST, ut DESC LIMIT 50 OFFSET 3""")
def listed_with_files(spark, d) -> DataFrame:
    papers, files = _listed(spark, d)
    return listing.list_papers(papers, files, q=" Widget ", pdf_available=True, limit=50, offset=3)


@query(f"""WITH {PAPERS_SQL} SELECT *, CAST(count(*) OVER () AS BIGINT) AS total FROM p WHERE (contains(lower(title), '1') OR contains(lower(doi), '1') OR contains(lower(venue), '1')) AND lower(venue) = 'brand#13' AND year >= 1970
AND ut NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48) ORDER BY year DESC NULLS LAST, ut DESC LIMIT 200""")
def listed_without_files(spark, d) -> DataFrame:
    papers, _ = _listed(spark, d)
    files = T.table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 48").select(F.col("l_partkey").alias("ut"))
    return listing.list_papers(papers, files, q="1", venue="BRAND#13", pdf_available=False, limit=10_000)


@query("""WITH r AS (SELECT l_suppkey AS author, count(DISTINCT l_orderkey) AS papers, count(DISTINCT l_orderkey) FILTER (WHERE l_linenumber = 1) AS first_papers FROM lineitem GROUP BY 1),
a AS (SELECT s_suppkey AS author, s_name AS name, coalesce(papers, 0) AS papers, coalesce(first_papers, 0) AS first_papers FROM supplier LEFT JOIN r ON author = s_suppkey JOIN nation ON n_nationkey = s_nationkey
 WHERE contains(lower(s_name), '_1') OR contains(lower(n_name), '_1')) SELECT *, CAST(count(*) OVER () AS BIGINT) AS total FROM a ORDER BY lower(name), author LIMIT 200 OFFSET 1""")
def listed_authors(spark, d) -> DataFrame:
    s = T.table(spark, d, "supplier")
    spelled = s.join(T.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("author"), F.col("n_name").alias("spelling"))
    roles = T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("paper"), (F.col("l_linenumber") == 1).alias("first"))
    return listing.list_authors(s.select(F.col("s_suppkey").alias("author"), F.col("s_name").alias("name")), spelled, roles, "_1", 500, 1)


@query(f"""WITH {PAPERS_SQL}, h AS (SELECT ut FROM p WHERE contains(lower(title), 'cold') UNION SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE contains(s_name, '00007') UNION SELECT l_partkey FROM lineitem WHERE lower(l_returnflag) = 'cold')
SELECT ut, title, year FROM p WHERE ut IN (SELECT ut FROM h) ORDER BY year DESC NULLS LAST, ut LIMIT 500""")
def searched_records(spark, d) -> DataFrame:
    """Records by their own title or by their suppliers' names (either term, by two searches over one union)."""
    papers, _ = _listed(spark, d)
    lines = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("ut"), "l_suppkey", "l_returnflag")
    names = lines.join(T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").filter(F.col("s_name").contains("00007")).select("ut", F.lit("cold").alias("s_name"))
    return listing.search_records(papers, {"suppliers": (names, ["s_name"]), "flags": (lines, ["l_returnflag"])}, "cold", ["title"], 500).select("ut", "title", "year")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders)
SELECT c_custkey AS ut, c_name AS name, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey), '') AS orders, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS kinds
FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1, 2""")
def record_details(spark, d) -> DataFrame:
    """Customers with their orders and the kinds of these as nested rows."""
    o = T.table(spark, d, "orders")
    own = o.select(F.col("o_custkey").alias("ut"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    kinds = o.select(F.col("o_custkey").alias("ut"), F.col("o_orderpriority").alias("kind")).distinct()
    full = listing.detail(T.table(spark, d, "customer").select(F.col("c_custkey").alias("ut"), F.col("c_name").alias("name")), {"orders": (own, ["key"]), "kinds": (kinds, ["kind"])})
    return full.select("ut", "name", F.array_join(F.transform("orders", lambda x: F.concat_ws(":", x["key"].cast("string"), x["status"])), ",").alias("orders"), F.array_join(F.transform("kinds", lambda x: x["kind"]), ",").alias("kinds"))


@query("""WITH e AS (SELECT l_partkey AS src, l_suppkey + 100000 AS dst, l_returnflag AS predicate, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2, 3), m AS (SELECT min(src) AS k FROM e)
SELECT src, dst, predicate, weight, dst AS other FROM e, m WHERE src = k AND predicate IN ('A', 'R') ORDER BY weight DESC, predicate, src, dst LIMIT 500""")
def node_edges(spark, d) -> DataFrame:
    e = T.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000).alias("dst"), F.col("l_returnflag").alias("predicate")).agg(F.max("l_quantity").alias("weight"))
    return listing.edges_for_node(e, e.agg(F.min("src")).first()[0], ["A", "R"], 500)


# Parts as library items with two fields, a collection, a tag and, for odd sizes, an attachment.
@query("""WITH h AS (SELECT p_partkey, sha256('{"creators":[],"fields":[{"field":"brand","value":"' || p_brand || '"},{"field":"type","value":"' || p_type || '"}],"item_key":"' || p_partkey || '","item_type":"' || p_type || '","library_id":1}') AS b,
 sha256('{"collections":[{"collection_key":"c' || p_size || '","name":"' || p_brand || '","order_index":0,"parent_collection_key":null}],"tags":[{"name":"' || p_type || '","tag_type":0}]}') AS o,
 sha256(CASE WHEN p_size % 2 = 1 THEN '{"attachments":[{"attachment_key":"A","content_type":"application/pdf","link_mode":1,"path":"storage:' || p_partkey || '.pdf","storage_hash":null}]}' ELSE '{"attachments":[]}' END) AS a FROM part)
SELECT 1 AS library_id, CAST(p_partkey AS VARCHAR) AS item_key, b AS bibliographic_hash, o AS organization_hash, a AS attachment_hash, sha256('{"attachment":"' || a || '","bibliographic":"' || b || '","organization":"' || o || '"}') AS canonical_hash FROM h""")
def item_hashes(spark, d) -> DataFrame:
    p = T.table(spark, d, "part").withColumn("library_id", F.lit(1)).withColumn("item_key", _key("p_partkey"))
    keys = ["library_id", "item_key"]
    fields = p.select(*keys, F.explode(F.array(F.struct(F.lit("type").alias("field"), F.col("p_type").alias("value")), F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("value")))).alias("f")).select(*keys, "f.field", "f.value")
    creators = p.limit(0).select(*keys, F.lit(0).alias("order_index"), F.lit("").alias("creator_type"), F.lit("").alias("first_name"), F.lit("").alias("last_name"), F.lit(0).alias("field_mode"))
    collections = p.select(*keys, F.concat(F.lit("c"), _key("p_size")).alias("collection_key"), F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("parent_collection_key"), F.lit(0).alias("order_index"))
    tags = p.select(*keys, F.col("p_type").alias("name"), F.lit(0).alias("tag_type"))
    files = p.filter("p_size % 2 = 1").select(
        *keys, F.lit("A").alias("attachment_key"), F.lit(1).alias("link_mode"), F.lit("application/pdf").alias("content_type"), F.concat(F.lit("storage:"), _key("p_partkey"), F.lit(".pdf")).alias("path"), F.lit(None).cast("string").alias("storage_hash"))
    return canonical.item_hashes(p.select(*keys, F.col("p_type").alias("item_type")), fields, creators, collections, tags, files)


@query("""WITH r AS (SELECT sha256(coalesce(text, '')) AS h FROM documents), b AS (SELECT left(h, 4) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS items, sha256(string_agg(h, '' ORDER BY b)) AS set_hash FROM b""")
def corpus_hash(spark, d) -> DataFrame:
    return canonical.set_hash(T.table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")), "h")


# Orders as items whose status says what the scan finds; their lines are the children.
CHANGES_SQL = """ch AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS due, o_orderstatus = 'P' AS lost FROM orders)"""


def _changes(spark, d) -> DataFrame:
    s = F.col("o_orderstatus")
    every = F.array(*[F.lit(x) for x in ("attachment", "bibliographic", "organization")])
    return T.table(spark, d, "orders").select(
        F.lit(1).alias("library_id"), F.col("o_orderkey").alias("item_key"), F.when(s == "F", "MODIFIED").when(s == "P", "REMOVED").otherwise("UNCHANGED").alias("change"),
        F.when(s == "F", every).otherwise(F.array().cast("array<string>")).alias("dimensions"))


def _lines(spark, d) -> DataFrame:
    return T.table(spark, d, "lineitem").select(F.lit(1).alias("library_id"), F.col("l_orderkey").alias("item_key"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


@query("""WITH s AS (SELECT doc_id, lang || n_chars AS b, source AS o, lang <> 'es' AS present FROM documents WHERE source <> 'src3'), n AS (SELECT doc_id, lang || n_chars AS b, CASE WHEN lang = 'de' THEN 'moved' ELSE source END AS o FROM documents WHERE source <> 'src7')
SELECT 1 AS library_id, coalesce(s.doc_id, n.doc_id) AS item_key, CASE WHEN s.doc_id IS NULL THEN 'NEW' WHEN n.doc_id IS NULL THEN 'REMOVED' WHEN NOT present THEN 'RESTORED' WHEN s.o <> n.o THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change,
CASE WHEN s.doc_id IS NULL THEN 'attachment|bibliographic|organization' WHEN n.doc_id IS NOT NULL AND s.o <> n.o THEN 'organization' ELSE '' END AS dimensions FROM s FULL JOIN n ON s.doc_id = n.doc_id WHERE n.doc_id IS NOT NULL OR present""")
def item_changes(spark, d) -> DataFrame:
    docs = T.table(spark, d, "documents").select(
        F.lit(1).alias("library_id"), F.col("doc_id").alias("item_key"), F.concat("lang", _key("n_chars")).alias("bibliographic_hash"), F.col("source").alias("organization_hash"), F.lit("x").alias("attachment_hash"), "lang")
    state = docs.filter("organization_hash <> 'src3'").withColumn("present", F.col("lang") != "es")
    now = docs.filter("organization_hash <> 'src7'").withColumn("organization_hash", F.when(F.col("lang") == "de", "moved").otherwise(F.col("organization_hash")))
    whole = F.concat_ws("|", "bibliographic_hash", "organization_hash", "attachment_hash")
    out = scan.item_changes(state.withColumn("canonical_hash", whole).drop("lang"), now.withColumn("canonical_hash", whole).drop("lang"))
    return out.withColumn("dimensions", F.array_join("dimensions", "|"))


@query(f"""WITH {CHANGES_SQL}, o AS (SELECT DISTINCT l_orderkey AS k, 'old' || l_returnflag AS tag FROM lineitem), n AS (SELECT DISTINCT l_orderkey AS k, 'new' || l_linenumber AS tag FROM lineitem WHERE l_linenumber <= 2)
SELECT 1 AS library_id, k AS item_key, tag FROM o WHERE k NOT IN (SELECT k FROM ch WHERE due) UNION ALL SELECT 1, k, tag FROM n WHERE k IN (SELECT k FROM ch WHERE due)""")
def tags_after_scan(spark, d) -> DataFrame:
    lines, keys = _lines(spark, d), scan.KEYS
    old = lines.select(*keys, F.concat(F.lit("old"), "l_returnflag").alias("tag")).distinct()
    new = lines.filter("l_linenumber <= 2").select(*keys, F.concat(F.lit("new"), _key("l_linenumber")).alias("tag")).distinct()
    return scan.replaced(old, new, _changes(spark, d), "organization")


@query(f"""WITH {CHANGES_SQL}, o AS (SELECT l_orderkey AS k, l_linenumber AS i, 's' || min(l_suppkey) AS name, 'old' || l_orderkey || '-' || l_linenumber AS m FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey, l_linenumber),
n AS (SELECT l_orderkey AS k, l_linenumber AS i, 'p' || min(l_partkey) AS name FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5 GROUP BY 1, 2), od AS (SELECT * FROM o WHERE k IN (SELECT k FROM ch WHERE due)), nd AS (SELECT * FROM n WHERE k IN (SELECT k FROM ch WHERE due))
SELECT 1 AS library_id, k AS item_key, i AS order_index, name, m AS mention_id, TRUE AS active FROM o WHERE k NOT IN (SELECT k FROM ch WHERE due)
UNION ALL SELECT 1, coalesce(od.k, nd.k), coalesce(od.i, nd.i), coalesce(nd.name, od.name), coalesce(m, sha256('1|' || nd.k || '|' || nd.i)), nd.k IS NOT NULL FROM od FULL JOIN nd ON od.k = nd.k AND od.i = nd.i""")
def mentions_after_scan(spark, d) -> DataFrame:
    lines, place = _lines(spark, d), [*scan.KEYS, F.col("l_linenumber").alias("order_index")]
    old = lines.filter("l_linenumber <= 3").groupBy(*place).agg(F.concat(F.lit("s"), F.min("l_suppkey").cast("string")).alias("name"))
    old = old.withColumn("mention_id", F.concat(F.lit("old"), _key("item_key"), F.lit("-"), _key("order_index"))).withColumn("active", F.lit(True))
    new = lines.filter("l_linenumber between 2 and 5").groupBy(*place).agg(F.concat(F.lit("p"), F.min("l_partkey").cast("string")).alias("name"))
    return scan.reconciled_mentions(old, new, _changes(spark, d))


ATTACHED_SQL = f"""{CHANGES_SQL}, o AS (SELECT l_orderkey AS k, l_linenumber AS a, 'f' || min(l_partkey) || '.pdf' AS path FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), n AS (SELECT l_orderkey AS k, l_linenumber AS a, 'f' || min(l_suppkey) || '.pdf' AS path FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5 GROUP BY 1, 2),
f AS (SELECT 'f' || p_partkey || '.pdf' AS path FROM part WHERE p_size <= 25),
w AS (SELECT o.k, o.a, o.path, CASE WHEN lost THEN 'REMOVED' ELSE 'PRESENT' END AS state FROM o JOIN ch ON ch.k = o.k WHERE NOT due UNION ALL SELECT n.k, n.a, n.path, 'PRESENT' FROM n JOIN ch ON ch.k = n.k WHERE due
 UNION ALL SELECT o.k, o.a, o.path, 'REMOVED' FROM o JOIN ch ON ch.k = o.k WHERE due AND NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k AND n.a = o.a)),
att AS (SELECT *, CASE WHEN state = 'REMOVED' THEN 'REMOVED' WHEN path IN (SELECT path FROM f) THEN 'AVAILABLE' ELSE 'MISSING' END AS availability FROM w)"""


def _attached(spark, d) -> DataFrame:
    lines, place = _lines(spark, d), [*scan.KEYS, F.col("l_linenumber").alias("attachment_key")]
    file = lambda c: F.concat(F.lit("f"), F.min(c).cast("string"), F.lit(".pdf")).alias("path")
    kind = F.lit("application/pdf")
    old = lines.filter("l_linenumber <= 3").groupBy(*place).agg(file("l_partkey")).withColumn("content_type", kind).withColumn("state", F.lit("PRESENT"))
    new = lines.filter("l_linenumber between 2 and 5").groupBy(*place).agg(file("l_suppkey")).withColumn("content_type", kind)
    there = T.table(spark, d, "part").filter("p_size <= 25").select(F.concat(F.lit("f"), _key("p_partkey"), F.lit(".pdf")).alias("path"))
    return scan.attachments_after(old, new, _changes(spark, d), there)


@query(f"WITH {ATTACHED_SQL} SELECT 1 AS library_id, k AS item_key, a AS attachment_key, 'application/pdf' AS content_type, path, state, availability FROM att")
def attachments_after_scan(spark, d) -> DataFrame:
    return _attached(spark, d)


@query(f"WITH {ATTACHED_SQL} SELECT 1 AS library_id, k AS item_key, sha256('1|' || k || '|' || a) AS document_id, CASE availability WHEN 'AVAILABLE' THEN 'PDF_AVAILABLE' WHEN 'REMOVED' THEN 'PDF_REMOVED' ELSE 'PDF_MISSING' END AS availability_status FROM att")
def documents_after_scan(spark, d) -> DataFrame:
    return scan.documents(_attached(spark, d))


@query("""WITH s AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS parent, c_mktsegment <> 'FURNITURE' AS present FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END AS name, c_nationkey AS parent FROM customer WHERE c_custkey % 6 <> 0)
SELECT 1 AS library_id, coalesce(s.k, n.k) AS collection_key, CASE WHEN s.k IS NULL THEN 'NEW' WHEN n.k IS NULL THEN 'REMOVED' WHEN NOT present THEN 'RESTORED' WHEN s.name = n.name THEN 'UNCHANGED' ELSE 'UPDATED' END AS change, n.k IS NOT NULL AS present
FROM s FULL JOIN n ON s.k = n.k WHERE n.k IS NOT NULL OR s.present""")
def catalogue_after_scan(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    c = T.table(spark, d, "customer").select(
        F.lit(1).alias("library_id"), k.alias("collection_key"), F.col("c_name").alias("name"), _key("c_nationkey").alias("parent_key"), F.lit(1).alias("version"), F.lit(False).alias("deleted"), F.lit("/").alias("path"), "c_mktsegment")
    key = F.col("collection_key")
    state = c.filter(key % 5 != 0).withColumn("present", F.col("c_mktsegment") != "FURNITURE").drop("c_mktsegment")
    now = c.filter(key % 6 != 0).withColumn("name", F.when(key % 7 == 0, F.upper("name")).otherwise(F.col("name"))).drop("c_mktsegment")
    return scan.catalogue_after(state, now)


# A decision log: a line is a decision on its supplier as mention and its part's group as author.
LOG_SQL = """lg AS (SELECT l_orderkey * 100 + l_linenumber * 10 + min(l_suppkey) % 10 AS seq, min(l_suppkey) AS mention, min(l_partkey) % 40 AS author, CASE min(l_partkey) % 11 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'SPLIT' WHEN 2 THEN 'UNLINK' WHEN 3 THEN 'NOT_SAME' WHEN 4 THEN 'LOCK' WHEN 5 THEN 'UNLOCK' ELSE 'ACCEPT' END AS op,
 CASE WHEN min(l_returnflag) = 'A' THEN 'MANUAL' ELSE 'AUTO' END AS actor FROM lineitem GROUP BY l_orderkey, l_linenumber),
t AS (SELECT *, CASE WHEN op IN ('CREATE', 'SPLIT') THEN 'a' || left(sha256(mention || '|' || seq), 16) WHEN op <> 'UNLINK' THEN CAST(author AS VARCHAR) END AS target FROM lg),
seen AS (SELECT *, last_value(CASE WHEN op = 'LOCK' THEN TRUE WHEN op = 'UNLOCK' THEN FALSE END IGNORE NULLS) OVER (PARTITION BY target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS locked,
 max(op = 'NOT_SAME') OVER (PARTITION BY mention, target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS barred, row_number() OVER (PARTITION BY mention ORDER BY seq) AS i FROM t),
locks AS (SELECT target AS author, seq, op = 'LOCK' AS closed FROM t WHERE op IN ('LOCK', 'UNLOCK')),
spans AS (SELECT author, seq AS a, coalesce(lead(seq) OVER (PARTITION BY author ORDER BY seq), 9e18) AS b, closed FROM locks),
replay AS (  -- one row of every mention a step: what it holds, and what its next decision makes of that
 SELECT mention, CAST(0 AS BIGINT) AS i, NULL::VARCHAR AS held, NULL::VARCHAR AS after, NULL::VARCHAR AS reason, FALSE AS moves, NULL::BIGINT AS seq FROM (SELECT DISTINCT mention FROM lg)
 UNION ALL
 SELECT mention, i, held, CASE WHEN moves THEN target ELSE held END, reason, moves, seq FROM (
  SELECT *, reason IS NULL AND op IN ('ACCEPT', 'CREATE', 'SPLIT', 'UNLINK') AND NOT (op = 'ACCEPT' AND target IS NOT DISTINCT FROM held) AND NOT (op = 'CREATE' AND held IS NOT NULL) AND NOT (op = 'UNLINK' AND held IS NULL) AS moves FROM (
   SELECT s.mention, s.i, s.seq, s.op, s.target, p.after AS held,
    CASE WHEN op = 'ACCEPT' THEN CASE WHEN s.target IS NOT DISTINCT FROM p.after THEN NULL WHEN locked THEN 'LOCKED' WHEN barred AND actor <> 'MANUAL' THEN 'NOT_SAME' WHEN closed THEN 'HELD_LOCKED' END
     WHEN op IN ('SPLIT', 'UNLINK') THEN CASE WHEN p.after IS NULL AND op = 'SPLIT' THEN 'NOTHING_HELD' WHEN closed THEN 'HELD_LOCKED' END END AS reason
   FROM replay p JOIN seen s ON s.mention = p.mention AND s.i = p.i + 1 LEFT JOIN spans l ON l.author = p.after AND l.a < s.seq AND s.seq <= l.b))),
jl AS (SELECT seen.*, r.held, r.reason, r.moves FROM seen JOIN replay r ON r.mention = seen.mention AND r.i = seen.i)"""


def _log(spark, d) -> DataFrame:
    g = T.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"))
    kind = F.col("p") % 11
    op = F.when(kind == 0, "CREATE").when(kind == 1, "SPLIT").when(kind == 2, "UNLINK").when(kind == 3, "NOT_SAME").when(kind == 4, "LOCK").when(kind == 5, "UNLOCK").otherwise("ACCEPT")
    return g.select((F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("s") % 10).alias("seq"), F.col("s").alias("mention"), (F.col("p") % 40).alias("author"), op.alias("op"), F.when(F.col("f") == "A", "MANUAL").otherwise("AUTO").alias("actor"))


@query(f"WITH RECURSIVE {LOG_SQL} SELECT seq, op, mention, target, held, moves, CASE WHEN reason IS NULL THEN 'DONE' ELSE 'REFUSED' END AS outcome, reason FROM jl")
def judged_decisions(spark, d) -> DataFrame:
    return decisions.judged_log(_log(spark, d)).select("seq", "op", "mention", "target", "held", "moves", "outcome", "reason")


@query(f"""WITH RECURSIVE {LOG_SQL}, sp AS (SELECT *, lead(seq) OVER (PARTITION BY mention ORDER BY seq) AS until FROM jl WHERE moves)
SELECT seq, mention, target AS author, CASE WHEN until IS NULL THEN 'ACCEPTED' ELSE 'SUPERSEDED' END AS status, until FROM sp WHERE op <> 'UNLINK'""")
def identity_memberships(spark, d) -> DataFrame:
    return decisions.memberships(_log(spark, d))


@query("""SELECT DISTINCT least(l_partkey, l_suppkey) AS left_id, greatest(l_partkey, l_suppkey) AS right_id FROM lineitem WHERE l_partkey <> l_suppkey AND l_returnflag = 'R'""")
def not_same_pairs(spark, d) -> DataFrame:
    return decisions.not_same_pairs(T.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("author"), F.col("l_suppkey").alias("other")))


@query("""WITH lg AS (SELECT o_orderkey AS seq, o_custkey AS subject, CASE o_orderstatus WHEN 'P' THEN 'RESOLVE' WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'DISMISS' ELSE 'ENQUEUE' END ELSE 'ENQUEUE' END AS op, CAST(left(o_orderpriority, 1) AS BIGINT) AS priority FROM orders),
p AS (SELECT *, coalesce(sum((op <> 'ENQUEUE')::INT) OVER (PARTITION BY subject ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS item FROM lg),
i AS (SELECT subject, item, min(seq) FILTER (WHERE op = 'ENQUEUE') AS opened, max(priority) FILTER (WHERE op = 'ENQUEUE') AS priority, max(seq) FILTER (WHERE op <> 'ENQUEUE') AS closed, arg_max(op, seq) FILTER (WHERE op <> 'ENQUEUE') AS e FROM p GROUP BY 1, 2)
SELECT subject, CASE WHEN closed IS NULL THEN 'OPEN' WHEN e = 'RESOLVE' THEN 'RESOLVED' ELSE 'DISMISSED' END AS status, priority, opened, closed FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY item DESC) AS k FROM i WHERE opened IS NOT NULL) WHERE k = 1""")
def review_states(spark, d) -> DataFrame:
    op = F.when(F.col("o_orderstatus") == "P", "RESOLVE").when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), "DISMISS").otherwise("ENQUEUE")
    return decisions.review_queue(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("subject"), op.alias("op"), F.substring("o_orderpriority", 1, 1).cast("long").alias("priority")))


# Attempts: the lines of an order are the attempts of its run, their flags the reviews.
ATTEMPTS_SQL = """att AS (SELECT l_orderkey AS run, l_linenumber AS number, l_orderkey * 10 + l_linenumber AS attempt, max(l_partkey) % 5 AS v FROM lineitem GROUP BY 1, 2),
rv AS (SELECT *, CASE v WHEN 0 THEN 'RETRY' WHEN 1 THEN 'PASS' WHEN 2 THEN 'UNRESOLVED' WHEN 3 THEN 'RETRY' END AS decision FROM att)"""


def _attempts(spark, d) -> tuple[DataFrame, DataFrame]:
    a = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("number")).agg((F.max("l_partkey") % 5).alias("v"))
    a = a.withColumn("attempt", F.col("run") * 10 + F.col("number"))
    v = F.col("v")
    last = a.filter("v <> 4").select("attempt", F.lit(2).alias("seq"), F.when(v.isin(0, 3), "RETRY").when(v == 1, "PASS").otherwise("UNRESOLVED").alias("decision"))
    first = last.select("attempt", F.lit(1).alias("seq"), F.lit("PASS").alias("decision"))
    return a.select("run", "number", "attempt"), last.unionByName(first)


@query(f"""WITH {ATTEMPTS_SQL}, w AS (SELECT *, lag(number) OVER (PARTITION BY run ORDER BY number) AS b, lag(decision) OVER (PARTITION BY run ORDER BY number) AS said FROM rv)
SELECT attempt, problem FROM (SELECT attempt, CASE WHEN number NOT BETWEEN 1 AND 3 THEN 'NUMBER' WHEN coalesce(b, 0) <> number - 1 THEN 'NO_PREVIOUS' WHEN number > 1 AND said IS DISTINCT FROM 'RETRY' THEN 'NOT_RETRY' END AS problem FROM w) WHERE problem IS NOT NULL""")
def illegal_attempts(spark, d) -> DataFrame:
    return attempts.illegal_attempts(*_attempts(spark, d))


@query(f"""WITH {ATTEMPTS_SQL}, e AS (SELECT run, max(number) FILTER (WHERE decision IN ('PASS', 'UNRESOLVED')) AS n FROM rv GROUP BY 1)
SELECT e.run, CASE WHEN n IS NULL THEN 'STARTED' ELSE 'COMPLETED' END AS status, decision AS final_status, CASE WHEN decision = 'PASS' THEN attempt END AS accepted_attempt FROM e LEFT JOIN rv ON rv.run = e.run AND rv.number = n""")
def run_outcomes(spark, d) -> DataFrame:
    return attempts.run_outcomes(*_attempts(spark, d))


@query(f"""WITH {ATTEMPTS_SQL}, e AS (SELECT run, max(number) AS n, arg_max(decision, number) AS dec FROM rv WHERE decision IN ('PASS', 'UNRESOLVED') GROUP BY 1),
ou AS (SELECT DISTINCT l_partkey * 100000000 + l_orderkey * 10 + l_linenumber AS output, l_orderkey * 10 + l_linenumber AS attempt, CASE WHEN l_partkey % 3 = 0 THEN 'REJECTED' ELSE 'CANDIDATE' END AS status FROM lineitem)
SELECT output, ou.attempt, CASE WHEN n IS NULL OR status = 'REJECTED' OR number > n THEN status WHEN number < n THEN 'SUPERSEDED' WHEN dec = 'PASS' THEN 'ACCEPTED' ELSE 'REJECTED' END AS status FROM ou JOIN rv ON rv.attempt = ou.attempt LEFT JOIN e ON e.run = rv.run""")
def output_statuses(spark, d) -> DataFrame:
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    out = T.table(spark, d, "lineitem").select((F.col("l_partkey") * 100000000 + line).alias("output"), line.alias("attempt"), F.when(F.col("l_partkey") % 3 == 0, "REJECTED").otherwise("CANDIDATE").alias("status")).distinct()
    return attempts.output_statuses(out, *_attempts(spark, d))


@query("""WITH r AS (SELECT p_partkey AS run, p_partkey % 4 = 1 AS started, CASE WHEN p_size < 10 THEN 'old' ELSE 'k' || p_partkey END AS seen, CASE WHEN p_size > 40 THEN 'x1' ELSE 'x2' END AS ex, p_brand AS pr FROM part WHERE p_partkey % 3 <> 0)
SELECT p_partkey AS document, CASE WHEN p_type = 'PROMO' OR coalesce(started, FALSE) THEN NULL WHEN run IS NULL THEN 'FIRST_AVAILABLE' WHEN seen <> 'k' || p_partkey THEN 'FILE_CHANGED' WHEN ex <> 'x2' THEN 'EXTRACTOR_CHANGED' WHEN pr <> 'Brand#13' THEN 'PROMPT_CHANGED' END AS trigger
FROM part LEFT JOIN r ON run = p_partkey""")
def extraction_triggers(spark, d) -> DataFrame:
    k, p = F.col("p_partkey"), T.table(spark, d, "part")
    key = F.concat(F.lit("k"), _key("p_partkey"))
    docs = p.select(k.alias("document"), F.when(F.col("p_type") == "PROMO", "PDF_MISSING").otherwise("PDF_AVAILABLE").alias("availability_status"), key.alias("change_key"), F.when(k % 3 != 0, k).alias("current_run"))
    runs = p.filter(k % 3 != 0).select(
        k.alias("run"), k.alias("document"), F.when(k % 4 == 1, "STARTED").otherwise("COMPLETED").alias("status"), F.when(F.col("p_size") < 10, "old").otherwise(key).alias("change_key"),
        F.when(F.col("p_size") > 40, "x1").otherwise("x2").alias("extractor"), F.col("p_brand").alias("prompt"))
    return attempts.triggers(docs, runs, "x2", "Brand#13")


@query("""WITH b AS (SELECT conv_id AS attempt, turn AS position, role AS kind, trim(regexp_replace(coalesce(text, ''), '\\n\\s*\\n+', chr(10), 'g')) AS text FROM conversations WHERE turn <> 1)
SELECT attempt, CAST(row_number() OVER (PARTITION BY attempt ORDER BY position) - 1 AS BIGINT) AS position, kind, sha256(text) AS text_hash FROM b WHERE text <> ''""")
def persisted_spans(spark, d) -> DataFrame:
    c = T.table(spark, d, "conversations").filter("turn <> 1").select(F.col("conv_id").alias("attempt"), F.col("turn").alias("position"), F.col("role").alias("kind"), "text")
    return attempts.spans(c).select("attempt", "position", "kind", F.sha2("text", 256).alias("text_hash"))
