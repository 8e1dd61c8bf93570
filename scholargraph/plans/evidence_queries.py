"""Runs, evidence, seeds, samples and audits on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.operators import evidence, runs
from scholargraph.plans.citation_queries import GRAPH_SQL, _graph
from scholargraph.plans.registry import query
from scholargraph.sources import tables as T


@query(f"""WITH {GRAPH_SQL}, e AS (SELECT 'CITES_OBSERVED' AS predicate, src, dst, 1.0 AS weight FROM edges UNION ALL SELECT 'BIBLIOGRAPHIC_COUPLING', source_ut, target_ut, cosine FROM coupling UNION ALL SELECT 'CO_CITATION', source_ut, target_ut, normalized_co_citation FROM cocitation),
n AS (SELECT predicate, count(DISTINCT ut) AS nodes FROM (SELECT predicate, src AS ut FROM e UNION ALL SELECT predicate, dst FROM e) GROUP BY 1)
SELECT e.predicate, count(*) AS edges, CAST(min(weight) AS DOUBLE) AS least, CAST(max(weight) AS DOUBLE) AS most, any_value(nodes) AS nodes FROM e JOIN n ON n.predicate = e.predicate GROUP BY 1""")
def analysis_stats(spark, d) -> DataFrame:
    _, edges, coupling, cocit = _graph(spark, d)
    every = edges.select(F.lit("CITES_OBSERVED").alias("predicate"), "src", "dst", F.lit(1.0).alias("weight")).unionByName(
        coupling.select(F.lit("BIBLIOGRAPHIC_COUPLING").alias("predicate"), F.col("source_ut").alias("src"), F.col("target_ut").alias("dst"), F.col("cosine").alias("weight"))).unionByName(
        cocit.select(F.lit("CO_CITATION").alias("predicate"), F.col("source_ut").alias("src"), F.col("target_ut").alias("dst"), F.col("normalized_co_citation").alias("weight")))
    return runs.edge_statistics(every)


@query("""SELECT o_orderpriority AS kind, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run, count(*) AS completed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def latest_run(spark, d) -> DataFrame:
    r = T.table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("finished_at"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("RUNNING").alias("status"))
    return runs.latest(r)


@query("""WITH s AS (SELECT count(*) AS records, max(o_orderkey) AS last FROM orders WHERE o_orderstatus <> 'O'), n AS (SELECT count(*) AS records, max(o_orderkey) AS last FROM orders)
SELECT NOT (s.records = n.records AND s.last = n.last) AS stale FROM s, n""")
def run_staleness(spark, d) -> DataFrame:
    """Whether the corpus has moved on since a run that saw the orders that are not open."""
    o = T.table(spark, d, "orders")
    facts = lambda df: df.agg(F.count(F.lit(1)).alias("records"), F.max("o_orderkey").alias("last"))
    return runs.stale(facts(o.filter("o_orderstatus <> 'O'")), facts(o), ["records", "last"])


@query("""WITH r AS (SELECT o_orderstatus AS status, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT status, f AS fraction, v AS value FROM r, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS f) WHERE i = CAST(round_even((n - 1) * f, 0) AS BIGINT)""")
def price_percentiles(spark, d) -> DataFrame:
    return runs.nearest_rank(T.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), "o_totalprice"), "status", "o_totalprice", [0.5, 0.95])


@query("""WITH p AS (SELECT doc_id, length(line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id AS doc, count(*) AS pages, count(*) FILTER (WHERE n >= 200) AS fu, count(*) FILTER (WHERE n > 0 AND n < 200) AS so FROM p GROUP BY 1)
SELECT doc, pages, CASE WHEN fu + so = 0 THEN 'EMPTY' WHEN 2 * fu > pages THEN 'NORMAL' WHEN 2 * so > pages THEN 'THIN' ELSE 'MIXED' END AS status FROM c""")
def text_status(spark, d) -> DataFrame:
    pages = T.table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n", -1)).alias("line")).select("doc", F.length("line").alias("n_chars"))
    return evidence.text_status(pages)


@query("""WITH b AS (SELECT conv_id AS doc, turn AS pos, CASE WHEN role = 'user' THEN 'Correspondence to:' ELSE text END AS text FROM conversations), w AS (SELECT *, lead(text) OVER (PARTITION BY doc ORDER BY pos) AS nx FROM b)
SELECT doc, pos, 'EXPLICIT_ROLE' AS kind, length(CASE WHEN nx IS NOT NULL THEN text || ' ' || nx ELSE text END) AS n FROM w WHERE text = 'Correspondence to:'""")
def candidate_spans(spark, d) -> DataFrame:
    """Role spans of conversations whose user turns are replaced by a heading that the next turn belongs to."""
    b = T.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "Correspondence to:").otherwise(F.col("text")).alias("text"))
    return evidence.candidate_spans(b).select("doc", "pos", "kind", F.length("text").cast("long").alias("n"))


@query(r"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)
SELECT doc, pos, CASE WHEN regexp_matches(line, '(?i)\bcorresponding\s+authors?\b') THEN 'EXPLICIT_ROLE' ELSE 'CONTACT_ONLY' END AS kind, count(*) OVER (PARTITION BY doc) AS spans FROM l
WHERE regexp_matches(line, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}') OR regexp_matches(line, '(?i)\bcorresponding\s+authors?\b')""")
def document_spans(spark, d) -> DataFrame:
    """Spans of the documents' own lines: what is mailed or named there."""
    b = T.table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return evidence.candidate_spans(b).select("doc", "pos", "kind", F.count(F.lit(1)).over(Window.partitionBy("doc")).alias("spans"))


OWN_SQL = """m AS (SELECT l_orderkey AS paper, l_suppkey AS mention, 'given' || chr(97 + CAST(l_suppkey % 5 AS INTEGER)) AS given, 'family' || chr(97 + CAST(l_suppkey % 7 AS INTEGER)) AS family FROM lineitem GROUP BY 1, 2, 3, 4),
e AS (SELECT paper, CASE WHEN mention % 2 = 0 THEN given || '.' || family ELSE 'x.' || family END || '@u.org' AS email, given, family, mention FROM m)"""


@query(f"""WITH {OWN_SQL}, j AS (SELECT DISTINCT m.paper, e.email, m.mention FROM m JOIN (SELECT DISTINCT paper, email FROM e) e ON e.paper = m.paper
WHERE replace(split_part(e.email, '@', 1), '.', '') IN (m.given || m.family, m.family || m.given, left(m.given, 1) || m.family, m.family || left(m.given, 1)) OR list_contains(string_split(split_part(e.email, '@', 1), '.'), m.family))
SELECT paper, email, min(mention) AS mention FROM j GROUP BY 1, 2 HAVING count(DISTINCT mention) = 1""")
def email_owners(spark, d) -> DataFrame:
    s = F.col("l_suppkey")
    letter = lambda m: F.char((s % m + 97))
    m = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), s.alias("mention"), F.concat(F.lit("given"), letter(5)).alias("given"), F.concat(F.lit("family"), letter(7)).alias("family")).distinct()
    e = m.select("paper", F.concat(F.when(F.col("mention") % 2 == 0, F.concat("given", F.lit("."), "family")).otherwise(F.concat(F.lit("x."), F.col("family"))), F.lit("@u.org")).alias("email")).distinct()
    return evidence.email_owners(m, e)


@query("""WITH m AS (SELECT l_orderkey AS paper, l_linenumber AS position, bool_or(l_returnflag = 'R') AS role FROM lineitem GROUP BY 1, 2), s AS (SELECT DISTINCT l_orderkey AS paper, CASE WHEN l_partkey % 5 <> 0 THEN l_linenumber END AS position FROM lineitem WHERE l_returnflag = 'A'),
g AS (SELECT paper, bool_and(position IS NOT NULL) AS complete FROM s GROUP BY 1)
SELECT m.paper, m.position, CASE WHEN complete THEN s.position IS NOT NULL ELSE role OR s.position IS NOT NULL END AS role, CASE WHEN complete IS NULL THEN 'NOT_STATED' WHEN complete THEN 'REPLACED' ELSE 'ADDED' END AS how
FROM m LEFT JOIN g ON g.paper = m.paper LEFT JOIN s ON s.paper = m.paper AND s.position = m.position""")
def effective_roles(spark, d) -> DataFrame:
    lines = T.table(spark, d, "lineitem")
    m = lines.groupBy(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("position")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("role"))
    s = lines.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("paper"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_linenumber")).alias("position")).distinct()
    return evidence.effective_roles(m, s)


@query("""WITH m AS (SELECT DISTINCT l_partkey AS name, l_orderkey AS paper, l_suppkey AS mention FROM lineitem), n AS (SELECT name, paper, count(*) AS k FROM m GROUP BY 1, 2),
need AS (SELECT name, arg_max(paper, (k, -paper)) AS paper, max(k) AS needed FROM n GROUP BY 1)
SELECT m.name, mention, row_number() OVER (PARTITION BY m.name ORDER BY mention) AS seed, needed FROM m JOIN need ON need.name = m.name AND need.paper = m.paper""")
def multiplicity_seeds(spark, d) -> DataFrame:
    return evidence.multiplicity_seeds(T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("mention")))


@query("""WITH RECURSIVE m AS (SELECT s_suppkey AS l, s_suppkey + 3 AS r FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey + 3 IN (SELECT s_suppkey FROM supplier)), p AS (SELECT DISTINCT l_suppkey AS a, l_orderkey AS o FROM lineitem WHERE l_linenumber = 1),
ok AS (SELECT l, r FROM m WHERE NOT EXISTS (SELECT 1 FROM p x JOIN p y ON x.o = y.o WHERE x.a = l AND y.a = r)), w AS (SELECT l AS a, r AS b FROM ok UNION SELECT r, l FROM ok),
reach AS (SELECT s_suppkey AS author, s_suppkey AS low FROM supplier UNION SELECT w.b, reach.low FROM reach JOIN w ON w.a = reach.author WHERE reach.low < w.b) SELECT author, min(low) AS canonical FROM reach GROUP BY 1""")
def author_merges(spark, d) -> DataFrame:
    a = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("author"))
    m = a.filter("author % 4 <> 0").select(F.col("author").alias("left"), (F.col("author") + 3).alias("right")).join(a.select(F.col("author").alias("right")), "right", "left_semi")
    p = T.table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("paper")).distinct()
    return evidence.apply_merges(a, m, p)


@query("""SELECT s_suppkey AS author, CASE WHEN s_suppkey % 2 = 0 THEN '0000-000' || s_suppkey || 'X' ELSE 'r' || s_suppkey END AS value FROM supplier""")
def external_ids(spark, d) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    even = F.col("s_suppkey") % 2 == 0
    return T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("author"), evidence.external_id(F.when(even, "orcid").otherwise("other"), F.when(even, F.concat(F.lit(" https://orcid.org/0000-000"), k, F.lit("x"))).otherwise(F.concat(F.lit(" r"), k, F.lit(" ")))).alias("value"))


@query("""SELECT p_partkey AS item, CASE WHEN p_partkey % 5 = 0 THEN 'NO_PATH' WHEN p_partkey % 5 = 1 THEN 'URL' ELSE CASE p_partkey % 5 WHEN 2 THEN 'STORED' WHEN 3 THEN 'LINKED' ELSE 'ABSOLUTE' END || CASE WHEN p_size > 25 THEN '_MISSING' ELSE '' END END AS state FROM part""")
def attachment_states(spark, d) -> DataFrame:
    """States of synthetic paths; a listing of the files that exist is joined, no path is looked up by itself."""
    k = F.col("p_partkey")
    name = F.concat(k.cast("string"), F.lit(".pdf"))
    path = F.when(k % 5 == 1, F.concat(F.lit("https://x.org/"), name)).when(k % 5 == 2, F.concat(F.lit("storage:"), name)).when(k % 5 == 3, F.concat(F.lit("attachments:"), name)).when(k % 5 == 4, F.concat(F.lit("/data/"), name))
    parts = T.table(spark, d, "part")
    listing = parts.filter("p_size <= 25").select("p_partkey", F.lit(True).alias("there"))
    return parts.select("p_partkey", path.alias("path")).join(listing, "p_partkey", "left").select(k.alias("item"), evidence.attachment_state(F.col("path"), F.coalesce("there", F.lit(False))).alias("state"))


@query("""WITH f AS (SELECT l_orderkey AS item, 'line' || l_linenumber AS field, min(l_shipmode) AS value FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS l_shipmode FROM lineitem) GROUP BY 1, 2)
SELECT item, string_agg(field || '=' || value, '|' ORDER BY field) AS fields FROM f GROUP BY 1""")
def item_fields(spark, d) -> DataFrame:
    rows = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("field"), F.col("l_partkey").cast("string").alias("value"))
    return evidence.field_maps(rows).select("item", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("fields"))


@query("""WITH f AS (SELECT l_orderkey AS paper, l_suppkey AS author, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS n FROM lineitem)
SELECT author, count(*) AS mentions, count(*) FILTER (WHERE n = 1) AS first_mentions FROM f GROUP BY 1""")
def author_role_metrics(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    return T.table(spark, d, "lineitem").withColumn("n", F.row_number().over(w)).groupBy(F.col("l_suppkey").alias("author")).agg(F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("n") == 1).alias("first_mentions"))


@query("""SELECT n_name AS collection, o_orderkey AS paper, min(rank_in) AS order_index FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rank_in FROM orders)
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2 ORDER BY order_index, paper DESC, collection LIMIT 500""")
def collection_papers(spark, d) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = T.table(spark, d, "orders").withColumn("r", (F.row_number().over(w) - 1).cast("long"))
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "o_custkey").join(T.table(spark, d, "nation"), "n_nationkey").groupBy(F.col("n_name").alias("collection"), F.col("o_orderkey").alias("paper")).agg(F.min("r").alias("order_index")).orderBy("order_index", F.desc("paper"), "collection").limit(500)


@query("""WITH b AS (SELECT o_orderkey AS paper, o_orderpriority AS venue, CASE WHEN year(o_orderdate) < 1995 THEN 'early' WHEN year(o_orderdate) < 1997 THEN 'middle' ELSE 'late' END AS bucket FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket, venue ORDER BY sha256('v1:' || paper), paper) AS k FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY k, sha256('v1:' || paper), paper) AS n FROM r) SELECT bucket, venue, paper, n FROM f WHERE n <= 40""")
def diverse_sample(spark, d) -> DataFrame:
    """Forty papers a bucket of years, one of each venue before a second of any, by hash."""
    year = F.year("o_orderdate")
    h = F.sha2(F.concat(F.lit("v1:"), F.col("paper").cast("string")), 256)
    b = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), F.col("o_orderpriority").alias("venue"), F.when(year < 1995, "early").when(year < 1997, "middle").otherwise("late").alias("bucket"))
    r = b.withColumn("k", F.row_number().over(Window.partitionBy("bucket", "venue").orderBy(h, "paper")))
    return r.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("k", h, "paper")).cast("long")).filter("n <= 40").select("bucket", "venue", "paper", "n")


@query("""SELECT doc_id, concat_ws('|', CASE WHEN n_chars <> length(text) THEN 'LENGTH_MISMATCH' END, CASE WHEN lang IS NULL THEN 'NO_LANGUAGE' END, CASE WHEN length(trim(text)) = 0 THEN 'BLANK' END, CASE WHEN quality = 0 AND toxic = 1 THEN 'BOTH_LABELS' END,
CASE WHEN labels.doc_id IS NULL THEN 'UNREVIEWED' END) AS violations FROM documents LEFT JOIN labels USING (doc_id)""")
def review_contract(spark, d) -> DataFrame:
    """Rules that a reviewed document must keep, as a list of those it breaks."""
    full = T.table(spark, d, "documents").join(T.table(spark, d, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    return full.select("doc_id", F.concat_ws(
        "|", F.when(F.col("n_chars") != F.length("text"), "LENGTH_MISMATCH"), F.when(F.col("lang").isNull(), "NO_LANGUAGE"), F.when(F.length(F.trim("text")) == 0, "BLANK"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "BOTH_LABELS"), F.when(F.col("seen").isNull(), "UNREVIEWED")).alias("violations"))


@query("""WITH u AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'))
SELECT 'segment' AS facet, c_mktsegment AS value, count(*) AS n FROM u GROUP BY 2 HAVING count(*) >= 3 UNION ALL SELECT 'nation', n_name, count(*) FROM u JOIN nation ON n_nationkey = c_nationkey GROUP BY 2 HAVING count(*) >= 3""")
def residual_report(spark, d) -> DataFrame:
    """Where the unmatched records lie: counts by facet, values of at least three."""
    done = T.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    u = T.table(spark, d, "customer").join(done, "c_custkey", "left_anti").join(T.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    facets = u.select(F.explode(F.array(F.struct(F.lit("segment").alias("facet"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("nation").alias("facet"), F.col("n_name").alias("value")))).alias("f")).select("f.facet", "f.value")
    return facets.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query()
def compatible_names(spark, d) -> DataFrame:
    """Suppliers of one nation whose names can be one person's, with the number of their words."""
    s = T.table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.concat(F.lit("Ann "), F.regexp_replace("s_name", r"^.*#0*", "N"), F.lit(" Lee")).alias("name"))
    a, b = s.select("s_nationkey", F.col("s_suppkey").alias("left_id"), F.col("name").alias("a")), s.select("s_nationkey", F.col("s_suppkey").alias("right_id"), F.concat(F.lit("A. "), F.split("name", " ")[1], F.lit(" Lee")).alias("b"))
    return evidence.name_pairs(a, b, "s_nationkey").select("left_id", "right_id", F.size(F.split("a", " ")).cast("long").alias("words"))


@query(f"WITH {T.REFS_SQL} SELECT b, count(*) AS papers FROM (SELECT source_ut, CASE WHEN count(*) >= 5 THEN 'many' WHEN count(*) >= 2 THEN 'some' ELSE 'one' END AS b FROM refs GROUP BY 1) GROUP BY 1")
def reference_histogram(spark, d) -> DataFrame:
    n = T.references(spark, d).groupBy("source_ut").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.when(F.col("n") >= 5, "many").when(F.col("n") >= 2, "some").otherwise("one").alias("b")).agg(F.count(F.lit(1)).alias("papers"))


@query("""WITH m AS (SELECT DISTINCT l_partkey AS name, l_orderkey AS paper, l_orderkey * 1000000 + l_suppkey AS mention FROM lineitem), f AS (SELECT name, min(paper) AS paper FROM m GROUP BY 1)
SELECT mention, mention AS author FROM m JOIN f ON f.name = m.name AND f.paper = m.paper""")
def closure_seeds(spark, d) -> DataFrame:
    """Identities that must exist before anyone is scored: the mentions of each name on the first paper that has it."""
    m = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("paper"), F.lit(0).alias("position"), (F.col("l_orderkey") * 1000000 + F.col("l_suppkey")).alias("mention")).distinct()
    m = m.groupBy("mention", "name", "paper", "position").agg(F.lit(1).alias("one")).drop("one")
    # A supplier may stand on an order for several parts: those are mentions of their own.
    m = m.withColumn("mention", F.struct("mention", "name"))
    none = m.select("mention", F.col("mention").alias("author"), "paper", "name").limit(0)
    return evidence.closure_seeds(m, none, none.select("mention", "author")).select(F.col("mention.mention").alias("mention"), F.col("author.mention").alias("author"))


@query()
def reference_sections(spark, d) -> DataFrame:
    """Conversations as documents of pages: a heading before the last two turns, numbered lines after it."""
    c = T.table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda l, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), l)), "\n")
    pages = c.join(last, "conv_id").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("page"), F.when(F.col("turn") == F.col("last"), F.concat(F.lit("References\n"), numbered)).otherwise(F.col("text")).alias("text"))
    return evidence.reference_sections(pages).select("doc", "start_page", "heading", "method", "confidence", F.size("entries").cast("long").alias("n"))
