"""Audits of documents as papers, and single look-ups, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.functions import text as X
from scholargraph.operators import attempts, audit, decisions, linking, listing, scan
from scholargraph.operators import canonical as C
from scholargraph.plans.registry import query
from scholargraph.sources import tables as T

# The documents are papers: the first line is the title, the first 400 characters the front matter.
AUDIT_SQL = r"""pp AS (SELECT doc_id AS paper, split_part(coalesce(text, ''), chr(10), 1) AS title, CASE WHEN doc_id % 3 = 0 THEN '10.1000/d' || doc_id END AS doi, text, source, n_chars, lang FROM documents),
dd AS (SELECT paper, paper * 2 AS document, CASE WHEN paper % 11 = 0 THEN 'SUPPLEMENTARY' ELSE 'PRIMARY_ARTICLE' END AS role, 0.6 AS confidence FROM pp WHERE paper % 13 <> 0 UNION ALL SELECT paper, paper * 2 + 1, 'PRIMARY_ARTICLE', 0.5 FROM pp WHERE paper % 5 = 0 AND paper % 13 <> 0),
ch AS (SELECT *, count(*) FILTER (WHERE role = 'PRIMARY_ARTICLE') OVER (PARTITION BY paper) AS primaries, row_number() OVER (PARTITION BY paper ORDER BY CASE role WHEN 'PRIMARY_ARTICLE' THEN 0 ELSE 2 END, confidence DESC, document) AS k FROM dd),
tx AS (SELECT ch.*, CASE WHEN ch.paper % 17 <> 0 THEN left(coalesce(text, ''), CASE WHEN ch.paper % 4 = 0 THEN 60 ELSE 400 END) || CASE ch.paper % 6 WHEN 0 THEN ' doi 10.1000/d' || ch.paper WHEN 3 THEN ' doi 10.1000/x' ELSE '' END END AS front, n_chars // 800 AS pages, CASE WHEN ch.paper % 17 = 0 THEN 'broken' END AS error, lang = 'en' AS has_references FROM ch JOIN pp ON pp.paper = ch.paper WHERE k = 1),
mn AS (SELECT paper, paper * 4 + i AS mention, CASE i WHEN 0 THEN left(title, 4) WHEN 1 THEN 'Zq' || paper ELSE 'x' END AS family FROM pp, (SELECT unnest([0, 1, 2]) AS i) WHERE i <= paper % 3),
ex AS (SELECT paper, title, doi, document, role, coalesce(primaries, 0) AS primaries, front, coalesce(pages, 0) AS pages, error, coalesce(has_references, FALSE) AS refs, CASE WHEN document IS NOT NULL AND paper % 2 = 0 THEN 1 ELSE 0 END AS roles,
 CASE WHEN document IS NOT NULL AND paper % 4 = 0 THEN 2 ELSE 0 END AS emails, CASE WHEN document IS NOT NULL AND paper % 3 = 1 THEN 1 ELSE 0 END AS contacts, CASE WHEN document IS NOT NULL AND paper % 5 = 1 THEN 1 ELSE 0 END AS markers, CASE WHEN paper % 8 < 4 THEN 1 ELSE 0 END AS mapped,
 (SELECT count(*) FROM mn WHERE mn.paper = pp.paper) AS authors, (SELECT count(*) FILTER (WHERE contains(lower(coalesce(tx.front, '')), lower(family))) / count(*) FROM mn WHERE mn.paper = pp.paper AND length(family) >= 2) AS cov
 FROM pp LEFT JOIN tx USING (paper)),
tk AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(title), '[\pL\pN\pM_]+'), lambda w: length(w) > 1)) AS tt, list_distinct(list_filter(regexp_extract_all(lower(coalesce(front, '')), '[\pL\pN\pM_]+'), lambda w: length(w) > 1)) AS ft, lower(coalesce(front, '')) AS low FROM ex),
ov AS (SELECT *, CASE WHEN document IS NOT NULL AND len(tt) > 0 THEN len(list_intersect(tt, ft)) / len(tt) END AS overlap, CASE WHEN document IS NOT NULL THEN cov END AS coverage, error IS NULL AND document IS NOT NULL AS ok, list_transform(regexp_extract_all(low, '10\.\d{4,9}/\S+'), lambda d: rtrim(d, '.,;:)]}>"')) AS dois FROM tk),
fl AS (SELECT *, list_filter([CASE WHEN markers > 0 AND roles = 0 AND ok THEN 'AUTHOR_MARKER_WITHOUT_ROLE_SIGNAL' END, CASE WHEN contacts > 0 AND roles = 0 AND ok THEN 'CONTACT_WITHOUT_ROLE_SIGNAL' END,
 CASE WHEN ok AND doi IS NOT NULL AND len(dois) > 0 AND NOT list_contains(dois, doi) THEN 'FRONT_MATTER_DOI_CONFLICT' END, CASE WHEN ok AND coverage < 0.5 AND authors >= 2 THEN 'LOW_SOURCE_AUTHOR_HEADER_COVERAGE' END,
 CASE WHEN ok AND overlap < 0.2 AND length(trim(title, ' ')) >= 20 THEN 'LOW_TITLE_FRONT_MATTER_OVERLAP' END, CASE WHEN primaries > 1 THEN 'MULTIPLE_PRIMARY_CANDIDATES' END, CASE WHEN document IS NULL THEN 'NO_AVAILABLE_PRIMARY_PDF' END,
 CASE WHEN ok AND NOT refs AND pages >= 4 THEN 'NO_REFERENCE_SECTION' END, CASE WHEN ok AND length(trim(coalesce(front, ''), ' ')) < 80 THEN 'NO_USABLE_FRONT_MATTER_TEXT' END, CASE WHEN document IS NOT NULL AND error IS NOT NULL THEN 'PDF_PARSE_ERROR' END,
 CASE WHEN ok AND emails > 0 AND mapped < emails THEN 'ROLE_EMAIL_AUTHOR_COUNT_MISMATCH' END, CASE WHEN ok AND roles > 0 AND mapped = 0 THEN 'ROLE_SIGNAL_UNMAPPED_TO_SOURCE_AUTHOR' END, CASE WHEN ok AND roles > 0 AND emails = 0 THEN 'ROLE_SIGNAL_WITHOUT_EMAIL' END,
 CASE WHEN role = 'SUPPLEMENTARY' THEN 'SELECTED_SUPPLEMENTARY_DOCUMENT' END], lambda f: f IS NOT NULL) AS flags FROM ov),
wt AS (SELECT unnest(['NO_AVAILABLE_PRIMARY_PDF', 'SELECTED_SUPPLEMENTARY_DOCUMENT', 'PDF_PARSE_ERROR', 'FRONT_MATTER_DOI_CONFLICT', 'ROLE_SIGNAL_UNMAPPED_TO_SOURCE_AUTHOR', 'NO_USABLE_FRONT_MATTER_TEXT', 'MULTIPLE_PRIMARY_CANDIDATES', 'LOW_SOURCE_AUTHOR_HEADER_COVERAGE', 'LOW_TITLE_FRONT_MATTER_OVERLAP', 'ROLE_EMAIL_AUTHOR_COUNT_MISMATCH', 'AUTHOR_MARKER_WITHOUT_ROLE_SIGNAL', 'ROLE_SIGNAL_WITHOUT_EMAIL', 'CONTACT_WITHOUT_ROLE_SIGNAL', 'NO_REFERENCE_SECTION']) AS f,
 unnest([100, 100, 100, 95, 90, 85, 70, 65, 60, 55, 45, 35, 20, 10]) AS w),
rk AS (SELECT *, least(100, coalesce((SELECT sum(w) FROM wt WHERE list_contains(flags, f)), 0)) AS risk FROM fl),
au AS (SELECT *, CASE WHEN risk >= 85 THEN 'P0' WHEN risk >= 60 THEN 'P1' WHEN risk >= 30 THEN 'P2' ELSE 'P3' END AS severity FROM rk)"""


def _audited(spark, d) -> DataFrame:
    docs = T.table(spark, d, "documents").withColumn("paper", F.col("doc_id"))
    p, text = F.col("paper"), F.coalesce("text", F.lit(""))
    papers = docs.select("paper", F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), F.when(p % 3 == 0, F.concat(F.lit("10.1000/d"), p.cast("string"))).alias("doi"))
    main = docs.filter(p % 13 != 0).select("paper", (p * 2).alias("document"), F.when(p % 11 == 0, "SUPPLEMENTARY").otherwise("PRIMARY_ARTICLE").alias("role"), F.lit(0.6).alias("confidence"))
    other = docs.filter((p % 5 == 0) & (p % 13 != 0)).select("paper", (p * 2 + 1).alias("document"), F.lit("PRIMARY_ARTICLE").alias("role"), F.lit(0.5).alias("confidence"))
    documents = main.unionByName(other)
    note = F.when(p % 6 == 0, F.concat(F.lit(" doi 10.1000/d"), p.cast("string"))).when(p % 6 == 3, " doi 10.1000/x").otherwise("")
    front = F.when(p % 17 != 0, F.concat(F.left(text, F.when(p % 4 == 0, 60).otherwise(400)), note))
    read = docs.select("paper", F.expr("n_chars div 800").alias("pages"), F.when(p % 17 == 0, "broken").alias("error"), front.alias("front"), (F.col("lang") == "en").alias("has_references"))
    texts = documents.select("paper", "document").join(read, "paper").drop("paper")
    kinds = F.array_compact(F.array(
        F.when(p % 2 == 0, F.struct(F.lit("ROLE").alias("kind"), F.when(p % 4 == 0, "Corresponding authors: a@b.org and c@d.org").otherwise("Corresponding author").alias("text"))),
        F.when(p % 3 == 1, F.struct(F.lit("CONTACT").alias("kind"), F.lit("e@f.org").alias("text"))), F.when(p % 5 == 1, F.struct(F.lit("MARKER").alias("kind"), F.lit("*").alias("text")))))
    spans = documents.select("document", F.explode(kinds).alias("s")).select("document", "s.kind", "s.text")
    i = F.col("i")
    mentions = papers.select("paper", "title", F.explode(F.array(*[F.lit(x) for x in range(3)])).alias("i")).filter(i <= p % 3).select(
        "paper", F.when(i == 0, F.left("title", F.lit(4))).when(i == 1, F.concat(F.lit("Zq"), p.cast("string"))).otherwise("x").alias("family"))
    mapped = papers.filter(p % 8 < 4).select("paper", (p * 4).alias("mention"))
    return audit.audit(audit.wide_rows(papers, mentions, documents, texts, spans, mapped))


@query(f"WITH {AUDIT_SQL} SELECT paper, document, role, round(overlap, 6) AS title_overlap, round(coverage, 6) AS author_coverage, authors, mapped, roles, contacts, markers, emails AS role_emails, array_to_string(flags, '|') AS flags, CAST(risk AS INTEGER) AS risk, severity, document IS NOT NULL AS requires_review FROM au")
def paper_audit(spark, d) -> DataFrame:
    return _audited(spark, d).withColumns({"flags": F.array_join(F.array_sort("flags"), "|"), "title_overlap": F.round("title_overlap", 6), "author_coverage": F.round("author_coverage", 6)})


@query(f"WITH {AUDIT_SQL} SELECT 'severity' AS counter, severity AS value, count(*) AS n FROM au GROUP BY 2 UNION ALL SELECT 'flag', f, count(*) FROM (SELECT unnest(flags) AS f FROM au) GROUP BY 2")
def audit_histogram(spark, d) -> DataFrame:
    return audit.severity_histogram(_audited(spark, d))


@query(f"WITH {AUDIT_SQL} SELECT paper, CAST(risk AS INTEGER) AS risk, severity FROM au ORDER BY risk DESC, paper LIMIT 50")
def audit_queue(spark, d) -> DataFrame:
    return audit.queue(_audited(spark, d), 50).select("paper", "risk", "severity")


@query(f"WITH {AUDIT_SQL} SELECT paper, document, role FROM au WHERE document IS NOT NULL")
def blind_queue(spark, d) -> DataFrame:
    return audit.blind(_audited(spark, d))


# Look-ups: lines as mentions of suppliers (authors) on orders (papers).
def _mentions(spark, d) -> DataFrame:
    return T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("i")).agg(F.min("l_suppkey").alias("author"), F.min("l_partkey").alias("creator")).withColumn("mention", F.col("paper") * 10 + F.col("i"))


MENTIONS_SQL = "m AS (SELECT l_orderkey AS paper, l_linenumber AS i, min(l_suppkey) AS author, min(l_partkey) AS creator, l_orderkey * 10 + l_linenumber AS mention FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query(f"""WITH {MENTIONS_SQL}, w AS (SELECT mention, paper, author % 40 + 1 AS author FROM m WHERE i > 1), t AS (SELECT mention, paper, author % 40 + 1 AS author FROM m WHERE i = 1)
SELECT w.mention, w.author, NOT EXISTS (SELECT 1 FROM t WHERE t.paper = w.paper AND t.author = w.author AND t.mention <> w.mention) AS allowed FROM w""")
def guarded_links(spark, d) -> DataFrame:
    m = _mentions(spark, d)
    group = (F.col("author") % 40 + 1).alias("author")
    return decisions.link_guard(m.filter("i > 1").select("mention", group), m.filter("i = 1").select("mention", group), m.select("mention", "paper"))


@query(f"""WITH {MENTIONS_SQL} SELECT author, array_to_string(list_sort(list_distinct(list(creator))), ',') AS creators, min(mention) AS stable_key, array_to_string(list_sort(list_distinct(list('n' || creator % 7))), ',') AS names FROM m GROUP BY 1""")
def author_anchors(spark, d) -> DataFrame:
    m = _mentions(spark, d)
    named = m.select("mention", "creator", F.concat(F.lit("n"), (F.col("creator") % 7).cast("string")).alias("name"))
    out = decisions.anchors(m.select("mention", "author"), named)
    return out.select("author", F.array_join(F.transform("creators", lambda c: c.cast("string")), ",").alias("creators"), "stable_key", F.array_join("names", ",").alias("names"))


@query(f"WITH {MENTIONS_SQL} SELECT 'n' || creator % 500 AS name, array_to_string(list_sort(list_distinct(list(author))), ',') AS authors FROM m GROUP BY 1")
def name_holders(spark, d) -> DataFrame:
    m = _mentions(spark, d)
    out = decisions.authors_of_name(m.select("mention", "author"), m.select("mention", F.concat(F.lit("n"), (F.col("creator") % 500).cast("string")).alias("name")))
    return out.select("name", F.array_join(F.transform("authors", lambda a: a.cast("string")), ",").alias("authors"))


@query(f"WITH {MENTIONS_SQL} SELECT paper, mention, author FROM m WHERE i % 2 = 1")
def authorships_in_force(spark, d) -> DataFrame:
    m = _mentions(spark, d)
    return decisions.active_authorships(m.select("mention", "author", F.when(F.col("i") % 2 == 1, "ACCEPTED").otherwise("SUPERSEDED").alias("status")), m)


@query(f"""WITH {MENTIONS_SQL} SELECT paper, mention, kind, status, span FROM (SELECT *, CASE i % 3 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'CANDIDATE' ELSE 'REJECTED' END AS status, 'K' || creator % 3 AS kind, mention * 2 AS span FROM m WHERE author = 7) WHERE status <> 'REJECTED' ORDER BY paper, mention, kind, span LIMIT 200""")
def evidence_of_author(spark, d) -> DataFrame:
    m = _mentions(spark, d)
    i = F.col("i") % 3
    rows = m.select("mention", F.concat(F.lit("K"), (F.col("creator") % 3).cast("string")).alias("kind"), F.when(i == 0, "ACCEPTED").when(i == 1, "CANDIDATE").otherwise("REJECTED").alias("status"), (F.col("mention") * 2).alias("span"))
    return linking.author_evidence(7, m.select("mention", "author", "paper"), rows, 200)


@query("SELECT l_partkey AS k, l_suppkey AS s, arg_max(l_shipmode, (l_shipdate, l_shipmode)) AS mode FROM (SELECT l_partkey, l_suppkey, l_returnflag AS l_shipmode, l_shipdate FROM lineitem) GROUP BY 1, 2")
def last_written(spark, d) -> DataFrame:
    return linking.last_writer(T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), "l_shipdate", F.col("l_returnflag").alias("mode")), ["k", "s"], "l_shipdate", "mode")


@query("""SELECT o_custkey AS paper, first(o_orderkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END, o_orderkey) AS document, first(o_orderstatus = 'O' ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END, o_orderkey) AS available FROM orders GROUP BY 1""")
def pdf_states(spark, d) -> DataFrame:
    s = F.col("o_orderstatus")
    return listing.pdf_state(T.table(spark, d, "orders").select(F.col("o_custkey").alias("paper"), F.col("o_orderkey").alias("document"), (s == "P").alias("selected"), (s == "O").alias("available")))


@query("SELECT p_partkey AS ut, '10.1/p' || p_partkey AS doi, lower(p_name) AS normalized_title, p_size AS year FROM part WHERE '10.1/p' || p_partkey = '10.1/p77' OR lower(p_name) = (SELECT lower(p_name) FROM part WHERE p_partkey = 5)")
def looked_up(spark, d) -> DataFrame:
    """Records of one DOI, and of one exact title."""
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("ut"), F.concat(F.lit("10.1/p"), F.col("p_partkey").cast("string")).alias("doi"), F.lower("p_name").alias("normalized_title"), F.col("p_size").alias("year"))
    title = p.filter("ut = 5").first()["normalized_title"]
    return listing.find_by_doi(p, " 10.1/P77 ").unionByName(listing.find_by_title(p, title)).distinct()


@query("""WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS predicate, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2, 3)
SELECT src, dst, predicate, weight FROM e WHERE predicate = 'A' ORDER BY weight DESC, src, dst LIMIT 300""")
def edges_of_predicate(spark, d) -> DataFrame:
    e = T.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("predicate")).agg(F.max("l_quantity").alias("weight"))
    return listing.edges_by_predicate(e, "A", 300)


@query("""SELECT 'run' || p_size % 3 AS run, p_partkey AS "key", CASE WHEN p_size > 20 THEN 'PAPER' ELSE 'YEAR' END AS node_type FROM part WHERE p_size % 3 = (SELECT p_size % 3 FROM part WHERE p_partkey = 9) AND p_partkey = 9""")
def node_of_run(spark, d) -> DataFrame:
    n = T.table(spark, d, "part").select(F.concat(F.lit("run"), (F.col("p_size") % 3).cast("string")).alias("run"), F.col("p_partkey").alias("key"), F.when(F.col("p_size") > 20, "PAPER").otherwise("YEAR").alias("node_type"))
    r = n.filter("key = 9").first()
    return listing.node(n, r["run"], 9, r["node_type"])


@query("""SELECT 'paper' AS kind, p_partkey AS id FROM (SELECT * FROM part WHERE contains(lower(p_name), '00004') OR contains(lower('10.1/P' || p_partkey), '00004') OR contains(lower(p_brand), '00004') ORDER BY p_size + 1970 DESC NULLS LAST, p_partkey DESC LIMIT 20)
UNION ALL SELECT 'author', s_suppkey FROM (SELECT * FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE contains(lower(s_name), '00004') OR contains(lower(n_name), '00004') ORDER BY lower(s_name), s_suppkey LIMIT 20)""")
def combined_search(spark, d) -> DataFrame:
    """Papers and authors that fit one query."""
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("ut"), F.col("p_name").alias("title"), F.concat(F.lit("10.1/P"), F.col("p_partkey").cast("string")).alias("doi"), F.col("p_brand").alias("venue"), (F.col("p_size") + 1970).cast("long").alias("year"))
    s, lines = T.table(spark, d, "supplier"), T.table(spark, d, "lineitem")
    spelled = s.join(T.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("author"), F.col("n_name").alias("spelling"))
    roles = lines.select(F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("paper"), (F.col("l_linenumber") == 1).alias("first"))
    found = listing.search("00004", p, lines.select(F.col("l_partkey").alias("ut")), s.select(F.col("s_suppkey").alias("author"), F.col("s_name").alias("name")), spelled, roles)
    return found["papers"].select(F.lit("paper").alias("kind"), F.col("ut").alias("id")).unionByName(found["authors"].select(F.lit("author").alias("kind"), F.col("author").alias("id")))


@query("""SELECT o_orderkey AS section, CASE WHEN o_orderstatus = 'F' THEN 'HIGH' ELSE o_orderpriority END AS section_confidence, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS segmentation_confidence, 'UNREVIEWED' AS entry_text_quality FROM orders""")
def section_quality(spark, d) -> DataFrame:
    o = T.table(spark, d, "orders")
    return attempts.reference_quality(o.select(F.col("o_orderkey").alias("section"), F.when(F.col("o_orderstatus") == "F", "References").alias("heading"), F.col("o_orderpriority").alias("confidence"), (F.col("o_orderkey") % 4).alias("entries")))


@query("""WITH s AS (SELECT doc_id, lang AS h FROM documents WHERE source <> 'src3'), n AS (SELECT doc_id, source AS h FROM documents WHERE source <> 'src7')
SELECT 1 AS library_id, coalesce(n.doc_id, s.doc_id) AS item_key, coalesce(n.h, s.h) AS bibliographic_hash, 'o' AS organization_hash, 'a' AS attachment_hash, coalesce(n.h, s.h) AS canonical_hash, n.doc_id IS NOT NULL AS present FROM s FULL JOIN n ON n.doc_id = s.doc_id""")
def state_after_scan(spark, d) -> DataFrame:
    docs = T.table(spark, d, "documents")
    rows = lambda df, h: df.select(F.lit(1).alias("library_id"), F.col("doc_id").alias("item_key"), F.col(h).alias("bibliographic_hash"), F.lit("o").alias("organization_hash"), F.lit("a").alias("attachment_hash"), F.col(h).alias("canonical_hash"))
    state = rows(docs.filter("source <> 'src3'"), "lang").withColumn("present", F.lit(True))
    now = rows(docs.filter("source <> 'src7'"), "source")
    return scan.next_state(state, now)


@query(r"""SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(coalesce(text, ''), '\d+')), '') <> '' AS has_numbers, CAST(len(list_distinct(regexp_extract_all(coalesce(text, ''), '\d+'))) AS INTEGER) AS numbers, nullif(regexp_extract(text, '^\s*([*†‡§¶#✉]+|[a-zA-Z]\)|\([a-zA-Z]\)|\d+\))\s*', 1), '') AS marker,
TRY_CAST(trim(regexp_extract(text, '\d{1,4}'), ' ') AS INTEGER) AS first_int, CASE WHEN doc_id % 3 = 0 THEN 'rec:W' || doc_id WHEN doc_id % 3 = 1 THEN 'doi:10.1/a' || doc_id ELSE 'raw:' || sha1(coalesce(text, '')) END AS reference_key FROM documents""")
def text_scalars(spark, d) -> DataFrame:
    """Number tokens, leading marker, safe integer and reference key of every document's text."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    numbers = C.number_tokens(F.col("text"))
    key = X.reference_key(F.when(k % 3 == 0, F.concat(F.lit("W"), k.cast("string"))), F.when(k % 3 == 1, F.concat(F.lit("10.1/A"), k.cast("string"))), text)
    return T.table(spark, d, "documents").select(
        "doc_id", (F.size(numbers) > 0).alias("has_numbers"), F.size(numbers).alias("numbers"), X.leading_marker(F.col("text")).alias("marker"), X.safe_int(F.regexp_extract("text", r"\d{1,4}", 0)).alias("first_int"), key.alias("reference_key"))
