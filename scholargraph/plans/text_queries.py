"""Text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.functions import segment
from scholargraph.functions import text as X
from scholargraph.plans.registry import query
from scholargraph.sources import tables as T


def _lines(spark, d) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


LINES_SQL = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)"


@query(r"""SELECT doc_id, len(e) AS n_emails, array_to_string(list_sort(e), '|') AS emails FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '(?i)(?:^|[^\w.+%-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})', 1), lambda x: lower(x))) AS e FROM documents) WHERE len(e) > 0""")
def email_extract(spark, d) -> DataFrame:
    e = T.table(spark, d, "documents").select("doc_id", X.emails(F.col("text")).alias("e")).filter(F.size("e") > 0)
    return e.select("doc_id", F.size("e").cast("long").alias("n_emails"), F.array_join(F.sort_array("e"), "|").alias("emails"))


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(u, '(?i)10\.\d{4,9}/\S+')), '[.);,]+$', '') AS doi FROM (SELECT page_id, 'see https://doi.org/10.' || (1000 + page_id) || '/' || replace(url, ' ', '') || '),' AS u FROM pages)""")
def doi_extract(spark, d) -> DataFrame:
    u = F.concat(F.lit("see https://doi.org/10."), (F.col("page_id") + 1000).cast("string"), F.lit("/"), F.replace("url", F.lit(" "), F.lit("")), F.lit("),"))
    return T.table(spark, d, "pages").select("page_id", X.doi(u).alias("doi"))


@query(rf"""WITH {LINES_SQL}, m AS (SELECT doc_id, pos, line, CASE pos % 4 WHEN 0 THEN 'Correspondence to: ' || line WHEN 1 THEN line || ' corresponding author' WHEN 2 THEN 'E-mail: ' || line ELSE line END AS t FROM lines),
k AS (SELECT doc_id, pos, CASE WHEN trim(regexp_replace(t, '\s+', ' ', 'g')) = '' THEN 'NONE' WHEN regexp_matches(t, '(?i)\bpublisher\b') THEN 'NOISE' WHEN pos % 4 IN (0, 1) THEN 'EXPLICIT_ROLE'
 WHEN pos % 4 = 2 OR regexp_matches(t, '(?i)(^|[^\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}') THEN 'CONTACT_ONLY' ELSE 'NONE' END AS kind FROM m)
SELECT doc_id, kind, count(*) AS n FROM k GROUP BY 1, 2""")
def role_classify(spark, d) -> DataFrame:
    p = F.col("pos") % 4
    t = F.when(p == 0, F.concat(F.lit("Correspondence to: "), "line")).when(p == 1, F.concat("line", F.lit(" corresponding author"))).when(p == 2, F.concat(F.lit("E-mail: "), "line")).otherwise(F.col("line"))
    return _lines(spark, d).select("doc_id", X.role_kind(t)["kind"].alias("kind")).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
WORDS_SQL = rf"w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(split_part(text, chr(10), 1), '[A-Za-z][A-Za-z0-9+-]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN {STOP_SQL}) AS ws FROM documents WHERE text IS NOT NULL)"


def _title_words(spark, d) -> DataFrame:
    return T.table(spark, d, "documents").filter("text is not null").select("doc_id", X.title_words(F.split("text", "\n")[0]).alias("ws"))


@query(f"WITH {WORDS_SQL} SELECT term, count(*) AS documents FROM (SELECT unnest(list_distinct(ws)) AS term FROM w) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def title_terms(spark, d) -> DataFrame:
    return _title_words(spark, d).select(F.explode(F.array_distinct("ws")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "term").limit(200)


@query(f"WITH {WORDS_SQL} SELECT pair, count(*) AS documents FROM (SELECT unnest(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS pair FROM w) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def title_bigrams(spark, d) -> DataFrame:
    return _title_words(spark, d).select(F.explode(F.array_distinct(X.adjacent_pairs(F.col("ws")))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "pair").limit(200)


@query(r"""WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(split_part(text, chr(10), 1)), '[\x20\x09-\x0D]+'), lambda w: length(w) > 1)) AS a,
 list_distinct(list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: length(w) > 1)) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END, 4) AS own, CAST(len(a) AS BIGINT) AS title_tokens, CAST(len(b) AS BIGINT) AS text_tokens FROM t""")
def title_coverage(spark, d) -> DataFrame:
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 1))
    t = T.table(spark, d, "documents").filter("text is not null").select("doc_id", words(F.split("text", "\n")[0]).alias("a"), words(F.col("text")).alias("b"))
    return t.select("doc_id", F.round(X.coverage(F.col("a"), F.col("b")), 4).alias("own"), F.size("a").cast("long").alias("title_tokens"), F.size("b").cast("long").alias("text_tokens"))


@query(r"""SELECT s_suppkey AS ut, agency, grants FROM (SELECT s_suppkey, 'Fund' || (s_suppkey % 5) AS agency, 'g' || s_suppkey || '|' || 'h' || s_nationkey AS grants FROM supplier UNION ALL SELECT s_suppkey, 'Trust', '' FROM supplier)""")
def funding_items(spark, d) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    fu = F.concat(F.lit("Fund"), (F.col("s_suppkey") % 5).cast("string"), F.lit(" [g"), k, F.lit(", h"), F.col("s_nationkey").cast("string"), F.lit("]; Trust"))
    return T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ut"), F.explode(X.funding_items(fu)).alias("i")).select("ut", F.col("i.agency").alias("agency"), F.array_join("i.grants", "|").alias("grants"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(replace(lower(strip_accents(split_part(text, chr(10), 1))), 'ß', 'ss'), 'ẞ', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents WHERE text IS NOT NULL""")
def norm_title(spark, d) -> DataFrame:
    return T.table(spark, d, "documents").filter("text is not null").select("doc_id", X.fold_alnum(F.split("text", "\n")[0]).alias("norm"))


@query(r"""SELECT l_orderkey AS source_ut, l_linenumber AS order_index, 'Supplier ' || l_suppkey AS author, CAST(year(l_shipdate) AS INTEGER) AS year, 'J PART ' || (l_partkey % 9) AS source, CAST(l_partkey % 90 AS VARCHAR) AS volume, CAST(l_suppkey AS VARCHAR) AS page,
CASE WHEN l_partkey % 2 = 0 THEN '10.1234/p' || l_partkey END AS doi FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate FROM lineitem)""")
def cited_references(spark, d) -> DataFrame:
    """Parses reference lines of the usual form: author, year, source, V volume, P page, DOI."""
    s = lambda c: F.col(c).cast("string")
    lines = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate").distinct()
    raw = F.concat(F.lit("Supplier "), s("l_suppkey"), F.lit(", "), F.year("l_shipdate").cast("string"), F.lit(", J PART "), (F.col("l_partkey") % 9).cast("string"), F.lit(", V"), (F.col("l_partkey") % 90).cast("string"),
                   F.lit(", P"), s("l_suppkey"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(", DOI 10.1234/P"), s("l_partkey"), F.lit("."))).otherwise(""))
    return lines.select(F.col("l_orderkey").alias("source_ut"), F.col("l_linenumber").alias("order_index"), X.cited_reference(raw).alias("r")).select("source_ut", "order_index", "r.*")


@query()
def reference_segments(spark, d) -> DataFrame:
    """Segments numbered lists made of each document's lines: style and number of entries by document."""
    lines = _lines(spark, d).filter(F.trim("line") != "").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["line"])), "\n").alias("t"))
    return lines.select("doc_id", segment.segment_references("t").alias("s")).select("doc_id", F.size("s.entries").cast("long").alias("entries"), "s.method", "s.confidence")


@query(r"""SELECT DISTINCT doc_id, lower(m) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}')) AS m FROM documents WHERE text IS NOT NULL)""")
def document_emails(spark, d) -> DataFrame:
    """The e-mail addresses of the documents' own texts."""
    return T.table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(X.emails(F.col("text"))).alias("email"))


@query(r"""SELECT DISTINCT page_id, lower(m) AS link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href="([^"]*)"', 1)) AS m FROM pages WHERE html IS NOT NULL) WHERE m <> ''""")
def page_links(spark, d) -> DataFrame:
    """What the pages link to."""
    found = F.regexp_extract_all(F.col("html"), F.lit('(?i)href="([^"]*)"'), 1)
    return T.table(spark, d, "pages").filter("html is not null").select("page_id", F.explode(F.array_distinct(F.transform(F.filter(found, lambda x: x != ""), lambda x: F.lower(x)))).alias("link"))
