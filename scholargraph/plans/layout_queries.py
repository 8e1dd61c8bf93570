"""Layout diagnostics on the lines of the documents' own texts, as blocks of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.operators import layout
from scholargraph.plans.registry import query
from scholargraph.sources import tables as T

# Twelve lines are a page; a line's size follows from its length. Some lines are turned into notes and markers.
BLOCKS_SQL = r"""ln AS (SELECT doc_id AS doc, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
b AS (SELECT doc, i // 12 AS page, i % 12 AS block, CASE WHEN i % 9 = 4 THEN 'Correspondence to: ' || raw WHEN i % 9 = 5 THEN 'corresponding  author ' || raw WHEN i % 9 = 6 THEN 'E-mail: a' || doc || '@x' || i || '.org.' WHEN i % 9 = 7 THEN '†' || i ELSE raw END AS t, 6.0 + length(raw) % 7 AS size FROM ln WHERE i < 24),
c AS (SELECT doc, page, block, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, size FROM b)"""


def blocks(spark, d) -> DataFrame:
    lines = T.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "raw"))
    i, raw = F.col("i"), F.col("raw")
    kind = i % 9
    text = (
        F.when(kind == 4, F.concat(F.lit("Correspondence to: "), raw)).when(kind == 5, F.concat(F.lit("corresponding  author "), raw))
        .when(kind == 6, F.concat(F.lit("E-mail: a"), F.col("doc").cast("string"), F.lit("@x"), i.cast("string"), F.lit(".org."))).when(kind == 7, F.concat(F.lit("†"), i.cast("string"))).otherwise(raw))
    return lines.select("doc", F.expr("CAST(i div 12 AS BIGINT)").alias("page"), (i % 12).alias("pos"), text.alias("text"), (6.0 + F.length(raw) % 7).alias("size"))


@query(rf"""WITH {BLOCKS_SQL}, f AS (SELECT *, list_transform(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}'), lambda e: rtrim(lower(e), '.,;:)]}}>"')) AS e,
 regexp_matches(text, '(?i)\b(?:corresponding\s+authors?|correspondence\s+(?:should|may|to|addressed)|to\s+whom\s+correspondence)\b') AS x, regexp_matches(text, '(?i)\bcorrespond(?:ing|ence)\b') AS w,
 regexp_matches(text, '(?i)\belectronic\s+(?:mail|address)\b') AS a, regexp_matches(text, '(?i)\be-?mail\s*[:.]') AS l FROM c)
SELECT doc, page, block, text, array_to_string(e, '|') AS emails, x AS explicit_correspondence, w AS correspondence_word, a AS electronic_address, l AS email_label,
 (SELECT string_agg(n.block || ':' || n.text, '|' ORDER BY n.block) FROM c n WHERE n.doc = f.doc AND n.page = f.page AND abs(n.block - f.block) <= 2) AS context FROM f WHERE len(e) > 0 OR w OR a OR l""")
def indicator_blocks(spark, d) -> DataFrame:
    context = F.array_join(F.transform("context", lambda c: F.concat(c["block"].cast("string"), F.lit(":"), c["text"])), "|")
    return layout.indicator_blocks(blocks(spark, d)).withColumn("emails", F.array_join("emails", "|")).withColumn("context", context)


SPANS_SQL = BLOCKS_SQL + r""", m AS (SELECT doc, page, median(size) AS median FROM c WHERE text <> '' AND size > 0 GROUP BY 1, 2),
s AS (SELECT c.doc, c.page, c.block, text, size, median, round(size / median, 3) AS relative_size, text <> '' AND regexp_matches(text, '(?i)^(?:[\s*†‡§¶#]+|[*†‡§¶#]+\d*|\d+[a-z]?)$') AS marker_like FROM c LEFT JOIN m ON m.doc = c.doc AND m.page = c.page),
z AS (SELECT *, page = 0 AND text <> '' AND (marker_like OR coalesce(relative_size <= 0.72 AND length(text) <= 8, FALSE)) AS small FROM s)"""


@query(f"WITH {SPANS_SQL} SELECT doc, page, block, sha256(text) AS text_hash, CAST(size AS DOUBLE) AS size, CAST(median AS DOUBLE) AS median, CAST(relative_size AS DOUBLE) AS relative_size, marker_like, small FROM z")
def sized_spans(spark, d) -> DataFrame:
    return layout.sized_spans(blocks(spark, d)).select("doc", "page", "block", F.sha2("text", 256).alias("text_hash"), *[F.col(c).cast("double").alias(c) for c in ("size", "median", "relative_size")], "marker_like", "small")


@query(rf"""WITH {SPANS_SQL}, g AS (SELECT doc, bool_or(regexp_matches(text, '(?i)\b(?:corresponding\s+authors?|correspondence\s+(?:should|may|to|addressed)|to\s+whom\s+correspondence)\b')) AS x, bool_or(regexp_matches(text, '(?i)\bcorrespond(?:ing|ence)\b')) AS w,
 bool_or(regexp_matches(text, '(?i)\belectronic\s+(?:mail|address)\b')) AS a, bool_or(regexp_matches(text, '(?i)\be-?mail\s*[:.]')) AS l, bool_or(regexp_matches(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}')) AS e, bool_or(small) AS s FROM z GROUP BY 1)
SELECT doc, concat_ws('|', CASE WHEN x THEN 'EXPLICIT_CORRESPONDENCE' END, CASE WHEN w AND NOT x THEN 'CORRESPONDENCE_WORD_ONLY' END, CASE WHEN a THEN 'ELECTRONIC_ADDRESS' END, CASE WHEN l THEN 'EMAIL_LABEL' END, CASE WHEN e THEN 'HAS_EMAIL' END,
 CASE WHEN e AND NOT w THEN 'EMAIL_WITHOUT_CORRESPONDENCE_WORD' END, CASE WHEN s THEN 'FIRST_PAGE_SMALL_OR_MARKER_SPANS' END) AS signals FROM g""")
def layout_signals(spark, d) -> DataFrame:
    b = blocks(spark, d)
    return layout.signals(layout.indicator_blocks(b), layout.sized_spans(b)).select("doc", F.array_join("signals", "|").alias("signals"))
