"""Layout of text blocks: what speaks of correspondence, what stands around it, and which spans are small for their page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What a block says of correspondence, what a marker is, and when a span counts as small.
SAYS = {
    "explicit_correspondence": r"(?i)\b(?:corresponding\s+authors?|correspondence\s+(?:should|may|to|addressed)|to\s+whom\s+correspondence)\b",
    "correspondence_word": r"(?i)\bcorrespond(?:ing|ence)\b", "electronic_address": r"(?i)\belectronic\s+(?:mail|address)\b", "email_label": r"(?i)\be-?mail\s*[:.]",
}
ADDRESS = r"(?i)([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})"
ADDRESS_TAIL = r"[.,;:)\]}>\"]+$"
MARKER_LIKE = r"(?i)^(?:[\s*†‡§¶#]+|[*†‡§¶#]+\d*|\d+[a-z]?)$"
SMALL, SMALL_LENGTH, AROUND, FRONT_PAGES = 0.72, 8, 2, 2


def _clean(blocks: DataFrame, front: int) -> DataFrame:
    """Blocks of the first pages, numbered anew from 0 on their page; soft hyphens and repeated spaces leave."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "­", ""), r"\s+", " "))
    place = F.row_number().over(Window.partitionBy("doc", "page").orderBy("pos")) - 1
    return blocks.filter(F.col("page") < front).withColumn("text", text).withColumn("block", place.cast("long"))


def indicator_blocks(blocks: DataFrame, front: int = FRONT_PAGES) -> DataFrame:
    """doc, page, block, text, emails, a flag for each of SAYS, context: the blocks of blocks(doc, page, pos, text) that
    name an address or correspondence, with the two blocks before and after on their page.

    One window by page gives number and context; nothing is joined. Blank blocks keep their places.
    """
    framed = Window.partitionBy("doc", "page").orderBy("pos").rowsBetween(-AROUND, AROUND)
    emails = F.transform(F.regexp_extract_all("text", F.lit(ADDRESS), 1), lambda e: F.regexp_replace(F.lower(e), ADDRESS_TAIL, ""))
    seen = _clean(blocks, front).withColumn("context", F.collect_list(F.struct("block", "text")).over(framed)).withColumn("emails", emails)
    for name, pattern in SAYS.items():
        seen = seen.withColumn(name, F.col("text").rlike(pattern))
    any_word = F.col("correspondence_word") | F.col("electronic_address") | F.col("email_label")
    return seen.filter((F.size("emails") > 0) | any_word).select("doc", "page", "block", "text", "emails", *SAYS, "context")


def sized_spans(spans: DataFrame, front: int = FRONT_PAGES) -> DataFrame:
    """spans(doc, page, pos, text, size) with relative_size (to the median of the page's sizes, of spans with text and a
    positive size), marker_like, and small: short spans of at most SMALL times the median, on the first page."""
    clean = _clean(spans, front)
    medians = clean.filter("text <> '' AND size > 0").groupBy("doc", "page").agg(F.median("size").alias("median"))
    full = clean.join(medians, ["doc", "page"], "left")
    relative = F.when(F.col("median") > 0, F.round(F.coalesce("size", F.lit(0.0)) / F.col("median"), 3))
    full = full.withColumn("relative_size", relative).withColumn("marker_like", (F.col("text") != "") & F.col("text").rlike(MARKER_LIKE))
    small = (F.col("relative_size") <= SMALL) & (F.length("text") <= SMALL_LENGTH)
    shown = (F.col("page") == 0) & (F.col("text") != "") & (F.col("marker_like") | F.coalesce(small, F.lit(False)))
    return full.select("doc", "page", "block", "text", "size", F.round("median", 3).alias("median"), "relative_size", "marker_like", shown.alias("small"))


def signals(indicators: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, signals: what the indicator blocks and small spans of a document say together, in a fixed order."""
    said = indicators.groupBy("doc").agg(*[F.bool_or(c).alias(c) for c in SAYS], F.bool_or(F.size("emails") > 0).alias("email"))
    marked = spans.groupBy("doc").agg(F.bool_or("small").alias("small"))
    no = F.lit(False)
    full = said.join(marked, "doc", "full").select("doc", *[F.coalesce(c, no).alias(c) for c in (*SAYS, "email", "small")])
    word, explicit = F.col("correspondence_word"), F.col("explicit_correspondence")
    names = [
        (explicit, "EXPLICIT_CORRESPONDENCE"), (word & ~explicit, "CORRESPONDENCE_WORD_ONLY"), (F.col("electronic_address"), "ELECTRONIC_ADDRESS"), (F.col("email_label"), "EMAIL_LABEL"),
        (F.col("email"), "HAS_EMAIL"), (F.col("email") & ~word, "EMAIL_WITHOUT_CORRESPONDENCE_WORD"), (F.col("small"), "FIRST_PAGE_SMALL_OR_MARKER_SPANS")]
    return full.select("doc", F.array_compact(F.array(*[F.when(c, n) for c, n in names])).alias("signals"))
