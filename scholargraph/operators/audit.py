"""Audit rows: one wide row a paper, a table of rules that are evaluated on it, and the risk of what they flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.functions import text as X
from scholargraph.operators import quality

ROLE_RANK = {"PRIMARY_ARTICLE": 0, "UNKNOWN": 1, "SUPPLEMENTARY": 2}
# What is too little, and how long a title or an article has to be for the rule to hold.
LEAST_FRONT, LEAST_OVERLAP, LONG_TITLE, LEAST_COVERAGE, LONG_ARTICLE = 80, 0.20, 20, 0.50, 4

#: (flag, condition on the wide row, how far the document has to be read for it: 0 none chosen, 1 chosen, 2 parsed)
RULES = [
    ("NO_AVAILABLE_PRIMARY_PDF", "document IS NULL", 0),
    ("MULTIPLE_PRIMARY_CANDIDATES", "primaries > 1", 0),
    ("SELECTED_SUPPLEMENTARY_DOCUMENT", "role = 'SUPPLEMENTARY'", 1),
    ("PDF_PARSE_ERROR", "error IS NOT NULL", 1),
    ("NO_USABLE_FRONT_MATTER_TEXT", f"length(trim(coalesce(front, ''))) < {LEAST_FRONT}", 2),
    ("LOW_TITLE_FRONT_MATTER_OVERLAP", f"title_overlap < {LEAST_OVERLAP} AND length(trim(title)) >= {LONG_TITLE}", 2),
    ("LOW_SOURCE_AUTHOR_HEADER_COVERAGE", f"author_coverage < {LEAST_COVERAGE} AND authors >= 2", 2),
    ("FRONT_MATTER_DOI_CONFLICT", "doi IS NOT NULL AND size(front_dois) > 0 AND NOT array_contains(front_dois, doi)", 2),
    ("ROLE_SIGNAL_UNMAPPED_TO_SOURCE_AUTHOR", "roles > 0 AND mapped = 0", 2),
    ("ROLE_EMAIL_AUTHOR_COUNT_MISMATCH", "role_emails > 0 AND mapped < role_emails", 2),
    ("ROLE_SIGNAL_WITHOUT_EMAIL", "roles > 0 AND role_emails = 0", 2),
    ("CONTACT_WITHOUT_ROLE_SIGNAL", "contacts > 0 AND roles = 0", 2),
    ("AUTHOR_MARKER_WITHOUT_ROLE_SIGNAL", "markers > 0 AND roles = 0", 2),
    ("NO_REFERENCE_SECTION", f"NOT has_references AND pages >= {LONG_ARTICLE}", 2),
]


def chosen_documents(documents: DataFrame) -> DataFrame:
    """paper, document, role, primaries of documents(paper, document, role, confidence): the best by role, confidence and
    id, and how many are primary articles."""
    rank = F.coalesce(*[F.when(F.col("role") == r, n) for r, n in ROLE_RANK.items()], F.lit(1))
    best = F.row_number().over(Window.partitionBy("paper").orderBy(rank, F.desc("confidence"), "document"))
    primaries = F.count_if(F.col("role") == "PRIMARY_ARTICLE").over(Window.partitionBy("paper"))
    return documents.withColumn("primaries", primaries).withColumn("k", best).filter("k = 1").select("paper", "document", "role", "primaries")


def wide_rows(papers: DataFrame, mentions: DataFrame, documents: DataFrame, texts: DataFrame, spans: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row a paper of papers(paper, title, doi), with all that the rules look at.

    mentions(paper, family) are its authors; documents(paper, document, role, confidence) those that can be reached;
    texts(document, pages, error, front, has_references) what was read of them; spans(document, kind, text) the ROLE,
    CONTACT and MARKER spans of their front matter; mapped(paper, mention) the authors whom a role was mapped to.
    Aggregates are made a table at a time, before they are joined, so that no child multiplies another.
    """
    chosen = chosen_documents(documents)
    is_role = F.col("kind") == "ROLE"
    counted = spans.groupBy("document").agg(
        F.count_if(is_role).alias("roles"), F.count_if(F.col("kind") == "CONTACT").alias("contacts"), F.count_if(F.col("kind") == "MARKER").alias("markers"),
        F.sum(F.when(is_role, F.size(X.emails(F.col("text")))).otherwise(0)).alias("role_emails"))
    read = chosen.join(texts, "document", "left").join(counted, "document", "left")
    folded = F.lower(F.coalesce("front", F.lit("")))
    named = mentions.filter("family IS NOT NULL AND length(family) >= 2").join(read.select("paper", folded.alias("low")), "paper")
    surnames = named.groupBy("paper").agg((F.count_if(F.contains("low", F.lower("family"))) / F.count(F.lit(1))).alias("author_coverage"))
    authors = mentions.groupBy("paper").agg(F.count(F.lit(1)).alias("authors"))
    roles = mapped.groupBy("paper").agg(F.count_distinct("mention").alias("mapped"))
    full = papers.join(read, "paper", "left").join(surnames, "paper", "left").join(authors, "paper", "left").join(roles, "paper", "left")
    title, front = X.tokens(F.lower("title")), X.tokens(folded)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("primaries", "roles", "contacts", "markers", "role_emails", "authors", "mapped", "pages")}
    return full.withColumns(zero).withColumns({
        "title_overlap": F.when(F.col("document").isNotNull() & (F.size(title) > 0), X.coverage(title, front)), "front_dois": X.doi_list(F.coalesce("front", F.lit(""))),
        "has_references": F.coalesce("has_references", F.lit(False))})


def flags(rules: list[tuple[str, str, int]] = RULES) -> Column:
    """The flags whose conditions hold, in order of name. A rule is silent where the document is not read so far."""
    reads = {0: F.lit(True), 1: F.col("document").isNotNull(), 2: F.col("document").isNotNull() & F.col("error").isNull()}
    return F.array_compact(F.array(*[F.when(reads[depth] & F.coalesce(F.expr(condition), F.lit(False)), name) for name, condition, depth in sorted(rules)]))


def audit(rows: DataFrame, rules: list[tuple[str, str, int]] = RULES) -> DataFrame:
    """paper, document, role, the measures, flags, risk, severity, requires_review of wide_rows(); highest risk first is
    the order of the queue (see `queue`)."""
    flagged = rows.withColumn("flags", flags(rules))
    score, severity = quality.risk(F.col("flags"))
    return flagged.select(
        "paper", "document", "role", "title_overlap", "author_coverage", "authors", "mapped", "roles", "contacts", "markers", "role_emails", "flags",
        score.alias("risk"), severity.alias("severity"), F.col("document").isNotNull().alias("requires_review"))


def queue(audited: DataFrame, limit: int = 500) -> DataFrame:
    return audited.orderBy(F.desc("risk"), "paper").limit(limit)


def blind(audited: DataFrame) -> DataFrame:
    """What a reviewer sees: no machine prediction, flag, risk or severity, in order of paper."""
    return audited.filter("requires_review").select("paper", "document", "role").orderBy("paper")


def severity_histogram(audited: DataFrame) -> DataFrame:
    """counter, value, n: papers by severity and by flag, in one scan."""
    return quality.histograms(audited, {"severity": F.col("severity"), "flag": F.col("flags")})
