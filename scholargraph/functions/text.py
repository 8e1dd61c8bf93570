"""Column functions over scholarly text. Everything is built in, but for Unicode folding and reference segmentation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the source formats.
DOI = r"(?i)10\.\d{4,9}/\S+"
EMAIL = r"(?i)(?<![\w.+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})"
YEAR = r"\b(?:18|19|20)\d{2}\b"
DATED = r"(?s)^[^,]*,\s*((?:18|19|20)\d{2})\s*(?:,(.*))?$"
EMAIL_TAIL = r"[.,;:)\]}>\"]+$"
# Words that say nothing about a title.
STOP_WORDS = [
    "the", "and", "for", "with", "from", "into", "via", "using", "study", "studies", "new", "toward", "towards",
    "based", "effect", "effects", "role", "analysis", "molecular", "state", "states", "system", "systems", "approach",
    "investigation", "properties", "mechanism", "mechanisms", "dynamics", "energy", "electronic",
]
# What marks a role, a contact or a supplement.
NOISE = r"(?i)\b(?:publisher|editorial\s+office|customer\s+service|technical\s+support|permissions?\s+(?:department|team)|reprints?\s+department)\b"
ROLES = [
    ("CORRESPONDING_AUTHOR", r"(?i)\bcorresponding\s+authors?\b"),
    ("AUTHOR_TO_WHOM_CORRESPONDENCE", r"(?i)\bauthors?\s+(?:to\s+whom|for)\s+correspondence(?:\s+should\s+be\s+addressed)?\b"),
    ("TO_WHOM_CORRESPONDENCE", r"(?i)\bto\s+whom\s+correspondence\s+should\s+be\s+addressed\b"),
    ("CORRESPONDENCE_TO", r"(?i)(?:^|[\s*†‡§¶#])correspondence\s+(?:to\b|should\s+be\s+addressed\b)"),
    ("CORRESPONDENCE_LABEL", r"(?i)(?:^|[\s*†‡§¶#])correspondence\s*:\s*"),
]
ENVELOPE = r"(?i)[✉]\s*(?:e-?mail\s*[:.]?)?"
CONTACT_HEADING = r"(?is)(?:^|\n)\s*CONTACT\s+.+?@"
STAR_CONTACT = r"(?is)(?:^|\s)[*†‡§¶#]\s*(?:(?!present\s+address|current\s+address).){0,120}?(?:[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})"
CONTACT_LABEL = r"(?i)\be-?mail\s*(?:address\s*)?[:.]|\belectronic\s+(?:mail|address)\s*[:.]"
MARKER = r"(?i)^\s*([*†‡§¶#✉]+|[a-z]\)|\([a-z]\)|\d+\))\s*"
SUPPLEMENT = r"(?i)(?:^|[\s_.-])(?:si|esi|supp(?:l(?:ement(?:ary|al)?)?)?|supporting)(?:[\s_.-]|$|\d)"


def quoted(c: Column) -> Column:
    """The text as a regular expression that matches nothing but itself."""
    return F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def doi(c: Column) -> Column:
    """First DOI, lower case, without closing punctuation; null if there is none."""
    return blank_to_null(F.lower(F.regexp_replace(F.regexp_extract(c, DOI, 0), r"[.);,]+$", "")))


def doi_list(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(c, F.lit(DOI.replace("10", "(10", 1) + ")"), 1), lambda x: F.lower(F.regexp_replace(x, EMAIL_TAIL, "")))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def resolver_doi(c: Column) -> Column:
    """The resolver's form: address prefix off, lower case, without closing punctuation."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    return blank_to_null(F.regexp_replace(F.lower(bare), r"[.,;)\]}]+$", ""))


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def safe_int(c: Column) -> Column:
    return F.try_cast(F.trim(c), "int") if hasattr(F, "try_cast") else F.trim(c).try_cast("int")


def emails(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), 1), lambda x: F.regexp_replace(F.lower(x), EMAIL_TAIL, ""))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def leading_marker(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, MARKER, 1))


def role_kind(c: Column) -> Column:
    """kind, reason and confidence of one front-matter span; the first rule that holds decides."""
    text = F.coalesce(c, F.lit(""))
    raw = normalize_space(F.translate(text, "­", ""))
    mailed = F.size(emails(text)) > 0
    rules = [(raw == "", "NONE", "EMPTY", 0.0), (raw.rlike(NOISE), "NOISE", "PUBLISHER_CONTACT_NOISE", 0.0)]
    rules += [(raw.rlike(p), "EXPLICIT_ROLE", name, 1.0) for name, p in ROLES]
    rules += [
        (raw.rlike(ENVELOPE) & mailed, "ROLE_MARKER", "ENVELOPE_EMAIL_ROLE_MARKER", 0.99),
        (text.rlike(CONTACT_HEADING) & mailed, "ROLE_MARKER", "PUBLISHER_CONTACT_HEADING", 0.97),
        (text.rlike(STAR_CONTACT) & mailed, "ROLE_MARKER", "SYMBOL_CONTACT_ROLE_MARKER", 0.96),
        (mailed | raw.rlike(CONTACT_LABEL), "CONTACT_ONLY", "CONTACT_WITHOUT_ROLE", 0.0),
    ]
    out = F.struct(F.lit("NONE").alias("kind"), F.lit("NO_CORRESPONDENCE_SIGNAL").alias("reason"), F.lit(0.0).alias("confidence"))
    for test, kind, reason, sure in reversed(rules):
        out = F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def title_words(c: Column) -> Column:
    words = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Za-z][A-Za-z0-9+-]{2,})"), 1), lambda w: F.lower(w))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def adjacent_pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def tokens(c: Column) -> Column:
    """Distinct words of two characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)(\w+)"), 1), lambda w: F.length(w) > 1))


def coverage(part: Column, whole: Column) -> Column:
    """Share of `part`'s tokens that `whole` has; 0 if it has none."""
    return F.when(F.size(part) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def cited_reference(raw: Column) -> Column:
    """author, year, source, volume, page and DOI of one cited-reference line. Volume and page are pieces V<digit>
    and P<digit>, so that a source such as PHYS REV is neither. The piece after the author is the year if it is one, so
    that four digits in the author's name are not; otherwise the first year of the line counts."""
    own = F.regexp_extract(raw, DATED, 1)
    year = F.when(own != "", own).otherwise(F.regexp_extract(raw, YEAR, 0))
    rest = F.when(own != "", F.regexp_extract(raw, DATED, 2)).otherwise(F.regexp_extract(raw, r"\b(?:18|19|20)\d{2}\b(.*)$", 1))
    after = F.regexp_replace(rest, r"^[ ,]+", "")
    return F.struct(
        F.trim(F.split(raw, ",")[0]).alias("author"), blank_to_null(year).cast("int").alias("year"),
        F.when(year != "", blank_to_null(F.trim(F.split(after, ",")[0]))).alias("source"),
        blank_to_null(F.trim(F.regexp_extract(raw, r"(?:^|,\s*)V(\d[^,]*)", 1))).alias("volume"),
        blank_to_null(F.trim(F.regexp_extract(raw, r"(?:^|,\s*)P(\d[^,]*)", 1))).alias("page"), doi(raw).alias("doi"),
    )


def correspondence_groups(c: Column) -> Column:
    """array<struct<names, address, raw>>: names before a '(corresponding author)' marker all share the address."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?i)\.\s*;\s*(?=[^.;]*?\(corresponding author\))")
    marked = F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"^;+|;+$", "")), lambda p: p.rlike(r"(?i)\(corresponding author\)"))
    groups = F.transform(marked, lambda p: F.struct(
        split_list(F.regexp_replace(F.split(p, r"(?i)\(corresponding author\)")[0], r"[ ,]+$", "")).alias("names"),
        blank_to_null(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(p, r"(?is)^.*?\(corresponding author\)", "")), r"^[ ,]+", ""), r"[ .]+$", "")).alias("address"),
        p.alias("raw")))
    return F.filter(groups, lambda g: F.size(g["names"]) > 0)


def address_groups(c: Column) -> Column:
    """array<struct<names, address>> of bracketed author addresses; without brackets, one group of no names."""
    whole = F.coalesce(c, F.lit(""))
    names = F.regexp_extract_all(whole, F.lit(r"\[([^\]]+)\]\s*(.*?)(?=;\s*\[|$)"), 1)
    places = F.regexp_extract_all(whole, F.lit(r"\[([^\]]+)\]\s*(.*?)(?=;\s*\[|$)"), 2)
    found = F.zip_with(names, places, lambda n, a: F.struct(split_list(n).alias("names"), F.regexp_replace(F.trim(a), r"^;+|;+$", "").alias("address")))
    bare = F.array(F.struct(F.array().cast("array<string>").alias("names"), F.trim(whole).alias("address")))
    return F.when(whole == "", F.array().cast("array<struct<names:array<string>,address:string>>")).when(F.size(found) == 0, bare).otherwise(found)


def funding_items(c: Column) -> Column:
    """array<struct<agency, grants>> of 'Agency [grant, grant]; Agency'."""
    return F.transform(split_list(c), lambda x: F.struct(
        F.trim(F.regexp_replace(x, r"\[[^\]]*\]\s*$", "")).alias("agency"),
        F.filter(F.transform(F.split(F.regexp_extract(x, r"\[([^\]]*)\]\s*$", 1), ","), lambda g: F.trim(g)), lambda g: g != "").alias("grants")))


def completeness(reported: Column, has_list: Column, parsed: Column) -> Column:
    """State of one export of a reference list, from its reported count, its presence and its length."""
    return (
        F.when((reported == 0) & (parsed == 0), "COMPLETE_ZERO")
        .when(has_list & reported.isNotNull() & (parsed >= reported), "COMPLETE")
        .when(has_list & reported.isNotNull(), "PARTIAL")
        .when(has_list & (parsed > 0), "PRESENT_UNVERIFIED")
        .when(reported > 0, "MISSING_FROM_EXPORT")
        .otherwise("UNKNOWN")
    )


def reference_key(target: Column, cited_doi: Column, raw: Column) -> Column:
    return F.coalesce(F.concat(F.lit("rec:"), target), F.concat(F.lit("doi:"), F.lower(cited_doi)), F.concat(F.lit("raw:"), F.sha1(raw)))


def document_role(path: Column) -> Column:
    """role, confidence from a file's name: a supplement says so, anything else is a candidate article."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    pick = lambda r, c: F.struct(F.lit(r).alias("role"), F.lit(c).alias("confidence"))
    return F.when(path.isNull() | (path == ""), pick("UNKNOWN", 0.0)).when(stem.rlike(SUPPLEMENT), pick("SUPPLEMENTARY", 0.98)).otherwise(pick("PRIMARY_ARTICLE", 0.6))


def compatible_initials(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (a.startswith(b) | b.startswith(a)), F.lit(False))


@F.pandas_udf(T.StringType())
def fold_alnum(s: pd.Series) -> pd.Series:
    """Letters and digits of the case-folded, decomposed text, others as single spaces. Null stays null."""

    def one(x):
        if x is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", x).casefold() if not unicodedata.combining(c))
        return re.sub(r"[^a-z0-9]+", " ", plain).strip()

    return s.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: " ".join(x.split()).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def search_text(s: pd.Series) -> pd.Series:
    """Case-folded compatibility form without accents; other scripts are kept."""

    def one(x):
        folded = unicodedata.normalize("NFKC", x).casefold()
        return " ".join("".join(c for c in unicodedata.normalize("NFKD", folded) if unicodedata.category(c) != "Mn").split())

    return s.map(one, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("family", "given", "normalized", "initials", "search_form")]))
def name_features(first: pd.Series, last: pd.Series) -> pd.DataFrame:
    """Features of a personal name; blocking and scoring only ever compare these."""

    def clean(x):
        return " ".join(unicodedata.normalize("NFKC", x or "").split()).casefold()

    rows = []
    for a, b in zip(first, last):
        given, family = clean(a), clean(b)
        full = " ".join(x for x in (given, family) if x)
        plain = "".join(c for c in unicodedata.normalize("NFKD", full) if unicodedata.category(c) != "Mn")
        rows.append((family or None, given or None, full, "".join(p[0] for p in re.split(r"[\s'-]+", given) if p) or None, plain))
    return pd.DataFrame(rows, columns=["family", "given", "normalized", "initials", "search_form"])
