"""Evidence in front matter: spans, mentions in texts, effective roles, and the state of a document's text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholargraph.functions import text as X
from scholargraph.operators.components import connected_components
from scholargraph.operators.lineage import staged


def text_status(pages: DataFrame, thin: int = 200) -> DataFrame:
    """doc, pages, status of pages(doc, n_chars): NORMAL if most pages have text, THIN if most have some, EMPTY if
    none has, else MIXED."""
    n = pages.groupBy("doc").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("n_chars") >= thin).alias("full"), F.count_if((F.col("n_chars") > 0) & (F.col("n_chars") < thin)).alias("some"))
    return n.select("doc", "pages", F.when(F.col("full") + F.col("some") == 0, "EMPTY").when(2 * F.col("full") > F.col("pages"), "NORMAL").when(2 * F.col("some") > F.col("pages"), "THIN").otherwise("MIXED").alias("status"))


def candidate_spans(blocks: DataFrame) -> DataFrame:
    """doc, pos, kind, text of blocks(doc, pos, text) that say something about roles; a block that ends with a colon
    takes the next one along."""
    w = Window.partitionBy("doc").orderBy("pos")
    full = blocks.withColumn("next", F.lead("text").over(w))
    joined = F.when(F.rtrim("text").endswith(":") & F.col("next").isNotNull(), F.concat_ws(" ", "text", "next")).otherwise(F.col("text"))
    return full.select("doc", "pos", joined.alias("text")).withColumn("kind", X.role_kind(F.col("text"))["kind"]).filter(F.col("kind").isin("EXPLICIT_ROLE", "ROLE_MARKER", "CONTACT_ONLY"))


def email_owners(mentions: DataFrame, emails: DataFrame) -> DataFrame:
    """paper, email, mention: e-mails whose local part names exactly one mention of the paper.

    mentions(paper, mention, given, family), emails(paper, email). A name matches if the local part is one of its
    forms (given.family, family.given, initial + family, family + initial) or holds the family name of five letters
    or more as a piece.
    """
    local = F.regexp_replace(F.split("email", "@")[0], r"[^a-z.]", "")
    squeezed = F.regexp_replace("local", r"\.", "")
    first = F.substring("given", 1, 1)
    forms = F.array(F.concat("given", "family"), F.concat("family", "given"), F.concat(first, F.col("family")), F.concat(F.col("family"), first))
    both = mentions.join(emails.withColumn("local", local), "paper").filter(
        F.array_contains(forms, squeezed) | ((F.length("family") >= 5) & F.array_contains(F.split("local", r"\."), F.col("family"))))
    return both.groupBy("paper", "email").agg(F.count_distinct("mention").alias("n"), F.min("mention").alias("mention")).filter("n = 1").drop("n")


def effective_roles(mentions: DataFrame, stated: DataFrame) -> DataFrame:
    """paper, position, roles: roles of a paper's authors after what the corpus states is applied.

    mentions(paper, position, role boolean); stated(paper, position null if unmapped). If every statement of a paper
    is mapped to a position, the statements replace its roles; if only some are, they are added.
    """
    mapping = stated.groupBy("paper").agg(F.bool_and(F.col("position").isNotNull()).alias("complete"), F.collect_set("position").alias("at"))
    says = F.coalesce(F.array_contains("at", F.col("position")), F.lit(False))
    return mentions.join(mapping, "paper", "left").select(
        "paper", "position", F.when(F.col("complete"), says).otherwise(F.col("role") | says).alias("role"),
        F.when(F.col("complete").isNull(), "NOT_STATED").when(F.col("complete"), "REPLACED").otherwise("ADDED").alias("how"))


@F.pandas_udf(T.BooleanType())
def compatible_person_names(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two names can be one person's: every part of the shorter one has a part of its own in the other that
    is equal or, where either is an initial, begins alike; at least one part of two letters or more is equal."""

    def one(x, y):
        p, q = sorted(([w for w in "".join(c if c.isalnum() else " " for c in (z or "").casefold()).split()] for z in (x, y)), key=len)
        if not p:
            return False
        free, equal = list(q), 0
        for w in sorted(p, key=lambda w: (-len(w), w)):
            exact = [z for z in free if z == w]
            near = exact or [z for z in free if (len(w) == 1 or len(z) == 1) and w[0] == z[0]]
            if not near or (not exact and len(set(near)) > 1):
                return False
            free.remove(near[0])
            equal += bool(exact) and len(w) > 1
        return equal > 0

    return pd.Series([one(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("initials", T.IntegerType()), T.StructField("parts", T.IntegerType())]))
def _name_parts(names: pd.Series) -> pd.DataFrame:
    """A name's parts of two letters or more (a repeated one with its number), how many initials it has, and all its parts."""
    out = []
    for z in names:
        parts = "".join(c if c.isalnum() else " " for c in (z or "").casefold()).split()
        seen, words = {}, []
        for w in parts:
            if len(w) > 1:
                seen[w] = seen.get(w, 0) + 1
                words.append(f"{w} {seen[w]}")
        out.append((words, len(parts) - len(words), len(parts)))
    return pd.DataFrame(out, columns=["words", "initials", "parts"])


def name_pairs(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """left(block, left_id, a) and right(block, right_id, b): all pairs of a block whose names are compatible, with a and b.

    Parts of two letters or more of the name with fewer parts (the left one, if they have as many) find an equal part or take
    an initial of the other; so of w such parts and i initials, at least max(1, w - i) are equal. Names that share k words
    share one of the first words of each, in order of rarity, all but k - 1 of them being tried. Only pairs that meet so are
    compared. Names are told apart by their numbers of words and initials, each pair of which has its own k.
    """
    sides = []
    for df, key, name in ((left, "left_id", "a"), (right, "right_id", "b")):
        n = _name_parts(name)
        sides.append(staged(df.select(block, key, name, n.alias("n")).select(block, key, name, "n.*").filter("size(words) > 0"), "names"))
    rare = sides[0].select(block, "words").unionByName(sides[1].select(block, "words")).select(block, F.explode("words").alias("word")).groupBy(block, "word").agg(F.count(F.lit(1)).alias("n"))
    kinds = [df.select(F.size("words").alias(f"w{i}"), F.col("initials").alias(f"i{i}"), F.col("parts").alias(f"p{i}")).distinct() for i, df in enumerate(sides)]
    k = F.when(F.col("p0") <= F.col("p1"), F.col("w0") - F.col("i1")).otherwise(F.col("w1") - F.col("i0"))
    meet = kinds[0].crossJoin(kinds[1]).withColumn("k", F.greatest(F.lit(1), k)).filter("k <= w0 AND k <= w1")
    keyed = []
    for i, (df, key, name) in enumerate(zip(sides, ("left_id", "right_id"), "ab")):
        ranked = df.distinct().select(block, key, name, "initials", "parts", F.size("words").alias("w"), F.explode("words").alias("word")).join(rare, [block, "word"])
        ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy(block, key, name).orderBy("n", "word")))
        on = (F.col("w") == F.col(f"w{i}")) & (F.col("initials") == F.col(f"i{i}")) & (F.col("parts") == F.col(f"p{i}"))
        keyed.append(ranked.join(meet, on).filter(F.col("at") <= F.col("w") - F.col("k") + 1).select(block, "word", "w0", "i0", "p0", "w1", "i1", "p1", key))
    met = keyed[0].join(keyed[1], [block, "word", "w0", "i0", "p0", "w1", "i1", "p1"]).select(block, "left_id", "right_id").distinct()
    a, b = sides[0].select(block, "left_id", "a"), sides[1].select(block, "right_id", "b")
    return met.join(a, [block, "left_id"]).join(b, [block, "right_id"]).filter(compatible_person_names("a", "b"))


def multiplicity_seeds(mentions: DataFrame) -> DataFrame:
    """name, mention, seed: as many identities as a name has mentions on one paper at most, seeded by the smallest
    mentions of the paper that needs most (the smallest such paper)."""
    n = mentions.groupBy("name", "paper").agg(F.count_distinct("mention").alias("k"))
    need = n.groupBy("name").agg(F.max_by("paper", F.struct("k", -F.col("paper"))).alias("paper"), F.max("k").alias("needed"))
    w = Window.partitionBy("name").orderBy("mention")
    return mentions.select("name", "paper", "mention").distinct().join(need, ["name", "paper"]).withColumn("seed", F.row_number().over(w).cast("long")).select("name", "mention", "seed", "needed")


def apply_merges(authors: DataFrame, merges: DataFrame, papers: DataFrame) -> DataFrame:
    """author, canonical: merges(left, right) are followed to the smallest author of their group; a merge of two
    authors of one paper (papers(author, paper)) is refused."""
    a, b = papers.select(F.col("author").alias("left"), "paper"), papers.select(F.col("author").alias("right"), "paper")
    refused = merges.join(a, "left").join(b, ["right", "paper"]).select("left", "right").distinct()
    found = connected_components(merges.join(refused, ["left", "right"], "left_anti"), "left", "right").withColumnRenamed("id", "author")
    return authors.select("author").join(found, "author", "left").select("author", F.coalesce("component", "author").alias("canonical"))


def external_id(namespace: Column, value: Column) -> Column:
    """Normal form of an external id: ORCIDs without their address, upper case; others trimmed."""
    orcid = F.upper(F.regexp_replace(F.trim(value), r"(?i)^https?://(?:www\.)?orcid\.org/", ""))
    return F.when(F.upper(namespace) == "ORCID", orcid).otherwise(F.trim(value))


def attachment_state(path: Column, listed: Column) -> Column:
    """State of a stored attachment path: STORED, LINKED, ABSOLUTE, URL, with _MISSING where the file is not listed."""
    kind = (
        F.when(path.isNull() | (path == ""), "NO_PATH").when(path.rlike("(?i)^https?://"), "URL").when(path.startswith("storage:"), "STORED")
        .when(path.startswith("attachments:"), "LINKED").when(path.rlike(r"^(?:/|[A-Za-z]:[\\/])"), "ABSOLUTE").otherwise("UNRESOLVED"))
    return F.when(kind.isin("STORED", "LINKED", "ABSOLUTE") & ~listed, F.concat(kind, F.lit("_MISSING"))).otherwise(kind)


def field_maps(items: DataFrame) -> DataFrame:
    """item, fields: attribute-value rows items(item, field, value) as one sorted map an item; of several values of
    a field the smallest stays."""
    one = items.groupBy("item", "field").agg(F.min("value").alias("value"))
    return one.groupBy("item").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


HEADING = r"(?i)^\s*(?:\d+\.?\s+)?(?:references?(?:\s+and\s+notes)?|bibliography|literature\s+cited|works\s+cited)\s*:?\s*$"
HEADING_FROM, TAIL_FROM, TAIL_ENTRIES = 0.3, 0.6, 8


def reference_sections(pages: DataFrame) -> DataFrame:
    """doc, start_page, heading, method, confidence, entries of pages(doc, page from 0, text).

    The last heading line after the first 30 % of the pages opens the section; without one, the last 40 % of two
    pages or more are tried, and kept if they hold eight numbered entries that begin at 5 or before.
    """
    counts = pages.groupBy("doc").agg(F.max("page").alias("last"))
    numbered = pages.join(counts, "doc").withColumn("n", F.col("last") + 1)
    lines = numbered.select("doc", "page", "n", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("at", "line"))
    heads = lines.filter((F.col("page") >= F.floor(F.col("n") * HEADING_FROM)) & F.col("line").rlike(HEADING)).groupBy("doc").agg(
        F.max(F.struct("page", "at", F.trim("line").alias("heading"))).alias("h"))
    tails = numbered.select("doc", "n").distinct().join(heads, "doc", "left_anti").filter("n >= 2").select("doc", F.struct(
        F.floor(F.col("n") * TAIL_FROM).cast("int").alias("page"), F.lit(-1).alias("at"), F.lit("").alias("heading")).alias("h"))
    starts = heads.unionByName(tails.withColumn("h", F.col("h").cast(heads.schema["h"].dataType)))
    after = lines.join(starts, "doc").filter((F.col("page") > F.col("h.page")) | ((F.col("page") == F.col("h.page")) & (F.col("at") > F.col("h.at"))))
    text = after.groupBy("doc", "h").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "at", "line"))), lambda x: x["line"]), "\n").alias("t"))
    from scholargraph.functions.segment import segment_references

    found = text.select("doc", "h", segment_references("t").alias("s"))
    implicit = F.col("h.heading") == ""
    return found.filter(~implicit | ((F.size("s.entries") >= TAIL_ENTRIES) & (F.col("s.entries")[0]["ordinal"] <= 5))).select(
        "doc", F.col("h.page").alias("start_page"), F.col("h.heading").alias("heading"),
        F.when(implicit, F.concat(F.lit("implicit-"), F.col("s.method"))).otherwise(F.col("s.method")).alias("method"), "s.confidence", "s.entries")


# How the authors of a citation are written.
AUTHOR_FORMS = [r"\b[A-Z]\.\s*[A-Z][a-z]", r"\b[A-Z][a-z]+\s+[A-Z]{1,2}\b[,\s]", r"(?i:\bet\s+al\b)"]


def prefer_section(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two extractions of a document, the better one: entries that look like citations first, then a heading, then
    more entries; the first of equals."""
    cites = "|".join(AUTHOR_FORMS)
    share = F.size(F.filter(F.slice("entries", 1, 50), lambda e: e["raw"].rlike(cites))) / F.size(F.slice("entries", 1, 50))
    good = (F.size("entries") == 0) | ((share >= 0.5) & F.forall(F.slice("entries", 1, 3), lambda e: e["raw"].rlike(cites)))
    ranked = a.withColumn("channel", F.lit(0)).unionByName(b.withColumn("channel", F.lit(1)))
    rank = F.struct(good.alias("good"), (F.col("heading") != "").alias("headed"), F.size("entries").alias("n"), (-F.col("channel")).alias("c"))
    return ranked.groupBy("doc").agg(F.max_by(F.struct("start_page", "heading", "method", "confidence", "entries"), rank).alias("s")).select("doc", "s.*")


def names_in_text(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """paper, mention: mentions(paper, mention, given, family) whose full or reversed name stands in texts(paper, text)
    (both in their search form) between other than word characters."""
    inside = lambda form: F.rlike("text", F.concat(F.lit(r"(?U)(?<!\w)"), X.quoted(form), F.lit(r"(?!\w)")))
    forms = [F.concat_ws(" ", "given", "family"), F.concat_ws(" ", "family", "given"), F.concat_ws(", ", "family", "given")]
    hit = F.lit(False)
    for form in forms:
        hit = hit | ((F.length(form) >= 3) & inside(form))
    return mentions.join(texts, "paper").filter(hit).select("paper", "mention").distinct()


# Fixed value: characters behind a name within which its role marker has to end.
MARKER_REACH = 28


def has_adjacent_marker(name: Column | str, text: Column | str, marker: Column | str) -> Column:
    """Whether a role marker stands right behind the name: signs, digits and spaces may come in between, another
    name may not. Of a letter in brackets the letter is enough. Nulls and blanks are never found."""
    name, text, marker = (F.col(c) if isinstance(c, str) else c for c in (name, text, marker))
    bare = F.regexp_replace(F.trim(marker), r"^[( ]*([A-Za-z])[) ]*$", "$1")
    gap = F.concat(F.lit("[^a-z]{0,"), F.greatest(F.lit(MARKER_REACH) - F.length(bare), F.lit(0)).cast("string"), F.lit("}"))
    words = F.regexp_replace(X.quoted(F.trim(name)), r"\s+", r"\\s+")
    found = F.rlike(text, F.concat(F.lit("(?iu)"), words, gap, X.quoted(bare)))
    return F.coalesce((F.trim(name) != "") & (bare != "") & found, F.lit(False))


def closure_seeds(mentions: DataFrame, members: DataFrame, blocked: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """mention, author: identities that must be made because a mention has no candidate of its name left.

    mentions(name, paper, position, mention); members(mention, author, paper, name) accepted so far; blocked(mention,
    author). An author is a candidate if it has the name, is not on the paper already and is not ruled out for the
    mention. A round seeds, for each name, the mentions without a candidate on the first paper that has any: they are
    on one paper, so none of them can be a candidate for another. Rounds go on until there is none.
    """
    from scholargraph.operators.lineage import checkpointed

    held = checkpointed(members.select("mention", "author", "paper", "name"))
    made = None
    for _ in range(max_rounds):
        open_ = mentions.join(held.select("mention"), "mention", "left_anti")
        authors = held.select("name", "author").distinct()
        on_paper = held.select("paper", "author").distinct()
        can = open_.join(authors, "name").join(on_paper, ["paper", "author"], "left_anti").join(blocked, ["mention", "author"], "left_anti").select("mention").distinct()
        lacking = checkpointed(open_.join(can, "mention", "left_anti").select("name", "paper", "mention"))
        first = lacking.groupBy("name").agg(F.min("paper").alias("paper"))
        seeds = checkpointed(lacking.join(first, ["name", "paper"], "left_semi").select("mention", F.col("mention").alias("author"), "paper", "name").distinct())
        if seeds.isEmpty():
            break
        made = seeds if made is None else made.unionByName(seeds)
        held = checkpointed(held.unionByName(seeds))
    else:
        raise RuntimeError(f"seeds were still missing after {max_rounds} rounds")
    return (made if made is not None else held.limit(0)).select("mention", "author")
