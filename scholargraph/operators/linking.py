"""Links inside and between records: children to authors by name, accepted links and what they point to, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.operators import listing


def link_by_name(children: DataFrame, authors: DataFrame) -> DataFrame:
    """ut, child, order_index: M:N links of children(ut, child, name) (addresses, correspondence groups) to
    authors(ut, order_index, name) of the same record and the same normalised name."""
    return children.filter("name <> ''").join(authors, ["ut", "name"]).select("ut", "child", "order_index").distinct()


def unique_matches(wanted: DataFrame, authors: DataFrame) -> DataFrame:
    """ut, wanted, order_index: names (ut, wanted, first, last) matched to authors(ut, order_index, first, last) of the
    same record: one whose full name is equal, else one whose last name is equal and whose first name begins alike
    either way. A name that fits several in the better of the two ways is matched to none."""
    a, b = F.col("a.first"), F.col("b.first")
    exact = a == b
    alike = (a != "") & (b != "") & (a.startswith(b) | b.startswith(a))
    both = wanted.alias("a").join(authors.alias("b"), (F.col("a.ut") == F.col("b.ut")) & (F.col("a.last") == F.col("b.last"))).filter(exact | alike)
    n = both.groupBy(F.col("a.ut").alias("ut"), "wanted").agg(
        F.count_if(exact).alias("same"), F.count(F.lit(1)).alias("near"), F.min(F.when(exact, F.col("order_index"))).alias("one"), F.min("order_index").alias("any"))
    pick = F.when(F.col("same") == 1, F.col("one")).when((F.col("same") == 0) & (F.col("near") == 1), F.col("any"))
    return n.withColumn("order_index", pick).filter("order_index is not null").select("ut", "wanted", "order_index")


def last_writer(values: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, value: of several values under one key the one written last; equal moments are decided by the value."""
    return values.groupBy(*keys).agg(F.max_by(value, F.struct(order, value)).alias(value))


def upsert_children(rows: DataFrame, keys: list[str], batch: str, columns: list[str]) -> DataFrame:
    """keys and columns of child rows (authors by place, identifiers by namespace and value): of each column what the
    last batch that says something says, so that a resolved author outlives an export that lacks it."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(batch))).alias(c) for c in columns])


def superseded_links(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """paper, ut, status of accepted links(paper, ut) after new decisions(paper, ut, state): a paper decided anew keeps
    its link if it is the same, and loses it (SUPERSEDED) otherwise; new matches are ACCEPTED."""
    now = decisions.filter("state = 'MATCHED'").select("paper", "ut")
    again = decisions.select("paper", F.lit(True).alias("again")).distinct()
    old = links.join(again, "paper", "left").join(now.withColumn("same", F.lit(True)), ["paper", "ut"], "left")
    kept = old.select("paper", "ut", F.when(F.col("again") & F.col("same").isNull(), "SUPERSEDED").otherwise("ACCEPTED").alias("status"))
    return kept.unionByName(now.join(links.select("paper", "ut"), ["paper", "ut"], "left_anti").withColumn("status", F.lit("ACCEPTED")))


def stale_links(links: DataFrame, records: DataFrame) -> DataFrame:
    """Accepted links whose record the corpus no longer has."""
    return links.filter("status = 'ACCEPTED'").join(records.select("ut"), "ut", "left_anti")


def paper_records(links: DataFrame) -> DataFrame:
    """paper, ut: the latest accepted link of each paper."""
    return links.filter("status = 'ACCEPTED'").groupBy("paper").agg(F.max_by("ut", "link").alias("ut"))


def corpus_states(papers: DataFrame, links: DataFrame, matches: DataFrame, records: DataFrame) -> DataFrame:
    """paper, state: IN_CORPUS (an accepted link to a record that is there), STALE_LINK (one to a record that is gone),
    else the stored match state (matches(paper, state)), else NOT_CHECKED."""
    linked = paper_records(links).join(records.select("ut", F.lit(True).alias("there")), "ut", "left")
    return papers.select("paper").join(linked, "paper", "left").join(matches, "paper", "left").select(
        "paper", F.when(F.col("there"), "IN_CORPUS").when(F.col("ut").isNotNull(), "STALE_LINK").otherwise(F.coalesce("state", F.lit("NOT_CHECKED"))).alias("state"))


def review_details(queue: DataFrame, mentions: DataFrame, authors: DataFrame, limit: int = 500) -> DataFrame:
    """Open items of queue(item, subject (text), candidate, priority, status) with the name and paper of the mention
    they are about, whether it is the paper's first, and the candidate's name; the most urgent first."""
    w = Window.partitionBy("paper").orderBy("position", "mention")
    m = mentions.withColumn("is_first", F.row_number().over(w) == 1).select(F.col("mention").cast("string").alias("subject"), F.col("name").alias("mention_name"), "paper", "is_first")
    a = authors.select(F.col("author").alias("candidate"), F.col("name").alias("candidate_name"))
    return queue.filter("status = 'OPEN'").join(m, "subject", "left").join(a, "candidate", "left").orderBy(F.desc("priority"), "item").limit(min(max(1, limit), 500)).select(
        "item", "subject", "candidate", "priority", "mention_name", "paper", "is_first", "candidate_name")


def active_items(items: DataFrame, deleted: DataFrame, excluded: list[str], include_deleted: bool = False) -> DataFrame:
    """items(item, item_type) that are bibliographic (no type of `excluded`), with `deleted`; deleted ones are left out
    unless asked for."""
    gone = deleted.select("item", F.lit(True).alias("deleted")).distinct()
    full = items.filter(~F.col("item_type").isin(*excluded)).join(gone, "item", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return full if include_deleted else full.filter(~F.col("deleted"))


def author_evidence(author, mentions: DataFrame, evidence: DataFrame, limit: int = 200) -> DataFrame:
    """Accepted and candidate evidence(mention, kind, status, span) of an author's mentions(mention, author, paper)."""
    own = mentions.filter(F.col("author") == F.lit(author))
    return own.join(evidence.filter(F.col("status").isin("ACCEPTED", "CANDIDATE")), "mention").orderBy("paper", "mention", "kind", "span").limit(limit).select("paper", "mention", "kind", "status", "span")


def surname_coverage(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """paper, coverage: the share of the surnames of mentions(paper, family), in search form and of two letters or
    more, that stand in texts(paper, text)."""
    names = mentions.filter(F.length("family") >= 2).select("paper", "family").distinct()
    return names.join(texts, "paper").groupBy("paper").agg((F.count_if(F.contains("text", "family")) / F.count(F.lit(1))).alias("coverage"))


def mismatched(stored: DataFrame, derived: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, stored, derived of projections that do not agree with what they are derived from."""
    both = stored.select(*keys, F.col(value).alias("stored")).join(derived.select(*keys, F.col(value).alias("derived")), keys, "full_outer")
    return both.filter(~F.col("stored").eqNullSafe(F.col("derived")))


def cited_papers(references: DataFrame, links: DataFrame, papers: DataFrame) -> DataFrame:
    """reference_id, paper_id, by: the local papers that references(reference_id, citing_paper_id, target, doi) cite.

    A reference cites a paper that links(target, paper_id) names, or whose DOI (papers(paper_id, doi)) it gives; a paper
    that both find is found by LINK. The citing paper itself is left out. Two equi-joins and a union stand for one join
    with OR, which would compare every reference with every paper.
    """
    by_link = references.filter("target IS NOT NULL").join(links.select("target", "paper_id").distinct(), "target").select("reference_id", "citing_paper_id", "paper_id", F.lit("LINK").alias("by"))
    by_doi = references.filter("doi IS NOT NULL").join(papers.filter("doi IS NOT NULL").select("doi", "paper_id").distinct(), "doi").select("reference_id", "citing_paper_id", "paper_id", F.lit("DOI").alias("by"))
    found = by_link.unionByName(by_doi).filter(~F.col("paper_id").eqNullSafe(F.col("citing_paper_id")))
    return found.groupBy("reference_id", "paper_id").agg(F.max("by").alias("by"))


def paper_details(states: DataFrame, links: DataFrame, records: DataFrame, corresponding: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One nested row a paper: its state in the corpus, the record of its link if that is there, the record's corresponding
    authors and its children.

    states(paper, state), links(paper, ut) are those in force, records(ut, ...); corresponding(ut, group, position, name)
    holds one author in several groups, of which the first by group and position counts; children as in listing.detail.
    Names are told apart without case. Papers without a record have empty arrays.
    """
    first = corresponding.filter("trim(name) <> ''").groupBy("ut", F.lower(F.trim("name")).alias("folded")).agg(F.min(F.struct("group", "position", "name")).alias("f"))
    authors = first.select("ut", "f.group", "f.position", "f.name")
    full = listing.detail(records, {"corresponding": (authors, ["group", "position", "name"])} | children)
    shown = links.join(full, "ut")
    out = states.join(shown, "paper", "left")
    arrays = {name: F.coalesce(name, F.array().cast(full.schema[name].dataType)) for name in ("corresponding", *children)}
    return out.withColumns(arrays)
