"""Listings and lookups: filters as columns, availability by semi-join, totals of the whole selection, stable pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest page, and the metrics that a ranking may ask for.
PAGE = 200
METRICS = ("in_degree", "out_degree", "degree", "pagerank", "betweenness", "component_size")


def says(q: str | None, *columns: str) -> Column:
    """Whether any of the columns holds the query, whatever the case; a blank query holds everywhere. The query is
    plain text: signs of patterns mean themselves."""
    if not (q or "").strip():
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q.strip().lower())
    return found


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page of `rows` in `order` (1 to PAGE rows after `offset`), with the `total` of all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), PAGE)).join(F.broadcast(total))  # one row


def list_papers(papers: DataFrame, files: DataFrame, q: str | None = None, year: int | None = None, venue: str | None = None,
                pdf_available: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The page of papers(ut, title, doi, venue, year) that fit all filters, newest first: `q` in title, DOI or venue,
    the year, the venue whatever its case, and whether files(ut) lists one."""
    chosen = papers.filter(says(q, "title", "doi", "venue"))
    if year is not None:
        chosen = chosen.filter(F.col("year") == year)
    if venue:
        chosen = chosen.filter(F.lower(F.coalesce("venue", F.lit(""))) == venue.lower())
    if pdf_available is not None:
        chosen = chosen.join(files.select("ut"), "ut", "left_semi" if pdf_available else "left_anti")
    return page(chosen, [F.desc_nulls_last("year"), F.desc("ut")], limit, offset)


def list_authors(authors: DataFrame, variants: DataFrame, roles: DataFrame, q: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The page of authors(author, name) by name, with papers and first_papers of roles(author, paper, first): those
    whose name, or one of whose spellings variants(author, spelling), holds `q`."""
    chosen = authors
    if (q or "").strip():
        spelled = variants.filter(says(q, "spelling")).select("author", F.lit(True).alias("spelled")).distinct()
        chosen = authors.join(spelled, "author", "left").filter(says(q, "name") | F.col("spelled")).drop("spelled")
    n = roles.groupBy("author").agg(F.count_distinct("paper").alias("p"), F.count_distinct(F.when(F.col("first"), F.col("paper"))).alias("f"))
    full = chosen.join(n, "author", "left").select("author", "name", F.coalesce("p", F.lit(0)).alias("papers"), F.coalesce("f", F.lit(0)).alias("first_papers"))
    return page(full, [F.lower(F.coalesce("name", F.lit(""))), F.col("author")], limit, offset)


def search(q: str, papers: DataFrame, files: DataFrame, authors: DataFrame, variants: DataFrame, roles: DataFrame, limit: int = 20) -> dict[str, DataFrame]:
    """Papers and authors that fit one query."""
    return {"papers": list_papers(papers, files, q, limit=limit), "authors": list_authors(authors, variants, roles, q, limit=limit)}


def search_records(records: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], q: str, own: list[str], limit: int = 100) -> DataFrame:
    """Records (ut, year, ...) that hold `q` in a column `own` or in one of their `children` (name -> (rows with ut,
    columns)): one semi-join over the union of all hits, so no child multiplies another."""
    hits = records.filter(says(q, *own)).select("ut")
    for rows, columns in children.values():
        hits = hits.unionByName(rows.filter(says(q, *columns)).select("ut"))
    return records.join(hits.distinct(), "ut", "left_semi").orderBy(F.desc_nulls_last("year"), "ut").limit(min(max(1, limit), 500))


def find_by_doi(records: DataFrame, doi: str) -> DataFrame:
    return records.filter(F.col("doi") == doi.strip().lower())


def find_by_title(records: DataFrame, normalized_title: str) -> DataFrame:
    return records.filter(F.col("normalized_title") == normalized_title)


def node(nodes: DataFrame, run: str, key, node_type: str) -> DataFrame:
    return nodes.filter((F.col("run") == run) & (F.col("key") == F.lit(key)) & (F.col("node_type") == node_type))


def edges_for_node(edges: DataFrame, key, predicates: list[str] | None = None, limit: int = 500) -> DataFrame:
    """Edges that touch a node, heaviest first (no weight counts as 0), with the other end."""
    near = edges.filter((F.col("src") == F.lit(key)) | (F.col("dst") == F.lit(key)))
    if predicates:
        near = near.filter(F.col("predicate").isin(*predicates))
    other = F.when(F.col("src") == F.lit(key), F.col("dst")).otherwise(F.col("src"))
    return near.withColumn("other", other).orderBy(F.desc(F.coalesce("weight", F.lit(0.0))), "predicate", "src", "dst").limit(min(max(1, limit), 5000))


def edges_by_predicate(edges: DataFrame, predicate: str, limit: int = 500) -> DataFrame:
    return edges.filter(F.col("predicate") == predicate).orderBy(F.desc(F.coalesce("weight", F.lit(0.0))), "src", "dst").limit(min(max(1, limit), 5000))


def ranking(nodes: DataFrame, metric: str, limit: int = 100) -> DataFrame:
    """Nodes by one metric, largest first; a metric that is none of METRICS is an error."""
    if metric not in METRICS:
        raise ValueError(f"{metric!r} is no metric; choose one of {', '.join(METRICS)}")
    return nodes.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric), "ut").limit(min(max(1, limit), 500))


def without(rows: DataFrame, filed: DataFrame, key: str) -> DataFrame:
    """Rows that no row of `filed` names."""
    return rows.join(filed.select(key), key, "left_anti")


def collection_papers(members: DataFrame, papers: DataFrame, limit: int = 500) -> DataFrame:
    """collection, ut, order_index: papers once a collection, at their smallest place in it; by place, newest first."""
    once = members.groupBy("collection", "ut").agg(F.min("order_index").alias("order_index"))
    return once.join(papers.select("ut", "year"), "ut").orderBy("order_index", F.desc_nulls_last("year"), F.desc("ut"), "collection").limit(limit).select("collection", "ut", "order_index")


def detail(records: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Records with each of their children (name -> (rows with ut, sort columns)) as a sorted array of structs, empty
    where there are none."""
    out = records
    for name, (rows, order) in children.items():
        rest = [c for c in rows.columns if c != "ut" and c not in order]
        packed = rows.groupBy("ut").agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(packed, "ut", "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(packed.schema[name].dataType)))
    return out


def pdf_state(documents: DataFrame) -> DataFrame:
    """paper, document, available: the selected primary document of documents(paper, document, selected, available),
    else the first one present."""
    rank = F.struct(F.when(F.col("selected"), 0).when(F.col("available"), 1).otherwise(2).alias("r"), "document")
    return documents.groupBy("paper").agg(F.min_by(F.struct("document", "available"), rank).alias("d")).select("paper", "d.document", "d.available")
