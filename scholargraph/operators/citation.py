"""Completeness-aware citation analytics: pairs, degrees, frontier and reference-year spectroscopy.

Missing evidence is not negative evidence: a similarity that needs whole reference lists is null unless both lists
are known to be complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.operators.lineage import checkpointed

COMPLETE = ("COMPLETE", "COMPLETE_ZERO")
#: Values of one key that meet all others of it in one task.
SLICE = 1000


def is_complete(status: str = "cr_status"):
    return F.col(status).isin(*COMPLETE)


def _pairs_within(rows: DataFrame, key: str, value: str, extra: list[str]) -> DataFrame:
    """(src, dst, *extra of src): pairs src < dst of the values of one key; rows(key, value, n, ...) with n its size.

    A key of very many values is cut into slices of about SLICE of them; each slice meets all values of the key in a
    task of its own, so one hot key does not land in one task.
    """
    slices = F.ceil(F.col("n") / SLICE)
    a = rows.select(F.col(key).alias("k"), F.pmod(F.xxhash64(value), slices).alias("slice"), F.col(value).alias("src"), *extra)
    b = rows.select(F.col(key).alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"), F.col(value).alias("dst"))
    return a.join(b, ["k", "slice"]).filter("src < dst").select("src", "dst", *extra)


def _pairs_of(seed, rows: DataFrame, key: str, value: str, extra: list[str]) -> DataFrame:
    """(src, dst, *extra): the pairs of `_pairs_within` that hold one value. Only the keys of that value are looked at."""
    own = rows.filter(F.col(value) == F.lit(seed)).select(key)
    others = rows.filter(F.col(value) != F.lit(seed)).join(own, key, "left_semi")
    return others.select(F.least(F.lit(seed), value).alias("src"), F.greatest(F.lit(seed), value).alias("dst"), *extra)


def bibliographic_coupling(references: DataFrame, papers: DataFrame, min_shared: int = 1, seed=None) -> DataFrame:
    """Pairs of papers that share at least `min_shared` references; of one paper only, if a `seed` is named.

    references(source_ut, ref_key), papers(ut, cr_status). A reference used by n papers adds 1 / max(1, n - 1) to a
    pair's fractional weight. Jaccard and cosine are null unless both lists are complete. The distinct references are
    computed once; references of one paper, which make no pair, leave before the self-join.
    """
    refs = checkpointed(references.select("source_ut", "ref_key").distinct())
    uses = refs.groupBy("ref_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and ref_key is not null")
    sizes = refs.groupBy("source_ut").agg(F.count(F.lit(1)).alias("size"))
    known = papers.select("ut", is_complete().alias("complete")).join(sizes, F.col("ut") == F.col("source_ut"), "left").select(
        "ut", "complete", F.coalesce("size", F.lit(0)).alias("size"))
    shared = refs.join(uses, "ref_key").withColumn("w", 1 / (F.col("n") - 1))
    met = _pairs_within(checkpointed(shared), "ref_key", "source_ut", ["w"]) if seed is None else _pairs_of(seed, shared, "ref_key", "source_ut", ["w"])
    pairs = (
        met.groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("shared"), F.sum("w").alias("fractional"))
        .filter(F.col("shared") >= min_shared)
    )
    left = known.select(F.col("ut").alias("src"), F.col("complete").alias("c1"), F.col("size").alias("n1"))
    right = known.select(F.col("ut").alias("dst"), F.col("complete").alias("c2"), F.col("size").alias("n2"))
    both = F.col("c1") & F.col("c2")
    return pairs.join(left, "src").join(right, "dst").select(
        F.col("src").alias("source_ut"), F.col("dst").alias("target_ut"), F.col("shared").alias("shared_reference_count"),
        F.round("fractional", 6).alias("fractional_weight"),
        F.when(both, F.round(F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared")), 6)).alias("jaccard"),
        F.when(both, F.round(F.col("shared") / F.sqrt(F.col("n1") * F.col("n2")), 6)).alias("cosine"),
        F.when(both, "COMPLETE_BOTH").otherwise("INCOMPLETE_INPUT").alias("quality_status"),
    )


def co_citation(references: DataFrame, papers: DataFrame, min_count: int = 1, seed=None) -> DataFrame:
    """Pairs of local targets cited together by at least `min_count` papers; of one target only, if a `seed` is named.

    references(source_ut, ref_key) hold resolved targets only. The normalised value is count / sqrt(in * in);
    support is counted apart for papers whose lists are complete.
    """
    refs = checkpointed(references.select("source_ut", "ref_key").distinct())
    cited = refs.groupBy("ref_key").agg(F.count(F.lit(1)).alias("n"))
    lists = refs.groupBy("source_ut").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(
        papers.select(F.col("ut").alias("source_ut"), is_complete().alias("complete")), "source_ut")
    listed = refs.join(lists, "source_ut")
    met = _pairs_within(listed, "source_ut", "ref_key", ["complete"]) if seed is None else _pairs_of(seed, listed, "source_ut", "ref_key", ["complete"])
    pairs = (
        met.groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("together"), F.count_if("complete").alias("complete_support"))
        .filter(F.col("together") >= min_count)
    )
    return (
        pairs.join(cited.select(F.col("ref_key").alias("src"), F.col("n").alias("n1")), "src")
        .join(cited.select(F.col("ref_key").alias("dst"), F.col("n").alias("n2")), "dst")
        .select(
            F.col("src").alias("source_ut"), F.col("dst").alias("target_ut"), F.col("together").alias("co_citation_count"),
            F.round(F.col("together") / F.sqrt(F.col("n1") * F.col("n2")), 6).alias("normalized_co_citation"),
            "complete_support", (F.col("together") - F.col("complete_support")).alias("incomplete_support"),
        )
    )


def reference_index(references: DataFrame) -> DataFrame:
    """ref_key -> number of papers, first paper that names it."""
    return references.groupBy("ref_key").agg(
        F.count_distinct("source_ut").alias("papers"), F.min(F.struct("source_ut", "position")).alias("f")
    ).select("ref_key", "papers", F.col("f.source_ut").alias("first_ut"), F.col("f.position").alias("first_position"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ut, in_degree, out_degree over edges(src, dst); nodes without edges have zeros."""
    ends = edges.select(F.col("src").alias("ut"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("ut"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = ends.groupBy("ut").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return nodes.select("ut").join(n, "ut", "left").select(
        "ut", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def frontier(references: DataFrame, local: DataFrame, limit: int = 100) -> DataFrame:
    """Cited works that the corpus lacks: citing papers, first year, most cited first."""
    return (
        references.join(local.select(F.col("ut").alias("ref_key")), "ref_key", "left_anti").groupBy("ref_key")
        .agg(F.count(F.lit(1)).alias("cited_count"), F.min("cited_year").alias("first_year"), F.min("source_ut").alias("first_source"))
        .orderBy(F.desc("cited_count"), "ref_key").limit(limit)
    )


def rpys(references: DataFrame, radius: int = 2) -> DataFrame:
    """year, reference_count, local_baseline, deviation.

    Every calendar year between the first and the last has a row; the baseline is the median of the counts of the
    years within `radius`, zeros included (also beyond the ends), the year itself not.
    """
    counts = references.filter(F.col("cited_year").isNotNull()).groupBy(F.col("cited_year").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    spine = counts.agg(F.min("year").alias("a"), F.max("year").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    around = spine.select("year", F.explode(F.lit([k for k in range(-radius, radius + 1) if k])).alias("k")).select(
        "year", (F.col("year") + F.col("k")).alias("near"))
    base = (
        around.join(counts.select(F.col("year").alias("near"), "n"), "near", "left").groupBy("year")
        .agg(F.median(F.coalesce("n", F.lit(0))).alias("local_baseline"))
    )
    return spine.join(counts, "year", "left").join(base, "year").select(
        "year", F.coalesce("n", F.lit(0)).alias("reference_count"), "local_baseline",
        (F.coalesce("n", F.lit(0)) - F.col("local_baseline")).alias("deviation"))


def rpys_peaks(references: DataFrame, radius: int = 2, top: int = 20, top_references: int = 10) -> DataFrame:
    """Positive deviations, largest first, each with its most cited references (one row a reference)."""
    ranked = (
        rpys(references, radius).filter("deviation > 0").orderBy(F.desc("deviation"), F.desc("reference_count"), "year").limit(top)
    )
    of_year = references.filter(F.col("cited_year").isNotNull()).groupBy(F.col("cited_year").alias("year"), "ref_key").agg(
        F.count(F.lit(1)).alias("cited_count"))
    w = Window.partitionBy("year").orderBy(F.desc("cited_count"), "ref_key")
    return (
        of_year.join(F.broadcast(ranked), "year").withColumn("rank", F.row_number().over(w).cast("long"))
        .filter(F.col("rank") <= top_references).select("year", "reference_count", "deviation", "rank", "ref_key", "cited_count")
    )
