"""Removal of lines that stand on many distinct sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph.operators.lineage import fresh, staged

SKETCH_LG_K = 12
#: Three standard errors of a sketch of 2**SKETCH_LG_K registers, rounded up.
SKETCH_ERROR = 0.06
#: Boilerplate lines that are broadcast are at most this many: each holds a larger share of all lines than one in HOT.
HOT = 10_000


def _keyed_lines(text: Column) -> Column:
    """array<struct<pos, key, words>>: a line's key is a 128-bit hash of its lower-case words."""
    norm = F.transform(F.split(text, "\n", -1), lambda l: F.trim(F.regexp_replace(F.lower(l), r"[\x20\x09-\x0D]+", " ")))
    return F.transform(
        norm,
        lambda l, i: F.struct(
            i.alias("pos"),
            F.xxhash64(l).alias("k1"),
            F.xxhash64(F.lit("second"), l).alias("k2"),
            F.when(l == "", 0).otherwise(F.length(l) - F.length(F.translate(l, " ", "")) + 1).alias("words"),
        ),
    )


def spread_lines(docs: DataFrame, min_sites: int = 8, min_words: int = 3) -> DataFrame:
    """(id, row, drop): the places (array<int>) of lines to remove, by document; `row` is a hash of the row.

    Every line of `min_words` words or more is hashed (1: every line that is not blank). Lines are first reduced to
    one row a hash and site, combined before the shuffle; HyperLogLog sketches of the sites (`source`) of each hash
    merge by aggregation over these. Hashes whose estimate is clearly above `min_sites` are boilerplate; those within
    the sketch's error of it are counted exactly. Of a boilerplate line, the first place (smallest doc_id, then
    position) stays, so that the text survives once.

    Boilerplate lines that hold more than 1 / HOT of all lines are at most HOT in number: they are broadcast, so that
    a line of very many documents is looked up where it stands. The others meet by shuffle.
    """
    lines = staged(
        docs.filter(F.col("text").isNotNull())
        .select(F.col("doc_id").alias("id"), _row(docs).alias("row"), F.col("source").alias("site"), F.explode(_keyed_lines(F.col("text"))).alias("l"))
        .filter(F.col("l.words") >= min_words)
        .select("id", "row", "site", "l.pos", "l.k1", "l.k2"),
        "lines",
    )
    total = lines.count()
    sites = staged(
        lines.groupBy("k1", "k2", "site").agg(F.min(F.struct("id", "row", "pos")).alias("first"), F.count(F.lit(1)).alias("n")), "sites")
    band = max(2.0, SKETCH_ERROR * min_sites)
    sketched = sites.groupBy("k1", "k2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(F.col("site"), F.lit(SKETCH_LG_K))).alias("sites"), F.min("first").alias("first"), F.sum("n").alias("n"))
    likely = staged(sketched.filter(F.col("sites") >= min_sites - band), "likely")
    near = likely.filter(F.col("sites") <= min_sites + band).select("k1", "k2")
    exact = sites.filter("site is not null").join(near, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("exact_sites"))
    # A line near the threshold that no site has at all has no exact count, and no estimate either.
    boiler = staged(
        likely.join(exact, ["k1", "k2"], "left").filter(F.coalesce(F.col("exact_sites"), F.col("sites")) >= min_sites).select("k1", "k2", "first", "n"), "spread")
    hot = F.broadcast(boiler.filter(F.col("n") * HOT > total).drop("n"))
    other = boiler.filter(F.col("n") * HOT <= total).drop("n")
    places = lines.join(hot, ["k1", "k2"]).unionByName(lines.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti").join(other, ["k1", "k2"]))
    return places.filter(~F.struct("id", "row", "pos").eqNullSafe(F.col("first"))).groupBy("id", "row").agg(F.collect_set("pos").alias("drop"))


def _row(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["source"], docs["text"])


def remove_spread_lines(docs: DataFrame, min_sites: int = 8, min_words: int = 3, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The documents' own columns, whatever their names, with boilerplate lines taken out of `text`, and the numbers
    of lines and of removed lines under the names `counts`, which may not be columns already.

    Null text stays null (no lines); a null source is no site and never adds to a line's spread, though a line on
    `min_sites` other sites is removed there too. Null doc_ids come before others in the order of places. Fully
    repeated rows share one identity and are treated alike: where theirs is the first place, it stays in each. Texts
    of any length are split whole. Empty tables give no rows. `n_chars`, where present, is set to the new length.
    """
    if {c.lower() for c in counts} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the columns {counts} are there already; name others for the counts")
    key, id_, row, drop = fresh(docs, "key", "id", "row", "drop")
    places = spread_lines(docs, min_sites, min_words).select(F.col("id").alias(id_), F.col("row").alias(row), F.col("drop").alias(drop))
    keyed = docs.withColumn(key, _row(docs))
    lines = F.split(F.col("text"), "\n", -1)
    dropped = F.coalesce(F.col(drop), F.array().cast("array<int>"))
    left = F.when(F.size(dropped) == 0, F.col("text")).otherwise(F.array_join(F.filter(lines, lambda l, i: ~F.array_contains(dropped, i)), "\n"))
    own = {"text": left.alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.size(dropped) > 0, F.length(left).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return keyed.join(places, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(row)), "left").select(
        *[own.get(c, F.col(f"`{c}`")) for c in docs.columns], F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(counts[0]),
        F.size(dropped).cast("long").alias(counts[1]))
