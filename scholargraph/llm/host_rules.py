"""Document rules, and the verdict that a host earns from how often its documents fail them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph.operators.lineage import checkpointed

SPACES = " \t\n\u000b\u000c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def split_words(text: Column) -> Column:
    """Runs of anything but space and the control characters 0x09-0x0D."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _tail(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def _head(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def rule_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The base counts of each text, in one pass and without leaving the row.

    Repeated three-word windows are found by sorting (hash, position) pairs of the row's own windows: equal
    neighbours are repeats, and the gaps between the sorted positions say how many words they cover. Each step
    uses arrays that an earlier projection has computed, never one word against all others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        *keep,
        split_words(text).alias("words"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        F.filter(F.split(text, "\n", -1), lambda l: F.translate(l, SPACES, "") != "").alias("lines"),
    )
    counted = base.select(
        *keep, "n_symbols", "word_chars", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.zip_with(_head(F.col("words")), _tail(F.col("words")), lambda a, b: F.xxhash64(a, b)).alias("pairs"),
    )
    windows = counted.select(
        *keep, "n_symbols", "word_chars", "n_words", "n_dup_lines",
        F.zip_with(_head(F.col("pairs")), _tail(F.col("pairs")), lambda a, b: F.xxhash64(a, b)).alias("hashes"),
    )
    placed = windows.withColumn(
        "sorted", F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    # Position pairs of equal neighbours; -1 where neighbours differ.
    twins = placed.withColumn(
        "twins",
        F.flatten(
            F.zip_with(
                _head(F.col("sorted")), _tail(F.col("sorted")),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
            )
        ),
    )
    at = twins.withColumn("at", F.sort_array(F.array_distinct("twins")))
    covered = F.aggregate(
        F.zip_with(_head(F.col("at")), _tail(F.col("at")), lambda a, b: F.least(F.lit(3), b - a).cast("long")),
        F.when(F.size("at") > 0, F.lit(3)).otherwise(F.lit(0)).cast("long"),
        lambda s, x: s + x,
    )
    return at.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_rates(failures: DataFrame) -> DataFrame:
    """(host, failed) rows -> one row a host with its shrunken failure rate.

    The prior is a beta distribution fitted by moments over all hosts: its mean is the overall rate, its weight
    the one at which the spread of the hosts' rates, less what sampling alone explains, comes out. Hosts with few
    documents are pulled to the overall rate; large hosts keep their own. The weight stays within 2 and 1e6.
    """
    hosts = failures.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed_docs")
    )
    hosts = checkpointed(hosts)
    mean = F.sum("host_failed_docs") / F.sum("host_docs")
    total = hosts.agg(F.sum("host_docs").alias("n"), F.count(F.lit(1)).alias("hosts"), mean.alias("m")).first()
    n, m = total["n"] or 0, total["m"] or 0.0
    weight = 1e6
    if n and 0.0 < m < 1.0:
        rate = F.col("host_failed_docs") / F.col("host_docs")
        spread = hosts.agg((F.sum(F.col("host_docs") * (rate - F.lit(m)) * (rate - F.lit(m))) / F.lit(n)).alias("v")).first()["v"]
        between = spread - m * (1 - m) * total["hosts"] / n
        if between > 0:
            weight = min(max(m * (1 - m) / between - 1, 2.0), 1e6)
    shrunk = (F.col("host_failed_docs") + F.lit(weight * m)) / (F.col("host_docs") + F.lit(weight))
    return hosts.select("host", "host_docs", "host_failed_docs", shrunk.alias("host_rate"))


def judge_documents(docs: DataFrame, max_host_rate: float = 0.5) -> DataFrame:
    """Base rules per document, then the verdict of its host.

    A document is kept if it passes the base rules and the shrunken failure rate of its host (`source`) is at most
    `max_host_rate`. Result: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, host_rate. Null text has no words and fails; a null source has no host: host_rate is null and only the
    base rules decide. Repeated rows are judged alike, each counts for its host. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    stats = rule_statistics(docs.select("doc_id", "text", F.col("source").alias("host")), "doc_id", "host")
    # Narrow rows of fixed width, read twice below; the texts are read once.
    judged = checkpointed(stats.withColumn("base_failed", base_failed()))
    rates = host_rates(
        judged.filter("host is not null").select("host", F.col("base_failed").alias("failed"))
    ).select("host", "host_rate")
    # No hint: the number of hosts is not bounded. AQE broadcasts a measured small side and splits a hot host else.
    return judged.join(rates, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_host_rate)).alias("kept"),
        F.round("host_rate", 6).alias("host_rate"),
    )
