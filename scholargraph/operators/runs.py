"""Analysis runs: derived nodes and edges by run, a manifest that makes them visible, and what is asked of them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_run(spark: SparkSession, store: str, run_id: str, kind: str, tables: dict[str, DataFrame], fingerprint: dict[str, int]) -> None:
    """Writes every table under its run, then the manifest row: a run without one never happened. Writing the same
    run again replaces it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{store}/{name}/run={run_id}")
    row = (run_id, kind, "COMPLETED", sorted(fingerprint.items()))
    spark.createDataFrame([row], "run string, kind string, status string, fingerprint array<struct<k:string,v:long>>").withColumn(
        "finished_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{store}/manifest/run={run_id}")


_LEDGER = "run string, kind string, status string, step int, error string"


def _note(spark: SparkSession, store: str, run_id: str, kind: str, status: str, step: int, error: str | None = None) -> None:
    row = spark.createDataFrame([(run_id, kind, status, step, error)], _LEDGER).withColumn("at", F.current_timestamp())
    row.write.mode("append").parquet(f"{store}/ledger")


def begin(spark: SparkSession, store: str, run_id: str, kind: str) -> None:
    """Notes a run as RUNNING; a run of that name that is not FAILED is an error."""
    try:
        known = states(spark.read.parquet(f"{store}/ledger")).filter((F.col("run") == run_id) & (F.col("status") != "FAILED")).first()
    except AnalysisException:  # no ledger yet
        known = None
    if known is not None:
        raise ValueError(f"run {run_id} is {known['status']}")
    _note(spark, store, run_id, kind, "RUNNING", 0)


def complete(spark: SparkSession, store: str, run_id: str, kind: str) -> None:
    _note(spark, store, run_id, kind, "COMPLETED", 1)


def fail(spark: SparkSession, store: str, run_id: str, kind: str, error: Exception) -> None:
    _note(spark, store, run_id, kind, "FAILED", 1, f"{type(error).__name__}: {error}"[:2000])


def states(ledger: DataFrame) -> DataFrame:
    """run, kind, status, error, at: where each run of ledger(run, kind, status, step, error, at) stands; what is
    noted later counts, of one moment the later step."""
    last = F.max_by(F.struct("kind", "status", "error", "at"), F.struct("at", "step", "status"))
    return ledger.groupBy("run").agg(last.alias("s")).select("run", "s.*")


def current(spark: SparkSession, store: str, table: str, kind: str) -> DataFrame | None:
    """The table of the last completed run of a kind; None if there is none."""
    done = states(spark.read.parquet(f"{store}/ledger")).filter((F.col("kind") == kind) & (F.col("status") == "COMPLETED")).orderBy(F.desc("at"), F.desc("run")).first()
    return None if done is None else spark.read.parquet(f"{store}/{table}/run={done['run']}")


def latest(runs: DataFrame, by: str = "kind", order: str = "finished_at", key: str = "run") -> DataFrame:
    """The last completed run of each kind; ties go to the larger key."""
    done = runs.filter(F.col("status") == "COMPLETED")
    return done.groupBy(by).agg(F.max_by(key, F.struct(order, key)).alias(key), F.count(F.lit(1)).alias("completed"))


def stale(stored: DataFrame, now: DataFrame, facts: list[str]) -> DataFrame:
    """stale: null if nothing was stored, else whether any fact of the corpus differs from the stored ones."""
    s = stored.select(*[F.col(c).alias(f"s_{c}") for c in facts], F.lit(True).alias("known"))
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return now.join(F.broadcast(s.limit(1)), F.lit(True), "left").select(F.when(F.col("known"), ~same).alias("stale"))


def edge_statistics(edges: DataFrame) -> DataFrame:
    """predicate, edges, nodes, weight bounds of edges(predicate, src, dst, weight)."""
    ends = edges.select("predicate", F.explode(F.array("src", "dst")).alias("ut")).groupBy("predicate").agg(F.count_distinct("ut").alias("nodes"))
    return edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("edges"), F.min("weight").alias("least"), F.max("weight").alias("most")).join(ends, "predicate")


def nearest_rank(values: DataFrame, by: str, value: str, fractions: list[float]) -> DataFrame:
    """by, fraction, value at position round-half-even((n - 1) * fraction) of the sorted values, ties by value."""
    w = Window.partitionBy(by)
    ranked = values.filter(F.col(value).isNotNull()).withColumn("i", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    wanted: Column = F.explode(F.lit(fractions))
    return ranked.select(by, value, "i", "n", wanted.alias("fraction")).filter(F.col("i") == F.bround((F.col("n") - 1) * F.col("fraction"), 0).cast("long")).select(by, "fraction", F.col(value).alias("value"))
