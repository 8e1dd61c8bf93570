"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.operators.lineage import checkpointed


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(id, component): every node that has an edge, with the smallest id it can reach.

    Large-star and small-star steps alternate until the edges no longer change; every step is one aggregation (a
    minimum per node, combined before the shuffle) and one join, so a node with very many neighbours is neither
    collected nor expanded. The number of rounds grows with the logarithm of the node count. The joins are never
    broadcasts: each of these would be built in the driver, round after round.
    """
    now = (
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter("u <> v").distinct()
    )
    now = checkpointed(now)
    seen = _signature(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = checkpointed(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                          F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").filter("u <> v").distinct()
        )
        now = checkpointed(small)
        new = _signature(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct())
