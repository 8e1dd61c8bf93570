"""Library state: scan diffs, listings, and trees of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.operators.lineage import checkpointed

#: Levels of a tree beyond which it is taken for a mistake.
MAX_DEPTH = 10_000


def scan_diff(before: DataFrame, now: DataFrame, key: str, dimensions: dict[str, list[str]], removed: str | None = None) -> DataFrame:
    """key, change, dimensions: NEW, MODIFIED, UNCHANGED, REMOVED, RESTORED or GONE, and what changed.

    A full outer join on the key; each dimension is compared null-safely over its columns. Rows of `before` with the
    flag `removed` were already gone: they are RESTORED if they come back, whatever else changed.
    """
    columns = [c for cs in dimensions.values() for c in cs]
    a = before.select(F.col(key).alias("k1"), *[F.col(c).alias(f"a_{c}") for c in columns], (F.col(removed) if removed else F.lit(False)).alias("was_removed"))
    b = now.select(F.col(key).alias("k2"), *[F.col(c).alias(f"b_{c}") for c in columns])
    differ = {name: ~F.array(*[F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in cs]).eqNullSafe(F.array(*[F.lit(True)] * len(cs))) for name, cs in dimensions.items()}
    changed = F.concat_ws("|", *[F.when(d, F.lit(n)) for n, d in sorted(differ.items())])
    both = a.join(b, F.col("k1") == F.col("k2"), "full_outer")
    return both.select(
        F.coalesce("k1", "k2").alias(key),
        F.when(F.col("k1").isNull(), "NEW").when(F.col("k2").isNull() & F.col("was_removed"), "GONE").when(F.col("k2").isNull(), "REMOVED")
        .when(F.col("was_removed"), "RESTORED").when(changed != "", "MODIFIED").otherwise("UNCHANGED").alias("change"),
        F.when(F.col("k1").isNotNull() & F.col("k2").isNotNull(), changed).otherwise("").alias("changed_dimensions"))


def _deeper(depth: int, max_depth: int) -> int:
    if depth >= max_depth:
        raise ValueError(f"the tree is deeper than {max_depth} levels")
    return depth + 1


def tree_closure(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """ancestor, node, depth over nodes(node, parent): every node with itself (depth 0) and all above it. A cycle
    ends where it would repeat a node. A tree deeper than `max_depth` is an error, never cut."""
    step = nodes.filter("parent is not null").select(F.col("node").alias("child"), "parent")
    level = nodes.select("node", F.col("node").alias("ancestor"), F.array("node").alias("path"))
    out, depth = level.select("ancestor", "node", F.lit(0).alias("depth")), 0
    while True:
        depth = _deeper(depth, max_depth)
        level = checkpointed(
            level.join(step, F.col("ancestor") == F.col("child")).filter(~F.array_contains("path", F.col("parent")))
            .select("node", F.col("parent").alias("ancestor"), F.concat("path", F.array("parent")).alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level.select("ancestor", "node", F.lit(depth).alias("depth")))
    return out


def subtree_counts(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node, direct_count, subtree_count: distinct items of members(node, item), in the node and in all below it."""
    direct = members.groupBy("node").agg(F.count_distinct("item").alias("d"))
    below = tree_closure(nodes).join(members, "node").groupBy(F.col("ancestor").alias("node")).agg(F.count_distinct("item").alias("s"))
    return nodes.select("node").join(direct, "node", "left").join(below, "node", "left").select(
        "node", F.coalesce("d", F.lit(0)).alias("direct_count"), F.coalesce("s", F.lit(0)).alias("subtree_count"))


def tree_paths(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """node, path (names from the root, joined by /), depth of nodes(node, parent, name) that hang from a root."""
    level = nodes.filter("parent is null").select("node", F.col("name").alias("path"))
    out, depth = level.withColumn("depth", F.lit(0)), 0
    kids = nodes.filter("parent is not null").select(F.col("node").alias("kid"), F.col("parent"), F.col("name").alias("kid_name"))
    while True:
        depth = _deeper(depth, max_depth)
        level = checkpointed(level.join(kids, F.col("node") == F.col("parent")).select(F.col("kid").alias("node"), F.concat("path", F.lit("/"), "kid_name").alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out


def tree_orphans(nodes: DataFrame) -> DataFrame:
    """node, reason of nodes that no root reaches: MISSING_PARENT, PARENT_CYCLE (on a cycle) or DISCONNECTED (below
    either)."""
    reached = checkpointed(tree_paths(nodes.withColumn("name", F.lit(""))).select("node"))
    lost = checkpointed(nodes.join(reached, "node", "left_anti"))
    ids = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    up = checkpointed(tree_closure(lost.select("node", "parent")))
    on_cycle = up.filter("depth > 0").join(lost.select(F.col("node").alias("ancestor"), F.col("parent").alias("up")), "ancestor").filter("up = node").select("node", F.lit(True).alias("cyclic")).distinct()
    self_loop = lost.filter("node = parent").select("node", F.lit(True).alias("cyclic"))
    cyclic = on_cycle.unionByName(self_loop).distinct()
    return lost.join(ids, "parent", "left").join(cyclic, "node", "left").select(
        "node", F.when(F.col("known").isNull(), "MISSING_PARENT").when(F.col("cyclic"), "PARENT_CYCLE").otherwise("DISCONNECTED").alias("reason"))
