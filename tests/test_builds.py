"""Stored builds and schema contracts."""

import pytest
from pyspark.sql import functions as F

from scholargraph.operators import builds
from scholargraph.sources import contracts


def tables(spark, weight=1.0, twice=False):
    edges = [("CITES", "a", "b", weight), ("CITES", "b", "c", weight)] + [("CITES", "a", "b", 2.0)] * twice
    return {
        "nodes": spark.createDataFrame([("PAPER", k, "{}") for k in "abc"], "node_type string, node_key string, metrics string"),
        "edges": spark.createDataFrame(edges, "predicate string, source string, target string, weight double"),
        "clusters": spark.createDataFrame([(0, 3)], "cluster_id long, size long"), "members": spark.createDataFrame([(0, k) for k in "abc"], "cluster_id long, node_key string")}


def test_visible_together(spark, tmp_path):
    """A rerun replaces, a failed attempt leaves the one before in force, and nothing of it shows."""
    store = str(tmp_path)
    assert builds.visible(spark, store, "graph") is None
    builds.store_build(spark, store, "graph", "r1", lambda: tables(spark))
    builds.store_build(spark, store, "graph", "r1", lambda: tables(spark, 3.0))
    seen = lambda: {(r.name, r.kind): (r.n, r.weight) for r in builds.counts(builds.visible(spark, store, "graph")).collect()}
    assert seen() == {("nodes", "PAPER"): (3, None), ("edges", "CITES"): (2, 6.0), ("members", "PAPER"): (3, None)}
    with pytest.raises(ValueError):  # a repeated key
        builds.store_build(spark, store, "graph", "r2", lambda: tables(spark, 5.0, twice=True))

    def broken():
        made = tables(spark, 7.0)
        made["members"] = made["members"].withColumn("node_key", F.raise_error(F.lit("lost")))
        return made

    with pytest.raises(Exception, match="lost"):
        builds.store_build(spark, store, "graph", "r3", broken)
    assert seen()[("edges", "CITES")] == (2, 6.0)
    assert sorted((r.run, r.status) for r in builds.ledger(spark, store).collect()) == [("r1", "COMPLETED"), ("r1", "COMPLETED"), ("r2", "FAILED"), ("r3", "FAILED")]
    builds.store_build(spark, store, "graph", "r2", lambda: tables(spark, 5.0))
    assert seen()[("edges", "CITES")] == (2, 10.0)
    assert builds.counts(builds.visible(spark, store, "graph", "r1")).filter("name = 'edges'").first().weight == 6.0
    assert builds.visible(spark, store, "other") is None


def test_versions(spark):
    one = spark.createDataFrame([("W1", " A Title ", 1999)], "ut string, title string, pub_year int")
    two = spark.createDataFrame([("W1", "T", 1999, "t", "kept")], "ut string, title string, year int, normalized_title string, extra string")
    three = spark.createDataFrame([("W1", "T", 1999, "t", "API", 4)], "ut string, title string, year smallint, normalized_title string, origin string, batch int")
    c = contracts.RECORDS
    assert [c.version_of(df.schema) for df in (one, two, three)] == [1, 2, 3]
    assert [tuple(c.current(df).first()) for df in (one, two, three)] == [
        ("W1", " A Title ", 1999, "a title", "IMPORT", None), ("W1", "T", 1999, "t", "IMPORT", None, "kept"), ("W1", "T", 1999, "t", "API", 4)]
    assert c.current(three).schema["batch"].dataType.simpleString() == "bigint"
    for bad, stated in ((one.drop("title"), None), (one.withColumn("pub_year", F.lit("1999")), None), (one, 2), (one, 4), (two, 0)):
        with pytest.raises(contracts.UnknownSchema):
            c.current(bad, stated)
