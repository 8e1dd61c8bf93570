import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scholargraph.llm import near_copies, quality_fm
from scholargraph.llm.bitmaps import may_be_in
from scholargraph.llm.worker import small_batches


def test_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark, 10):
        got = [r.n for r in spark.range(0, 95, 1, 1).mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 95 and max(got) == 10
    assert spark.conf.get(name) == before


def test_filter_and_map_of_texts_are_not_one_task(spark):
    """Else a task has two Python workers at a time, however few classes are needed."""
    docs = spark.createDataFrame([(i, i, -i, f"text {i}") for i in range(9)], "doc_id long, t1 long, t2 long, text string")
    needed = docs.filter("doc_id > 6").select((F.col("doc_id") + 100).alias("c"), F.struct("doc_id", "t1", "t2").alias("row"))
    asked = docs.filter(may_be_in(needed.select(F.xxhash64("row.t1", "row.t2").alias("h")), F.xxhash64("t1", "t2"), 1 << 10))
    held = near_copies._held(asked, needed)
    assert sorted((r.c, r.text) for r in held.collect()) == [(107, "text 7"), (108, "text 8")]
    plan = held.mapInArrow(near_copies._sets, "c long, shingles array<long>")._jdf.queryExecution().executedPlan().toString()
    above, evaluated, _ = plan.partition("ArrowEvalPython")
    assert evaluated and re.search("MapInArrow", above) and "Exchange" in above.rpartition("MapInArrow")[2]


def test_training_rows_are_not_python_numbers_in_the_driver():
    import tracemalloc

    n, size = 400, 500
    ids = [list(range(i, i + size)) for i in range(n)]
    table = pa.table({"label": pa.array([i % 2 for i in range(n)], pa.int32()), "ids": pa.array(ids, pa.list_(pa.int32())), "vals": pa.array([[x / 7 for x in r] for r in ids], pa.list_(pa.float32()))})
    table = pa.concat_tables([table.slice(3, 150), table.slice(153)])  # batches that do not begin where their buffers do
    tracemalloc.start()
    got = quality_fm.trained_rows(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    plain = [(y, np.asarray(i, np.int32), np.asarray(v, np.float32)) for y, i, v in zip(*(table.column(c).to_pylist() for c in ("label", "ids", "vals")))]
    plain.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    assert len(got) == len(plain) == n - 3
    assert all(a[0] == b[0] and a[1].dtype == b[1].dtype and np.array_equal(a[1], b[1]) and np.array_equal(a[2], b[2]) for a, b in zip(got, plain))
    assert peak < 8 * n * size  # lists of numbers take over 60 bytes a place


def test_rounds_of_components_build_no_table_in_the_driver(spark, monkeypatch):
    """The links handed on are settled stars, and no join of a round is a broadcast."""
    from scholargraph.operators import components

    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(components, "checkpointed", seen)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 9), (8, 9)], "a long, b long")
    pairs = spark.createDataFrame([(1, 4), (4, 9), (5, 6)], "a long, b long")
    apart, stars = near_copies._apart(pairs, links)
    assert sorted(map(tuple, apart.collect())) == [(4, 9), (5, 6)]
    assert sorted(map(tuple, stars.select("a", "b").collect())) == [(1, 2), (1, 3), (1, 4), (7, 8), (7, 9)]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
