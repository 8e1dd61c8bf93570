"""Candidates of mentions stay with their paper: what is dealt by paper is not dealt again."""

from pyspark.sql import functions as F

from scholargraph.operators import resolve
from scholargraph.plans import resolve_queries

SF = "/root/testdata/sf0.001"


def exchanges(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line and "BroadcastExchange" not in line]


def test_plan_of_pairs_by_paper(spark):
    rows = [(m, m // 3, a, s, True) for m in range(9) for a, s in ((1, 0.9), (2, 0.5))]
    df = spark.createDataFrame(rows, "mention_id long, paper_id long, author_id long, score double, eligible boolean").repartition("paper_id")
    plan = resolve.identity_plan(df)
    assert len(exchanges(plan)) == 1
    assert {r.decision for r in plan.collect()} == {"REVIEW_COLLISION"}


def test_parts_are_not_asked_once_a_pair(spark):
    """Of a paper and a family, each part is asked once: rows of mentions and authors are never multiplied by parts."""
    scored = resolve_queries._scored(spark, SF)
    by = exchanges(scored)
    assert not [x for x in by if "author_id" in x and "hashpartitioning(paper_id" not in x]
    assert len([x for x in by if "mention_id" in x]) == 0


def test_frozen_decisions(spark):
    scored = spark.createDataFrame([
        (11, 1, 5, 3, 0.2, False), (11, 1, 5, 4, 0.6, True), (11, 1, 5, 8, 0.3, False), (11, 1, 5, 7, 0.3, False), (12, 1, 6, 8, 0.9, True), (21, 2, 5, 3, 0.1, False), (22, 2, 6, 9, 0.4, False)],
        "mention_id long, paper_id long, creator long, author_id long, score double, eligible boolean").repartition("paper_id")
    accepted = spark.createDataFrame([(12, 1, 6, 8), (31, 3, 5, 3)], "mention_id long, paper_id long, creator long, author_id long")
    merges = spark.createDataFrame([(1, 3, 4, "MANUAL")], "seq long, author_id long, into long, actor string")
    barred = spark.createDataFrame([(11, 1, 7), (22, 1, 9)], "mention_id long, paper_id long, author_id long")
    out = resolve.inherited_candidates(scored, accepted, merges, barred)
    assert {tuple(r) for r in out.collect()} == {(11, 1, 4, 0.6, True, True), (21, 2, 4, 0.1, True, True), (22, 2, 9, 0.4, False, False)}
    assert not [x for x in exchanges(out) if "hashpartitioning(mention_id" in x]
    assert out.filter(F.col("author_id") == 3).count() == 0


def test_references_of_one_kind_are_not_paired(spark, tmp_path):
    """Copies of parts and lines under other keys add rows, but no pairs beyond those of their kinds."""
    copies = 24
    for t, keys in (("part", {"p_partkey": 1200}), ("lineitem", {"l_orderkey": 300, "l_partkey": 1200, "l_suppkey": 12})):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        df = df.filter(F.col("p_partkey" if t == "part" else "l_orderkey") < (200 if t == "part" else 100)).crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))
        for k, step in keys.items():
            df = df.withColumn(k, F.col(k) + F.col("copy") * step)
        df.drop("copy").write.parquet(f"{tmp_path}/{t}.parquet")
    sent, decide = [], resolve.decide_references
    try:
        resolve.decide_references = lambda r, h, s: sent.append(s.count()) or decide(r, h, s)
        got = resolve_queries.reference_resolve(spark, str(tmp_path))
    finally:
        resolve.decide_references = decide
    assert 0 < sent[0] < got.count()
    assert {r.candidate_count % copies for r in got.filter("match_type = 'AUTHOR_YEAR_JOURNAL'").collect()} == {0}
