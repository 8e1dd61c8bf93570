"""The pipeline on small tables: every stage against a plain version of what it is to do with its own input."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from test_near_copies import brute as near_groups  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    good = [" ".join(words(80)) + "." for _ in range(60)]
    good[5] = good[4]
    good[7] = " ".join([*good[6].split()[:-2], "other", "end."])
    bench = " ".join(words(30))
    good[9] += " " + bench
    good = [f"shared line of many sites\n{t}" if i % 3 == 0 else t for i, t in enumerate(good)]
    bad = [" ".join(w + "$$$" for w in words(60)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 13}", len(t)) for i, t in enumerate([*good, *bad])] + [(500, None, "en", None, None), (501, "", "en", "s1", 0), (None, good[20], "en", "s2", len(good[20]))]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_lines", F.lit("clash")).withColumn("__keep", F.lit(1))
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns, step = docs.columns, 0

    def apply(name):
        nonlocal docs, step
        out = stages[name](spark, docs, tables)
        assert out.columns == columns
        before, step = rows_of(docs), step + 1
        out.write.parquet(f"{tables}/step{step}")
        docs = spark.read.parquet(f"{tables}/step{step}")
        return before, rows_of(docs)

    before, after = apply("quality_classifier")
    assert {d for d, _ in after} - {None, 500, 501} == set(range(60)) and set(after) <= set(before)
    before, after = apply("line_dedup")
    line, first = "shared line of many sites", min((d is not None, d or 0) for d, t in before if t and t.startswith("shared"))
    want = [(d, t if t is None or not t.startswith(line) or (d is not None, d or 0) == first else t[len(line) + 1 :]) for d, t in before]
    assert after == sorted(want, key=str)
    before, after = apply("near_dedup")
    ordered = sorted(before, key=lambda r: (r[0] is None, r[0] or 0))
    group = [g for _, g in near_groups([t for _, t in ordered])]
    assert after == sorted((r for i, r in enumerate(ordered) if group[i] == i), key=str)
    assert {5, 7}.isdisjoint({d for d, _ in after}) and {4, 6} <= {d for d, _ in after}
    before, after = apply("decontamination")
    hit = {d for d, *_, contaminated in brute.contamination(before, [(1, spark.read.parquet(f"{tables}/benchmark.parquet").filter("item_id = 1").first().text)]) if contaminated}
    assert hit == {9} and after == [r for r in before if r[0] not in hit]
    packed = stages["best_fit_packing"](spark, docs, tables).collect()
    assert sorted({r.doc_id for r in packed}, key=str) == sorted({d for d, _ in after}, key=str)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append(r)
    for of in sequences.values():
        of.sort(key=lambda r: r.offset)
        assert [r.offset for r in of] == [sum(x.length for x in of[:i]) for i in range(len(of))] and sum(r.length for r in of) <= 2048
    assert len(sequences) <= -(-sum(r.length for r in packed) // 2048) + 1


def test_stages_of_nothing(spark, tables):
    empty = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0, name
