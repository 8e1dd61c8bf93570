"""The toxicity scorer is fitted on all labelled rows, and texts are decoded once."""

from pyspark.sql import functions as F

from scholargraph.llm import toxicity
from scholargraph.llm.labelled import fold


def test_all_labelled_rows_are_fitted(spark, monkeypatch):
    n, seen = 14_000, []
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, "you idiot").otherwise("a table").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("toxic"))
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, features, pos, neg: seen.append((rows.count(), pos + neg)) or train(rows, features, pos, neg))
    got = toxicity.judge(docs, labels)
    own = labels.filter(fold("doc_id", toxicity.FOLDS) != toxicity.HELD_OUT).count()
    assert own > 10_000 and seen == [(own, own)]
    assert got.join(labels, "doc_id").filter("predicted <> toxic").count() == 0


def test_stored_words_are_those_of_the_texts(spark):
    texts = ["you 1d10t", "", None, "word word other"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r.doc_id: r for r in toxicity.restored(docs).collect()}
    assert sorted(stored) == [0, 1, 2, 3] and stored[1].words == stored[2].words == "" and len(stored[3].n) == 8
