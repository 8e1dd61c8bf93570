from scholargraph.llm import licences
from pyspark.sql import functions as F


def test_only_the_vocabulary_of_a_line_becomes_rows(spark):
    """Of a line of a thousand words that names a licence, the scan makes a row for each gram of the vocabulary only."""
    line = " ".join(["MIT License the mit license", *(f"w{i}" for i in range(1000))])
    words = spark.createDataFrame([(1, line), (2, "w1"), (3, "license")], "k int, line string").withColumn("words", licences.words_of(F.col("line")))
    got = words.select("k", F.explode(licences.known_grams(F.col("words"), ["mit", "mit license", "license", "gpl"])).alias("g"))
    assert sorted((r.k, r.g) for r in got.collect()) == [(1, "license"), (1, "mit"), (1, "mit license"), (3, "license")]
