import random

from pyspark.sql import functions as F

from scholargraph.operators import evidence, runs


def pages(spark, docs):
    return spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc string, page int, text string")


def test_reference_sections(spark):
    listed = "\n".join(f"[{i}] A. Author, Title {i}, 200{i % 10}" for i in range(1, 10))
    docs = {
        "headed": ["Intro", "References are discussed", "Body", "x\nReferences\n" + listed],
        "early": ["References\n" + listed, "Body", "Body", "Body"],
        "tail": ["Intro", "Body", "Body", "Body", listed],
        "none": ["Intro", "Body"],
    }
    got = {r.doc: r for r in evidence.reference_sections(pages(spark, docs)).collect()}
    assert set(got) == {"headed", "tail"}
    assert (got["headed"].heading, got["headed"].start_page, len(got["headed"].entries)) == ("References", 3, 9)
    assert got["tail"].method == "implicit-numbered-punctuated" and got["tail"].heading == ""


def test_preference(spark):
    kind = "doc string, start_page int, heading string, method string, confidence string, entries array<struct<ordinal:int,raw:string>>"
    cited, prose = [(i, f"A. Author {i}, J. Test") for i in range(3)], [(i, "energy rose by 5") for i in range(9)]
    a = spark.createDataFrame([("d", 1, "", "x", "HIGH", prose), ("e", 1, "References", "x", "HIGH", cited)], kind)
    b = spark.createDataFrame([("d", 1, "", "y", "HIGH", cited), ("e", 1, "", "y", "HIGH", cited)], kind)
    assert {r.doc: r.method for r in evidence.prefer_section(a, b).collect()} == {"d": "y", "e": "x"}


def test_names_and_markers(spark):
    m = spark.createDataFrame([(1, 10, "ann", "lee"), (1, 11, "bo", "kim"), (1, 12, "jo", "li")], "paper int, mention int, given string, family string")
    t = spark.createDataFrame([(1, "written by ann lee and kim, bo; joli too")], "paper int, text string")
    assert sorted(r.mention for r in evidence.names_in_text(m, t).collect()) == [10, 11]
    odd = spark.createDataFrame([(1, 10, r"a\E", "(lee")], "paper int, mention int, given string, family string")
    assert evidence.names_in_text(odd, spark.createDataFrame([(1, r"by a\E (lee.")], "paper int, text string")).count() == 1
    rows = [("Alice Smith", "Alice Smith and Bob Jones*", "*", False), ("Bob Jones", "Alice Smith and Bob  Jones 1,*", "*", True), ("Bob Jones", "Bob Jones (a)", "a)", True), ("", "x*", "*", False),
            ("Bob Jones", "Bob Jones A", "(a)", True), ("A.B. (Q", "a.b.  (q *", "*", True), (r"A\Ec", r"a\ec*", "*", True), ("Bob Jones", "Bob Jones " + "1" * 40 + "*", "*", False), (None, "x*", "*", False)]
    df = spark.createDataFrame(rows, "n string, t string, m string, want boolean")
    assert df.filter(evidence.has_adjacent_marker("n", "t", "m") != F.col("want")).count() == 0


def test_email_owner_must_be_single(spark):
    m = spark.createDataFrame([(1, 1, "ann", "leeds"), (1, 2, "bob", "leeds"), (1, 3, "cy", "stone")], "paper int, mention int, given string, family string")
    e = spark.createDataFrame([(1, "a.leeds@x.org"), (1, "leeds@x.org"), (1, "c.stone@x.org"), (1, "info@x.org")], "paper int, email string")
    assert {r.email: r.mention for r in evidence.email_owners(m, e).collect()} == {"c.stone@x.org": 3}


def test_closure(spark):
    m = spark.createDataFrame([("n", 1, 0, 10), ("n", 1, 1, 11), ("n", 2, 0, 20), ("k", 2, 1, 21)], "name string, paper int, position int, mention int")
    none = spark.createDataFrame([], "mention int, author int, paper int, name string")
    assert sorted(r.mention for r in evidence.closure_seeds(m, none, none.select("mention", "author")).collect()) == [10, 11, 21]
    blocked = spark.createDataFrame([(20, 10), (20, 11)], "mention int, author int")
    assert sorted(r.mention for r in evidence.closure_seeds(m, none, blocked).collect()) == [10, 11, 20, 21]


def test_compatible_names(spark):
    rows = [("Ann Lee", "A. Lee", True), ("Lee Ann", "Ann Lee", True), ("Ann Lee", "Bo Lee", False), ("A B", "A. B.", False), ("", "Ann", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.filter(evidence.compatible_person_names("a", "b") != F.col("want")).count() == 0


def test_name_pairs_are_all_pairs(spark):
    """As many as a comparison of all with all finds, and few are compared where only common parts are shared."""
    rnd = random.Random(2)
    parts = ["ann", "A.", "bo", "B.", "lee", "L.", "Lee", "ann ann", "Zoë", "z", "N1", "n2", "n"]
    rows = [(rnd.randrange(2), i, " ".join(rnd.choice(parts) for _ in range(rnd.randrange(5)))) for i in range(150)]
    a, b = spark.createDataFrame(rows, "g int, left_id int, a string"), spark.createDataFrame(rows[::-1], "g int, right_id int, b string")
    want = sorted((r.left_id, r.right_id) for r in a.join(b, "g").filter(evidence.compatible_person_names("a", "b")).collect())
    assert want and sorted((r.left_id, r.right_id) for r in evidence.name_pairs(a, b, "g").collect()) == want
    many = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("left_id"), F.concat(F.lit("Ann N"), F.col("id") + 10, F.lit(" Lee")).alias("a"))
    other = many.select("g", F.col("left_id").alias("right_id"), F.regexp_replace("a", "^Ann", "A.").alias("b"))
    assert evidence.name_pairs(many, other, "g").filter("left_id = right_id").count() == 20_000


def test_merges_are_guarded(spark):
    authors = spark.createDataFrame([(i,) for i in range(1, 6)], "author int")
    merges = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "left int, right int")
    papers = spark.createDataFrame([(4, 9), (5, 9)], "author int, paper int")
    assert {r.author: r.canonical for r in evidence.apply_merges(authors, merges, papers).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_runs(spark, tmp_path):
    store = str(tmp_path)
    for run in ("r1", "r2", "r2"):
        runs.write_run(spark, store, run, "citations", {"nodes": spark.range(3)}, {"records": 3})
    manifest = spark.read.parquet(f"{store}/manifest")
    assert manifest.count() == 2 and spark.read.parquet(f"{store}/nodes").count() == 6
    assert runs.latest(manifest).first().run == "r2"
    facts = spark.createDataFrame([(3, 4)], "records int, last int")
    assert runs.stale(facts, facts, ["records", "last"]).first().stale is False
    assert runs.stale(facts, facts.withColumn("last", F.lit(5)), ["records", "last"]).first().stale is True
    assert runs.stale(facts.limit(0), facts, ["records", "last"]).first().stale is None
