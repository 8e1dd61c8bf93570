from pyspark.sql import functions as F

from scholargraph.operators import corpus, library, quality, resolve
from scholargraph.sources import tagged

EXPORT = """FN Export
VR 1.0
PT J
AU Lee, A
   Kim, B
AF Lee, Ann
   Kim, Bo
TI A study of
   things
SO J TEST
CR Doe J, 2001, J CHEM, V12, P34, DOI 10.1000/B.
   Roe R, 1999, PHYS REV, V5, P6
NR 2
PY 2010
DI 10.1000/A
DE alpha; Beta
RP Lee, A; Kim, B (corresponding author), Univ X, Town.
C1 [Lee, Ann; Kim, Bo] Univ X, Town; [Kim, Bo] Univ Y.
FU Agency [G1, G2]; Trust
UT REC:A
ER

PT J
AU Doe, J
TI Straße und Énergie
NR 0
UT REC:B
ER

PT J
TI No accession
ER
EF
"""


def test_tagged_reader(spark, tmp_path):
    for name, text in (("unix.txt", EXPORT), ("dos.txt", EXPORT.replace("\n", "\r\n"))):
        (tmp_path / name).write_bytes(text.encode("utf-8-sig"))
        raw = tagged.read_records(spark, str(tmp_path / name)).cache()
        skipped = tagged.count_skipped(raw).first()
        assert (skipped.records, skipped.skipped) == (3, 1)
        rows = {r.ut: r for r in tagged.interpret(raw).collect()}
        a = rows["REC:A"]
        assert a.title == "A study of things" and a.doi == "10.1000/a" and a.year == 2010 and a.cr_status == "COMPLETE"
        assert [(x.au_name, x.full_name) for x in a.authors] == [("Lee, A", "Lee, Ann"), ("Kim, B", "Kim, Bo")]
        first, second = (r.parsed for r in a.references)
        assert (first.author, first.year, first.source, first.volume, first.page, first.doi) == ("Doe J", 2001, "J CHEM", "12", "34", "10.1000/b")
        assert (second.source, second.volume, second.page, second.doi) == ("PHYS REV", "5", "6", None)
        assert a.keywords == ["alpha", "Beta"] and [g.names for g in a.correspondence] == [["Lee, A", "Kim, B"]]
        assert [x.names for x in a.addresses] == [["Lee, Ann", "Kim, Bo"], ["Kim, Bo"]]
        assert [(f.agency, f.grants) for f in a.funding] == [("Agency", ["G1", "G2"]), ("Trust", [])]
        b = rows["REC:B"]
        assert b.cr_status == "COMPLETE_ZERO" and b.normalized_title == "strasse und energie"


def test_missing_data_never_erases(spark):
    obs = spark.createDataFrame([("u", 1, "old", 3), ("u", 2, None, 9), ("v", 1, None, None)], "ut string, batch int, abstract string, n int")
    got = {r.ut: r for r in corpus.merge_scalars(obs, "ut", "batch", ["abstract"], ["n"]).collect()}
    assert got["u"].abstract == "old" and got["u"].max_n == 9 and got["u"].last_batch == 2 and got["v"].abstract is None


def test_reimport_changes_nothing(spark):
    once = [("s", "k1", 1, 0), ("s", "k2", 1, 1)]
    make = lambda rows: corpus.union_references(spark.createDataFrame(rows, "source_ut string, ref_key string, batch int, position int")).drop("batches")
    twice = once + [("s", "k2", 2, 0), ("s", "k1", 2, 1)]
    assert sorted(make(once).collect()) == sorted(make(twice).collect())


def test_status_rules(spark):
    obs = spark.createDataFrame([("a", "COMPLETE", 2), ("b", "COMPLETE", 3), ("c", "PARTIAL", 5), ("d", "COMPLETE_ZERO", 0), ("e", "MISSING", 4), ("e", "COMPLETE_ZERO", 0), ("f", "UNKNOWN", None)], "ut string, status string, reported int")
    counts = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "ut string, n int")
    got = {r.ut: r.status for r in corpus.completeness_status(obs, counts).collect()}
    assert got == {"a": "COMPLETE", "b": "MERGED", "c": "PARTIAL_OR_UNVERIFIED", "d": "COMPLETE_ZERO", "e": "MISSING_FROM_EXPORT", "f": "UNKNOWN"}


def test_ambiguous_target_is_not_forced(spark):
    refs = spark.createDataFrame([("s", "d1"), ("s", "d2")], "source_ut string, doi string")
    rec = spark.createDataFrame([("r1", "d1"), ("r2", "d2"), ("r3", "d2")], "ut string, doi string")
    assert {r.doi: r.target_ut for r in corpus.resolve_targets(refs, rec).collect()} == {"d1": "r1", "d2": None}


def test_scan_lifecycle(spark):
    before = spark.createDataFrame([(1, "t", False), (2, "t", False), (3, "t", False), (4, "t", True), (5, "t", True)], "k int, title string, gone boolean")
    now = spark.createDataFrame([(1, "t"), (2, "new"), (4, None), (6, "x")], "k int, title string")
    got = {r.k: (r.change, r.changed_dimensions) for r in library.scan_diff(before, now, "k", {"bib": ["title"]}, "gone").collect()}
    assert got == {1: ("UNCHANGED", ""), 2: ("MODIFIED", "bib"), 3: ("REMOVED", ""), 4: ("RESTORED", "bib"), 5: ("GONE", ""), 6: ("NEW", "")}


def test_tree(spark):
    nodes = spark.createDataFrame([("r", None, "root"), ("a", "r", "A"), ("x", "nowhere", "X"), ("y", "x", "Y"), ("p", "q", "P"), ("q", "p", "Q"), ("z", "z", "Z")], "node string, parent string, name string")
    assert {r.node: r.path for r in library.tree_paths(nodes).collect()} == {"r": "root", "a": "root/A"}
    assert {r.node: r.reason for r in library.tree_orphans(nodes.drop("name")).collect()} == {
        "x": "MISSING_PARENT", "y": "DISCONNECTED", "p": "PARENT_CYCLE", "q": "PARENT_CYCLE", "z": "PARENT_CYCLE"}
    members = spark.createDataFrame([("a", 1), ("r", 1), ("a", 2)], "node string, item int")
    got = {r.node: (r.direct_count, r.subtree_count) for r in library.subtree_counts(nodes.drop("name"), members).collect()}
    assert got["r"] == (1, 2) and got["a"] == (2, 2) and got["z"] == (0, 0)


def test_matching(spark):
    papers = spark.createDataFrame([(1, "d1", None, None, None), (2, None, "t2", 2000, None), (3, None, "none", None, None), (4, "dd", None, 2001, None), (5, None, "tt", None, None)], "paper_id long, doi string, title string, year int, venue string")
    rec = spark.createDataFrame([(10, "d1", "x", 1999, "v"), (11, None, "t2", 2000, "v"), (12, "dd", "y", 2001, "v"), (13, "dd", "z", 2002, "v"), (14, None, "tt", 1, "v"), (15, None, "tt", 2, "v")], "ut long, doi string, title string, year int, venue string")
    got = {r.paper_id: (r.state, r.ut, r.method) for r in corpus.match_papers(papers, rec).collect()}
    assert got == {1: ("MATCHED", 10, "DOI_EXACT"), 2: ("MATCHED", 11, "TITLE_EXACT"), 3: ("NOT_IN_LOCAL_CORPUS", None, None), 4: ("MATCHED", 12, "DOI_EXACT"), 5: ("AMBIGUOUS", None, None)}


def test_matching_makes_no_pairs_of_a_shared_title(spark):
    """A title of 20,000 papers and 20,000 records would make 400 million pairs; years that are missing fit any."""
    papers = spark.range(20_000).select(F.col("id").alias("paper_id"), F.lit(None).cast("string").alias("doi"), F.lit("t").alias("title"), F.when(F.col("id") % 4 > 0, 5 - F.col("id") % 4).cast("int").alias("year"), F.lit("V").alias("venue"))
    rec = spark.range(20_000).select(F.col("id").alias("ut"), F.lit(None).cast("string").alias("doi"), F.lit("t").alias("title"), F.when(F.col("id") == 7, 3).when(F.col("id") == 9, 2).otherwise(9).cast("int").alias("year"), F.when(F.col("id") == 9, "other").otherwise("v").alias("venue"))
    got = corpus.match_papers(papers, rec)
    assert {tuple(r) for r in got.groupBy(F.col("paper_id") % 4, "state", "ut", "method", "candidate_count").count().collect()} == {
        (0, "AMBIGUOUS", None, None, 20_000, 5000), (1, "AMBIGUOUS", None, None, 20_000, 5000), (2, "MATCHED", 7, "TITLE_YEAR_JOURNAL", 20_000, 5000), (3, "AMBIGUOUS", None, None, 20_000, 5000)}
    undated = spark.createDataFrame([(1, None, "t", None, "v")], "ut long, doi string, title string, year int, venue string")
    assert {tuple(r) for r in corpus.match_papers(papers, undated).select("state", "ut", "method").distinct().collect()} == {("MATCHED", 1, "TITLE_EXACT")}
    assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_without_evidence_are_no_candidates(spark):
    pairs = spark.createDataFrame([(1, 1, False, 0.1, True, False, False, False, False), (1, 2, True, 1.0, True, True, True, False, False)],
                                  "reference_id int, paper_id int, exact_title boolean, title_coverage double, year boolean, venue boolean, author boolean, volume boolean, page boolean")
    got = resolve.score_bibliographic(pairs).collect()
    assert [(r.paper_id, r.match_type, r.score) for r in got] == [(2, "TITLE_EXACT_NORMALIZED", 1.0)]


def test_similar_names(spark):
    v = spark.createDataFrame([(1, "zhang", "teng-shuo", "ts", "teng-shuo zhang"), (2, "zhang", "tengshuo", "t", "tengshuo zhang"), (3, "tengshuo", "zhang", "z", "zhang tengshuo"), (4, "other", "name", "n", "name other")],
                              "author_id int, family string, given string, initials string, normalized string")
    none = spark.createDataFrame([], "left_id int, right_id int")
    got = {(r.left_id, r.right_id): r.score for r in resolve.similar_pairs(v, spark.createDataFrame([], "author_id int, paper_id int"), none).collect()}
    assert got == {(1, 2): 0.85, (1, 3): 0.95, (2, 3): 0.95}
    together = spark.createDataFrame([(1, 7), (2, 7)], "author_id int, paper_id int")
    assert (1, 2) not in {(r.left_id, r.right_id) for r in resolve.similar_pairs(v, together, none).collect()}


def test_retraction_and_scores(spark):
    e = spark.createDataFrame([("c", "d1", "ACCEPTED"), ("c", "d2", "CANDIDATE"), ("k", "d3", "ACCEPTED")], "claim string, document string, status string")
    got = quality.retraction(e, spark.createDataFrame([("d1",)], "document string")).collect()
    assert [tuple(r) for r in got] == [("c", "ACCEPTED", "CANDIDATE", 1)]
    score, severity = quality.risk(F.array(F.lit("PDF_PARSE_ERROR"), F.lit("X"), F.lit("X")))
    assert tuple(spark.range(1).select(score, severity).first()) == (100, "P0")
