"""The eight-record citation fixture with independently computed values."""

import random

import pytest
from pyspark.sql import functions as F

from scholargraph.operators import citation, graph

REFS = {  # source -> (reference key, cited year)
    "A": ["B", "X", "Y"], "B": ["C", "X", "Y"], "C": ["X"], "D": ["A", "B"], "P": ["X"],
}
NODES = "ABCDPEXY"


@pytest.fixture(scope="module")
def corpus(spark):
    papers = spark.createDataFrame([(n, "PARTIAL_OR_UNVERIFIED" if n == "P" else "COMPLETE") for n in NODES], "ut string, cr_status string")
    refs = spark.createDataFrame([(s, t) for s, ts in REFS.items() for t in ts], "source_ut string, ref_key string")
    edges = refs.select(F.col("source_ut").alias("src"), F.col("ref_key").alias("dst"))
    return papers, refs, edges


def test_coupling(spark, corpus):
    papers, refs, _ = corpus
    got = {(r.source_ut, r.target_ut): r for r in citation.bibliographic_coupling(refs, papers, 1).collect()}
    ab = got["A", "B"]
    assert (ab.shared_reference_count, ab.jaccard, ab.cosine) == (2, 0.5, 0.666667)
    assert ab.fractional_weight == pytest.approx(1 / 3 + 1, abs=1e-6)
    assert got["A", "D"].fractional_weight == 1.0 and got["A", "D"].cosine == 0.408248
    assert got["A", "P"].cosine is None and got["A", "P"].jaccard is None and got["A", "P"].quality_status == "INCOMPLETE_INPUT"
    assert len(got) == 7


def test_co_citation(spark, corpus):
    papers, refs, _ = corpus
    got = {(r.source_ut, r.target_ut): (r.co_citation_count, r.normalized_co_citation) for r in citation.co_citation(refs, papers, 1).collect()}
    assert got == {("A", "B"): (1, 0.707107), ("B", "X"): (1, 0.353553), ("B", "Y"): (1, 0.5), ("C", "X"): (1, 0.5), ("C", "Y"): (1, 0.707107), ("X", "Y"): (2, 0.707107)}


def test_pagerank(spark, corpus):
    papers, _, edges = corpus
    got = {r.ut: r.pagerank for r in graph.pagerank(papers, edges).collect()}
    want = {"A": 0.10359032, "B": 0.13294091, "C": 0.11036155, "D": 0.07269496, "E": 0.07269496, "P": 0.07269496, "X": 0.29531018, "Y": 0.13971214}
    assert got == pytest.approx(want, abs=1e-7)


def test_betweenness_and_components(spark, corpus):
    papers, _, edges = corpus
    got = {r.ut: round(r.betweenness, 6) for r in graph.betweenness(papers, edges).collect()}
    assert got == {**dict.fromkeys(NODES, 0.0), "A": 0.119048, "B": 0.238095, "X": 0.261905}
    # Over the limit nothing is broadcast: blocks of sources go over the graph by joins.
    joined = {r.ut: round(r.betweenness, 6) for r in graph.betweenness(papers, edges, limit=20).collect()}
    assert joined == got
    parts = {r.ut: (r.weak_component, r.size) for r in graph.weak_components(papers, edges).collect()}
    assert parts == {**{n: (0, 7) for n in "ABCDPXY"}, "E": (1, 1)}


def test_communities(spark, corpus):
    papers, refs, edges = corpus
    weights = graph.combined_weights(citation.bibliographic_coupling(refs, papers, 1), citation.co_citation(refs, papers, 1))
    got = {(r.src, r.dst): round(r.weight, 6) for r in weights.collect()}
    assert got["A", "B"] == pytest.approx(0.682843, abs=2e-6) and got["X", "Y"] == pytest.approx(0.282843, abs=2e-6) and len(got) == 9
    clusters = {r.ut: r.cluster_id for r in graph.communities(papers, weights, 0.05).collect()}
    assert clusters == {**dict.fromkeys("ABCDXY", 0), "E": 1, "P": 2}


def test_communities_by_joins(spark):
    """Components over the limit are propagated by joins, with the same labels."""
    rng = random.Random(3)
    weights = [(a, b, rng.choice([0.2, 0.3, 0.5, 0.8])) for a in range(6) for b in range(a + 1, 6) if rng.random() < 0.5] + [(20, 21, 0.4), (21, 22, 0.4)]
    df = spark.createDataFrame(weights, "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in range(24)], "ut long")
    one, other = ({r.ut: r.cluster_id for r in graph.communities(nodes, df, 0.1, limit=n).collect()} for n in (100, 2))
    assert one == other and len(one) == 24 and 1 < len(set(one.values())) < 24


def test_many_equal_paths(spark):
    """Ladders of three nodes a level have 3 ** 5 shortest paths; the first three are found without building them."""
    levels = [[0], *[[10 * k, 10 * k + 1, 10 * k + 2] for k in range(1, 6)], [99]]
    edges = [(a, b) for x, y in zip(levels, levels[1:]) for a in x for b in y]
    got = graph.shortest_paths(spark.createDataFrame(edges, "src long, dst long"), 0, 99).orderBy("rank").collect()
    assert [r.path for r in got] == [[0, 10, 20, 30, 40, 50 + i, 99] for i in range(3)] and [r["rank"] for r in got] == [1, 2, 3]


def test_rpys(spark):
    years = [2010] * 4 + [2012] * 2 + [2019] + [2020] * 2 + [2021]
    refs = spark.createDataFrame([(f"s{i}", f"k{i}", y) for i, y in enumerate(years)], "source_ut string, ref_key string, cited_year long")
    got = {r.year: (r.reference_count, float(r.local_baseline), float(r.deviation)) for r in citation.rpys(refs).collect()}
    assert got[2010] == (4, 0, 4) and got[2011] == (0, 1, -1) and got[2012] == (2, 0, 2) and got[2018] == (0, 0.5, -0.5) and got[2021] == (1, 0.5, 0.5) and len(got) == 12
    peaks = [r.year for r in citation.rpys_peaks(refs).dropDuplicates(["year"]).orderBy(F.desc("deviation"), F.desc("reference_count"), "year").collect()]
    assert peaks == [2010, 2012, 2020, 2019, 2021]


def test_related(spark, corpus):
    papers, refs, edges = corpus
    nobody = spark.createDataFrame([], "ut string, value string")
    rows = graph.related("A", papers, edges, citation.bibliographic_coupling(refs, papers, 1), citation.co_citation(refs, papers, 1), nobody, nobody).collect()
    got = {r.ut: r.score for r in rows}
    assert got["D"] == pytest.approx(0.342887, abs=2e-6) and got["C"] == pytest.approx(0.202073, abs=2e-6) and got["X"] == 0.2
    assert got["P"] == 0 and {r.ut: r.normalization_suppressed for r in rows}["P"]


def test_shortest_paths(spark, corpus):
    _, _, edges = corpus
    paths = graph.shortest_paths(edges, "D", "C")
    assert [r.path for r in paths.collect()] == [["D", "B", "C"]]
    hops = graph.path_edges(paths, edges).orderBy("step").collect()
    assert [(h.direction, h.citing, h.cited) for h in hops] == [("FORWARD_CITATION", "D", "B"), ("FORWARD_CITATION", "B", "C")]
    assert [r.path for r in graph.shortest_paths(edges, "A", "A").collect()] == [["A"]]
    assert graph.shortest_paths(edges, "A", "E").count() == 0
    assert graph.shortest_paths(edges, "D", "X", max_hops=1).count() == 0
