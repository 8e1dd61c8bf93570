"""Registered queries that have no SQL, on the smallest tables, against plain versions."""

import itertools
import os
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from scholargraph.operators import graph
from scholargraph.operators.lineage import checkpointed
from scholargraph.plans import citation_queries, registry
from scholargraph.sources import tables as T

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")


def test_every_query_has_sql_or_a_plain_version():
    assert set(registry.QUERIES) - set(registry.SQL) == {"betweenness", "communities", "compatible_names", "reference_sections", "reference_segments"}


def test_betweenness(spark):
    near = {}
    for r in T.citation_edges(spark, SF).collect():
        if r.src != r.dst:
            near.setdefault(r.src, set()).add(r.dst)
            near.setdefault(r.dst, set()).add(r.src)
    nodes = [r.ut for r in T.graph_nodes(spark, SF).collect()]
    total = dict.fromkeys(nodes, 0.0)
    # By definition: shares of shortest paths between every pair, from distances and path counts of all sources.
    dist, count = {}, {}
    for s in near:
        d, c, queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            v = queue.popleft()
            for w in near[v]:
                if w not in d:
                    d[w], c[w] = d[v] + 1, 0
                    queue.append(w)
                if d[w] == d[v] + 1:
                    c[w] += c[v]
        dist[s], count[s] = d, c
    for s, t in itertools.combinations(sorted(near), 2):
        if t in dist[s]:
            for v in dist[s]:
                if v not in (s, t) and v in dist[t] and dist[s][v] + dist[t][v] == dist[s][t]:
                    total[v] += count[s][v] * count[t][v] / count[s][t]
    scale = 2 / ((len(nodes) - 1) * (len(nodes) - 2))
    got = {r.ut: r.betweenness for r in registry.QUERIES["betweenness"](spark, SF).collect()}
    assert got == pytest.approx({v: x * scale for v, x in total.items()}, abs=2e-9)


def test_communities(spark):
    nodes, _, coupling, cocited = citation_queries._graph(spark, SF)
    weights = checkpointed(graph.combined_weights(coupling, cocited))
    near = {r.ut: {} for r in nodes.collect()}
    for r in weights.filter("weight >= 0.1").collect():
        near[r.src][r.dst] = near[r.dst][r.src] = round(r.weight * 10**9)
    label = {v: v for v in near}
    for _ in range(100):
        before = dict(label)
        for v in sorted(near):
            score = {}
            for u, w in near[v].items():
                score[label[u]] = score.get(label[u], 0) + w
            if score:
                label[v] = min(score, key=lambda x: (-score[x], x))
        if label == before:
            break
    rank = {x: i for i, x in enumerate(sorted(set(label.values())))}
    got = {r.ut: r.cluster_id for r in registry.QUERIES["communities"](spark, SF).collect()}
    assert got == {v: rank[x] for v, x in label.items()}


def test_compatible_names(spark):
    """Every pair of a nation: one has the other's parts, in whatever order, initials standing for words."""
    rows = T.table(spark, SF, "supplier").collect()
    want = set()
    for a, b in itertools.product(rows, rows):
        if a.s_nationkey == b.s_nationkey:
            x, y = (re.sub(r"^.*#0*", "N", r.s_name).lower() for r in (a, b))
            if x == y:  # "Ann X Lee" and "A. Y Lee": the initial fits, so the middle words decide
                want.add((a.s_suppkey, b.s_suppkey, 3))
    assert {tuple(r) for r in registry.QUERIES["compatible_names"](spark, SF).collect()} == want


def test_reference_segments(spark):
    """Every line that is not blank was numbered, so up to 999 entries come back, and without three there is no list."""
    docs = {r.doc_id: r.text for r in T.table(spark, SF, "documents").collect()}
    got = {r.doc_id: (r.entries, r.method, r.confidence) for r in registry.QUERIES["reference_segments"](spark, SF).collect()}
    for d, text in docs.items():
        lines = [x for x in (text or "").split("\n") if x.strip(" ")]
        if not lines:
            assert d not in got
        elif 3 <= len(lines) <= 999 and all(x.strip() and not re.match(r"[ \t]*(?:\[\d{1,4}\]|\d{1,4}[.)])", x) for x in lines):
            assert got[d] == (len(lines), "numbered-punctuated", "HIGH")
        elif len(lines) < 3:
            assert got[d][0] == 0


def test_reference_sections(spark):
    """The last turn of each conversation is headed and numbered line by line."""
    turns = {}
    for r in T.table(spark, SF, "conversations").collect():
        turns.setdefault(r.conv_id, {})[r.turn] = r.text
    got = {r.doc: r for r in registry.QUERIES["reference_sections"](spark, SF).collect()}
    for conv, of in turns.items():
        last = max(of)
        lines = [x for x in (of[last] or "").split("\n")]
        row = got.get(conv)
        if of[last] is not None and last >= 0.3 * (last + 1) // 1:
            assert row is not None and row.start_page == last and row.heading == "References"
            if len(lines) < 3:
                assert row.n == 0
            elif all(x.strip() for x in lines):
                assert row.n == len(lines) and row.method == "numbered-punctuated"


def test_listing_of_no_rows(spark):
    from scholargraph.operators import listing

    none = spark.createDataFrame([], "ut long, title string, doi string, venue string, year long")
    assert listing.list_papers(none, none, "x", 1990, "v", True).count() == 0
    with pytest.raises(ValueError):
        listing.ranking(none.withColumn("pagerank", F.lit(0.0)), "size")
