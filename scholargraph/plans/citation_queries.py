"""Citation analytics and graph queries on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.operators import citation, graph
from scholargraph.operators.lineage import checkpointed
from scholargraph.plans.registry import query
from scholargraph.sources import tables as T

WITH = f"WITH {T.REFS_SQL}, {T.PAPERS_SQL}"
COUPLING_SQL = f"""{T.REFS_SQL}, {T.PAPERS_SQL}, uses AS (
  SELECT ref_key, 1.0 / greatest(1, count(*) - 1) AS w FROM refs GROUP BY 1
), sizes AS (SELECT source_ut, count(*) AS n FROM refs GROUP BY 1), pairs AS (
  SELECT a.source_ut AS s, b.source_ut AS t, count(*) AS shared, sum(w) AS fw
  FROM refs a JOIN refs b ON a.ref_key = b.ref_key AND a.source_ut < b.source_ut JOIN uses u ON u.ref_key = a.ref_key
  GROUP BY 1, 2 HAVING count(*) >= 2
), coupling AS (
  SELECT s AS source_ut, t AS target_ut, shared AS shared_reference_count, round(fw, 6) AS fractional_weight,
    CASE WHEN p.cr_status = 'COMPLETE' AND q.cr_status = 'COMPLETE' THEN round(shared / (x.n + y.n - shared), 6) END AS jaccard,
    CASE WHEN p.cr_status = 'COMPLETE' AND q.cr_status = 'COMPLETE' THEN round(shared / sqrt(x.n * y.n), 6) END AS cosine,
    CASE WHEN p.cr_status = 'COMPLETE' AND q.cr_status = 'COMPLETE' THEN 'COMPLETE_BOTH' ELSE 'INCOMPLETE_INPUT' END AS quality_status
  FROM pairs JOIN papers p ON p.ut = s JOIN papers q ON q.ut = t JOIN sizes x ON x.source_ut = s JOIN sizes y ON y.source_ut = t
)"""


@query(f"WITH {COUPLING_SQL} SELECT * FROM coupling")
def bibliographic_coupling(spark, d) -> DataFrame:
    return citation.bibliographic_coupling(T.references(spark, d), T.papers(spark, d), 2)


@query(f"WITH {COUPLING_SQL} SELECT source_ut, target_ut, shared_reference_count, cosine FROM coupling "
       "ORDER BY coalesce(cosine, -1) DESC, shared_reference_count DESC, source_ut, target_ut LIMIT 200")
def coupling_ranked(spark, d) -> DataFrame:
    return citation.bibliographic_coupling(T.references(spark, d), T.papers(spark, d), 2).orderBy(
        F.coalesce("cosine", F.lit(-1.0)).desc(), F.desc("shared_reference_count"), "source_ut", "target_ut"
    ).select("source_ut", "target_ut", "shared_reference_count", "cosine").limit(200)


@query(f"""{WITH}, local_refs AS (SELECT source_ut, ref_key FROM refs JOIN part ON p_partkey = ref_key AND p_size <= 25),
n AS (SELECT ref_key, count(*) AS n FROM local_refs GROUP BY 1)
SELECT a.ref_key AS source_ut, b.ref_key AS target_ut, count(*) AS co_citation_count,
  round(count(*) / sqrt(any_value(x.n) * any_value(y.n)), 6) AS normalized_co_citation,
  count(*) FILTER (WHERE cr_status = 'COMPLETE') AS complete_support, count(*) FILTER (WHERE cr_status <> 'COMPLETE') AS incomplete_support
FROM local_refs a JOIN local_refs b ON a.source_ut = b.source_ut AND a.ref_key < b.ref_key JOIN papers ON ut = a.source_ut
JOIN n x ON x.ref_key = a.ref_key JOIN n y ON y.ref_key = b.ref_key GROUP BY 1, 2 HAVING count(*) >= 2""")
def co_citation(spark, d) -> DataFrame:
    local = T.local_records(spark, d).select(F.col("ut").alias("ref_key"))
    refs = T.references(spark, d).join(local, "ref_key", "left_semi")
    return citation.co_citation(refs, T.papers(spark, d), 2)


@query(f"WITH {T.REFS_SQL} SELECT ref_key, count(*) AS papers, min(source_ut) AS first_ut, arg_min(position, source_ut) AS first_position FROM refs GROUP BY 1")
def reference_index(spark, d) -> DataFrame:
    return citation.reference_index(T.references(spark, d))


@query(f"""WITH {T.EDGES_SQL} SELECT p_partkey AS ut, CAST((SELECT count(*) FROM edges WHERE dst = p_partkey) AS BIGINT) AS in_degree,
CAST((SELECT count(*) FROM edges WHERE src = p_partkey) AS BIGINT) AS out_degree FROM part""")
def citation_degrees(spark, d) -> DataFrame:
    return citation.degrees(T.graph_nodes(spark, d), T.citation_edges(spark, d)).select("ut", F.col("in_degree").cast("long"), F.col("out_degree").cast("long"))


@query(f"""WITH {T.REFS_SQL} SELECT ref_key, count(*) AS cited_count, min(cited_year) AS first_year, min(source_ut) AS first_source
FROM refs WHERE ref_key NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1 ORDER BY cited_count DESC, ref_key LIMIT 100""")
def citation_frontier(spark, d) -> DataFrame:
    return citation.frontier(T.references(spark, d), T.local_records(spark, d), 100)


RPYS_SQL = f"""{T.REFS_SQL}, counts AS (SELECT cited_year AS year, count(*) AS n FROM refs WHERE cited_year IS NOT NULL GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(year) FROM counts), (SELECT max(year) FROM counts))) AS year),
base AS (SELECT s.year, median(coalesce(c.n, 0)) AS b FROM spine s, (SELECT unnest([-2, -1, 1, 2]) AS k) LEFT JOIN counts c ON c.year = s.year + k GROUP BY 1),
rpys AS (SELECT s.year, CAST(coalesce(c.n, 0) AS BIGINT) AS reference_count, CAST(b AS DOUBLE) AS local_baseline, CAST(coalesce(c.n, 0) - b AS DOUBLE) AS deviation
FROM spine s LEFT JOIN counts c ON c.year = s.year JOIN base ON base.year = s.year)"""


@query(f"WITH {RPYS_SQL} SELECT * FROM rpys")
def rpys_series(spark, d) -> DataFrame:
    return citation.rpys(T.references(spark, d)).select(
        "year", F.col("reference_count").cast("long"), F.col("local_baseline").cast("double"), F.col("deviation").cast("double"))


@query(f"""WITH {RPYS_SQL}, top AS (SELECT * FROM rpys WHERE deviation > 0 ORDER BY deviation DESC, reference_count DESC, year LIMIT 20),
of_year AS (SELECT cited_year AS year, ref_key, count(*) AS cited_count FROM refs GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY cited_count DESC, ref_key) AS rank FROM of_year)
SELECT t.year, reference_count, deviation, rank, ref_key, cited_count FROM top t JOIN ranked r ON r.year = t.year WHERE rank <= 10""")
def rpys_peaks(spark, d) -> DataFrame:
    return citation.rpys_peaks(T.references(spark, d)).withColumn("deviation", F.col("deviation").cast("double"))


@query(f"""{WITH} SELECT (SELECT count(*) FROM papers) AS records, (SELECT count(*) FROM refs) AS observed_references,
(SELECT count(*) FROM refs JOIN part ON p_partkey = ref_key AND p_size <= 25) AS resolved_references,
count(*) FILTER (WHERE cr_status = 'COMPLETE') AS complete_lists, count(*) FILTER (WHERE cr_status <> 'COMPLETE') AS incomplete_lists FROM papers""")
def input_quality(spark, d) -> DataFrame:
    refs = T.references(spark, d).join(T.local_records(spark, d).select(F.col("ut").alias("ref_key"), F.lit(1).alias("known")), "ref_key", "left").agg(
        F.count(F.lit(1)).alias("observed_references"), F.count("known").alias("resolved_references"))
    lists = T.papers(spark, d).agg(F.count(F.lit(1)).alias("records"), F.count_if(citation.is_complete()).alias("complete_lists"), F.count_if(~citation.is_complete()).alias("incomplete_lists"))
    return lists.join(F.broadcast(refs))


@query("""SELECT 'records' AS fact, count(*) AS n FROM orders UNION ALL SELECT 'with_year', count(o_orderdate) FROM orders
UNION ALL SELECT 'references', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
UNION ALL SELECT 'authors', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
UNION ALL SELECT 'status_' || o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus""")
def corpus_stats(spark, d) -> DataFrame:
    orders, lines = T.table(spark, d, "orders"), T.table(spark, d, "lineitem")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fact"), "n")
    return (
        one(orders, "records").unionByName(one(orders.filter("o_orderdate is not null"), "with_year"))
        .unionByName(one(lines.select("l_orderkey", "l_partkey").distinct(), "references"))
        .unionByName(one(lines.select("l_orderkey", "l_suppkey").distinct(), "authors"))
        .unionByName(orders.groupBy(F.concat(F.lit("status_"), "o_orderstatus").alias("fact")).agg(F.count(F.lit(1)).alias("n")))
    )


@query("""SELECT (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM lineitem) AS reference_rows, (SELECT count(*) FROM part) AS targets,
(SELECT count(*) FROM supplier) AS authors, (SELECT count(*) FROM events) AS observations, (SELECT max(o_orderkey) FROM orders) AS last_record""")
def revision_fingerprint(spark, d) -> DataFrame:
    out = T.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("records"), F.max("o_orderkey").alias("last_record"))
    for t, name in (("lineitem", "reference_rows"), ("part", "targets"), ("supplier", "authors"), ("events", "observations")):
        out = out.join(F.broadcast(T.table(spark, d, t).agg(F.count(F.lit(1)).alias(name))))
    return out


@query(f"""{WITH}, n AS (SELECT source_ut, count(*) AS best, max(position) AS reported FROM refs GROUP BY 1)
SELECT ut, cr_status, coalesce(best, 0) AS best_count, coalesce(reported, 0) AS reported_count, greatest(coalesce(reported, 0) - coalesce(best, 0), 0) AS gap
FROM papers LEFT JOIN n ON source_ut = ut WHERE cr_status NOT IN ('COMPLETE', 'COMPLETE_ZERO') ORDER BY gap DESC, reported_count DESC, ut LIMIT 500""")
def completeness_gaps(spark, d) -> DataFrame:
    n = T.references(spark, d).groupBy(F.col("source_ut").alias("ut")).agg(F.count(F.lit(1)).alias("b"), F.max("position").alias("r"))
    b, r = F.coalesce("b", F.lit(0)), F.coalesce("r", F.lit(0))
    return (
        T.papers(spark, d).filter(~citation.is_complete()).join(n, "ut", "left")
        .select("ut", "cr_status", b.cast("long").alias("best_count"), r.cast("long").alias("reported_count"), F.greatest(r - b, F.lit(0)).cast("long").alias("gap"))
        .orderBy(F.desc("gap"), F.desc("reported_count"), "ut").limit(500)
    )


# ---- the part graph: nodes, edges, pairs -------------------------------------------------------------------------

GRAPH_SQL = f"""{T.EDGES_SQL}, nodes AS (
  SELECT p_partkey AS ut, CASE WHEN p_size <= 25 THEN 'COMPLETE' ELSE 'PARTIAL_OR_UNVERIFIED' END AS cr_status, p_brand, p_type, p_size FROM part
), uses AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1), outs AS (SELECT src, count(*) AS n FROM edges GROUP BY 1),
coupling AS (
  SELECT a.src AS source_ut, b.src AS target_ut, count(*) AS shared_reference_count,
    CASE WHEN any_value(p.cr_status) = 'COMPLETE' AND any_value(q.cr_status) = 'COMPLETE' THEN round(count(*) / sqrt(any_value(x.n) * any_value(y.n)), 6) END AS cosine
  FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src JOIN nodes p ON p.ut = a.src JOIN nodes q ON q.ut = b.src
  JOIN outs x ON x.src = a.src JOIN outs y ON y.src = b.src GROUP BY 1, 2
), cocitation AS (
  SELECT a.dst AS source_ut, b.dst AS target_ut, count(*) AS co_citation_count, round(count(*) / sqrt(any_value(x.n) * any_value(y.n)), 6) AS normalized_co_citation
  FROM edges a JOIN edges b ON a.src = b.src AND a.dst < b.dst JOIN uses x ON x.dst = a.dst JOIN uses y ON y.dst = b.dst GROUP BY 1, 2
), seed AS (
  SELECT ut AS s FROM (SELECT src AS ut FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY count(*) DESC, ut LIMIT 1)"""


def _graph(spark, d, seeded: bool = False):
    """Nodes, edges, coupling, co-citation and the seed; with `seeded` only the seed's pairs are computed."""
    nodes = T.graph_nodes(spark, d)
    edges = checkpointed(T.citation_edges(spark, d))
    status = T.table(spark, d, "part").select(F.col("p_partkey").alias("ut"), F.when(F.col("p_size") <= 25, "COMPLETE").otherwise("PARTIAL_OR_UNVERIFIED").alias("cr_status"))
    refs = edges.select(F.col("src").alias("source_ut"), F.col("dst").alias("ref_key"))
    seed = _seed(edges) if seeded else None
    pairs = citation.bibliographic_coupling(refs, status, 1, seed), citation.co_citation(refs, status, 1, seed)
    return (nodes, edges, *pairs, seed) if seeded else (nodes, edges, *pairs)


def _seed(edges):
    """The node of most edges: the paper whose neighbourhood the registered queries show."""
    ends = edges.select(F.col("src").alias("ut")).unionByName(edges.select(F.col("dst").alias("ut")))
    return ends.groupBy("ut").count().orderBy(F.desc("count"), "ut").first()["ut"]


@query(f"""WITH {GRAPH_SQL}, authors AS (SELECT DISTINCT l_partkey AS ut, l_suppkey AS value FROM lineitem),
concepts AS (SELECT p_partkey AS ut, p_type AS value FROM part UNION SELECT p_partkey, p_brand FROM part),
na AS (SELECT ut, count(*) AS n FROM authors GROUP BY 1), nc AS (SELECT ut, count(*) AS n FROM concepts GROUP BY 1),
sa AS (SELECT ut, count(*) AS k FROM authors, seed WHERE ut <> s AND value IN (SELECT value FROM authors, seed WHERE ut = s) GROUP BY 1),
sc AS (SELECT ut, count(*) AS k FROM concepts, seed WHERE ut <> s AND value IN (SELECT value FROM concepts, seed WHERE ut = s) GROUP BY 1),
direct AS (SELECT DISTINCT CASE WHEN src = s THEN dst ELSE src END AS ut FROM edges, seed WHERE src = s OR dst = s),
cp AS (SELECT CASE WHEN source_ut = s THEN target_ut ELSE source_ut END AS ut, shared_reference_count AS k, cosine FROM coupling, seed WHERE source_ut = s OR target_ut = s),
cc AS (SELECT CASE WHEN source_ut = s THEN target_ut ELSE source_ut END AS ut, co_citation_count AS k, normalized_co_citation AS v FROM cocitation, seed WHERE source_ut = s OR target_ut = s),
cand AS (SELECT ut FROM direct UNION SELECT ut FROM cp UNION SELECT ut FROM cc UNION SELECT ut FROM sa UNION SELECT ut FROM sc)
SELECT c.ut, round(0.20 * (direct.ut IS NOT NULL)::INT + 0.35 * least(1, coalesce(cp.cosine, 0)) + 0.25 * least(1, coalesce(cc.v, 0))
  + 0.10 * coalesce(sa.k / (na.n + (SELECT n FROM na, seed WHERE ut = s) - sa.k), 0) + 0.10 * coalesce(sc.k / (nc.n + (SELECT n FROM nc, seed WHERE ut = s) - sc.k), 0), 6) AS score,
  coalesce(cp.k, 0) AS shared_reference_count, coalesce(cc.k, 0) AS co_citation_count, coalesce(sa.k, 0) AS shared_authors, coalesce(sc.k, 0) AS shared_concepts,
  concat_ws('|', CASE WHEN direct.ut IS NOT NULL THEN 'DIRECT_CITATION' END, CASE WHEN cp.k > 0 THEN 'SHARED_REFERENCES' END, CASE WHEN cc.k > 0 THEN 'CO_CITATION' END,
    CASE WHEN sa.k > 0 THEN 'SHARED_AUTHORS' END, CASE WHEN sc.k > 0 THEN 'SHARED_CONCEPTS' END) AS evidence_classes,
  cp.ut IS NOT NULL AND cp.cosine IS NULL AS normalization_suppressed
FROM cand c LEFT JOIN direct USING (ut) LEFT JOIN cp USING (ut) LEFT JOIN cc USING (ut) LEFT JOIN sa USING (ut) LEFT JOIN sc USING (ut)
LEFT JOIN na ON na.ut = c.ut LEFT JOIN nc ON nc.ut = c.ut
ORDER BY score DESC, shared_reference_count DESC, co_citation_count DESC, c.ut LIMIT 30""")
def related_papers(spark, d) -> DataFrame:
    nodes, edges, coupling, cocit, seed = _graph(spark, d, True)
    authors = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("ut"), F.col("l_suppkey").alias("value"))
    concepts = nodes.select("ut", F.explode(F.array("concept", "venue")).alias("value"))
    return graph.related(seed, nodes, edges, coupling, cocit, authors, concepts, 30)


def _neighbourhood(name: str, sql: str, pick):
    def run(spark, d) -> DataFrame:
        nodes, edges, coupling, cocit, seed = _graph(spark, d, True)
        return pick(seed, edges, coupling, cocit).join(nodes.select(F.col("ut").alias("neighbour"), "title"), "neighbour", "left")

    query(f"WITH {GRAPH_SQL} SELECT n.*, p_name AS title FROM ({sql}) n LEFT JOIN part ON p_partkey = neighbour", name)(run)


_neighbourhood("neighborhood_out", "SELECT dst AS neighbour FROM edges, seed WHERE src = s", lambda s, e, cp, cc: e.filter(F.col("src") == s).select(F.col("dst").alias("neighbour")))
_neighbourhood("neighborhood_in", "SELECT src AS neighbour FROM edges, seed WHERE dst = s", lambda s, e, cp, cc: e.filter(F.col("dst") == s).select(F.col("src").alias("neighbour")))
_neighbourhood(
    "neighborhood_coupling",
    "SELECT CASE WHEN source_ut = s THEN target_ut ELSE source_ut END AS neighbour, cosine AS weight, shared_reference_count FROM coupling, seed WHERE source_ut = s OR target_ut = s",
    lambda s, e, cp, cc: cp.filter((F.col("source_ut") == s) | (F.col("target_ut") == s)).select(
        F.when(F.col("source_ut") == s, F.col("target_ut")).otherwise(F.col("source_ut")).alias("neighbour"), F.col("cosine").alias("weight"), "shared_reference_count"))
_neighbourhood(
    "neighborhood_cocited",
    "SELECT CASE WHEN source_ut = s THEN target_ut ELSE source_ut END AS neighbour, normalized_co_citation AS weight, co_citation_count FROM cocitation, seed WHERE source_ut = s OR target_ut = s",
    lambda s, e, cp, cc: cc.filter((F.col("source_ut") == s) | (F.col("target_ut") == s)).select(
        F.when(F.col("source_ut") == s, F.col("target_ut")).otherwise(F.col("source_ut")).alias("neighbour"), F.col("normalized_co_citation").alias("weight"), "co_citation_count"))


@query(f"""WITH RECURSIVE {T.EDGES_SQL}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT p_partkey AS ut, p_partkey AS low FROM part UNION SELECT b.dst, r.low FROM reach r JOIN both_ways b ON b.src = r.ut WHERE r.low < b.dst),
low AS (SELECT ut, min(low) AS component FROM reach GROUP BY 1)
SELECT ut, component, CAST(dense_rank() OVER (ORDER BY component) - 1 AS BIGINT) AS weak_component, count(*) OVER (PARTITION BY component) AS size FROM low""")
def weak_components(spark, d) -> DataFrame:
    return graph.weak_components(T.graph_nodes(spark, d), T.citation_edges(spark, d))


@query(f"""WITH RECURSIVE {T.EDGES_SQL}, e AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS outs FROM edges),
n AS (SELECT count(*) AS n FROM part), ranks(i, id, v) AS (
  SELECT 0, p_partkey, 1.0::DOUBLE / n FROM part, n
  UNION ALL
  SELECT any_value(r.i) + 1, r.id, any_value(0.15 / n) + 0.85 * any_value((SELECT sum(q.v) FROM ranks q WHERE q.id NOT IN (SELECT src FROM e)) / n)
    + 0.85 * coalesce(any_value((SELECT sum(q.v / e.outs) FROM ranks q JOIN e ON e.src = q.id WHERE e.dst = r.id)), 0)
  FROM ranks r, n WHERE r.i < 20 GROUP BY r.id
) SELECT id AS ut, round(v, 9) AS pagerank FROM ranks WHERE i = 20""")
def pagerank_20(spark, d) -> DataFrame:
    return graph.pagerank(T.graph_nodes(spark, d), T.citation_edges(spark, d), iterations=20, tolerance=0).select("ut", F.round("pagerank", 9).alias("pagerank"))


@query()
def betweenness(spark, d) -> DataFrame:
    return graph.betweenness(T.graph_nodes(spark, d), checkpointed(T.citation_edges(spark, d))).select("ut", F.round("betweenness", 9).alias("betweenness"))


def _ends(edges, nodes):
    """The smallest cited node and the largest node of its component: the ends of the registered path queries."""
    parts = graph.weak_components(nodes, edges)
    low = parts.filter("size > 1").agg(F.min("component")).first()[0]
    return low, parts.filter(F.col("component") == low).agg(F.max("ut")).first()[0]


PATHS_SQL = f"""WITH RECURSIVE {T.EDGES_SQL}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT p_partkey AS ut, p_partkey AS low FROM part UNION SELECT b.dst, r.low FROM reach r JOIN both_ways b ON b.src = r.ut WHERE r.low < b.dst),
low AS (SELECT ut, min(low) AS component FROM reach GROUP BY 1),
ends AS (SELECT (SELECT min(component) FROM (SELECT component FROM low GROUP BY 1 HAVING count(*) > 1)) AS a),
ends2 AS (SELECT a, (SELECT max(ut) FROM low WHERE component = a) AS b FROM ends),
level(node, depth) AS (SELECT a, 0 FROM ends2 UNION SELECT w.dst, l.depth + 1 FROM level l JOIN both_ways w ON w.src = l.node WHERE l.depth < 30),
dist AS (SELECT node, min(depth) AS depth FROM level GROUP BY 1),
paths(path, node, depth) AS (SELECT [b], b, (SELECT depth FROM dist WHERE node = b) FROM ends2
  UNION ALL SELECT list_prepend(w.src, p.path), w.src, p.depth - 1 FROM paths p JOIN both_ways w ON w.dst = p.node JOIN dist q ON q.node = w.src AND q.depth = p.depth - 1),
top AS (SELECT path, row_number() OVER (ORDER BY path) AS rank FROM paths WHERE depth = 0 ORDER BY path LIMIT 3)"""


@query(PATHS_SQL + " SELECT array_to_string(path, '>') AS path, rank FROM top")
def shortest_paths(spark, d) -> DataFrame:
    nodes, edges = T.graph_nodes(spark, d), checkpointed(T.citation_edges(spark, d))
    a, b = _ends(edges, nodes)
    return graph.shortest_paths(edges, a, b, 3, 30).select(F.array_join("path", ">").alias("path"), "rank")


@query(PATHS_SQL + """ SELECT rank, step, f AS from_ut, t AS to_ut, CASE WHEN e.src IS NOT NULL THEN 'FORWARD_CITATION' ELSE 'REVERSE_TRAVERSAL' END AS direction,
CASE WHEN e.src IS NOT NULL THEN f ELSE t END AS citing, CASE WHEN e.src IS NOT NULL THEN t ELSE f END AS cited
FROM (SELECT rank, unnest(range(0, len(path) - 1)) AS step, unnest(path[:-2]) AS f, unnest(path[2:]) AS t FROM top) h LEFT JOIN edges e ON e.src = f AND e.dst = t""")
def path_edges(spark, d) -> DataFrame:
    nodes, edges = T.graph_nodes(spark, d), checkpointed(T.citation_edges(spark, d))
    a, b = _ends(edges, nodes)
    return graph.path_edges(graph.shortest_paths(edges, a, b, 3, 30), edges)


@query(f"""WITH {GRAPH_SQL} SELECT source_ut AS src, target_ut AS dst, round(sum(w), 6) AS weight FROM (
SELECT source_ut, target_ut, 0.60 * cosine AS w FROM coupling WHERE cosine IS NOT NULL
UNION ALL SELECT source_ut, target_ut, 0.40 * least(1, normalized_co_citation) FROM cocitation) GROUP BY 1, 2""")
def combined_weights(spark, d) -> DataFrame:
    _, _, coupling, cocit = _graph(spark, d)
    return graph.combined_weights(coupling, cocit).withColumn("weight", F.round("weight", 6))


@query()
def communities(spark, d) -> DataFrame:
    nodes, _, coupling, cocit = _graph(spark, d)
    return graph.communities(nodes, checkpointed(graph.combined_weights(coupling, cocit)), 0.1)


@query(f"""WITH RECURSIVE {T.EDGES_SQL}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT p_partkey AS ut, p_partkey AS low FROM part UNION SELECT b.dst, r.low FROM reach r JOIN both_ways b ON b.src = r.ut WHERE r.low < b.dst),
m AS (SELECT ut, min(low) AS cluster_id FROM reach GROUP BY 1), full_m AS (SELECT m.*, p_size AS year, p_brand AS venue, p_type AS concept FROM m JOIN part ON p_partkey = ut),
c AS (SELECT cluster_id, concept, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, concept) AS k FROM full_m GROUP BY 1, 2),
v AS (SELECT cluster_id, venue, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, venue) AS k FROM full_m GROUP BY 1, 2)
SELECT cluster_id, count(*) AS size, CAST(min(year) AS BIGINT) AS year_min, CAST(max(year) AS BIGINT) AS year_max,
 (SELECT string_agg(concept, '|' ORDER BY k) FROM c WHERE c.cluster_id = full_m.cluster_id AND k <= 5) AS top_concepts,
 (SELECT string_agg(venue, '|' ORDER BY k) FROM v WHERE v.cluster_id = full_m.cluster_id AND k <= 5) AS top_venues,
 (SELECT string_agg(concept, '; ' ORDER BY k) FROM c WHERE c.cluster_id = full_m.cluster_id AND k <= 3) AS label
FROM full_m GROUP BY cluster_id""")
def community_rollup(spark, d) -> DataFrame:
    nodes = T.graph_nodes(spark, d)
    members = graph.weak_components(nodes, T.citation_edges(spark, d)).select("ut", F.col("component").alias("cluster_id"))
    return graph.community_rollup(members, nodes)


@query(f"""WITH {T.EDGES_SQL}, deg AS (SELECT ut, count(*) AS degree FROM (SELECT src AS ut FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
SELECT ut, degree FROM deg ORDER BY degree DESC, ut LIMIT 500""")
def centrality_ranking(spark, d) -> DataFrame:
    deg = citation.degrees(T.graph_nodes(spark, d), T.citation_edges(spark, d))
    return deg.select("ut", (F.col("in_degree") + F.col("out_degree")).cast("long").alias("degree")).filter("degree > 0").orderBy(F.desc("degree"), "ut").limit(500)


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS ut, l_suppkey AS author FROM lineitem), seed AS (SELECT min(author) AS s FROM a)
SELECT b.author AS coauthor, count(DISTINCT b.ut) AS shared_papers FROM a JOIN a b ON a.ut = b.ut AND a.author <> b.author, seed WHERE a.author = s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500""")
def coauthors(spark, d) -> DataFrame:
    a = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ut"), F.col("l_suppkey").alias("author")).distinct()
    seed = a.agg(F.min("author")).first()[0]
    own = a.filter(F.col("author") == seed).select("ut")
    return (
        a.join(own, "ut", "left_semi").filter(F.col("author") != seed).groupBy(F.col("author").alias("coauthor"))
        .agg(F.count_distinct("ut").alias("shared_papers")).orderBy(F.desc("shared_papers"), "coauthor").limit(500)
    )


@query("""WITH a AS (SELECT l_orderkey AS ut, l_suppkey AS author, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY ut ORDER BY pos, author) AS n FROM a)
SELECT author, count(*) AS publications, count(*) FILTER (WHERE n = 1) AS first_author_count, min(year(o_orderdate))::BIGINT AS first_year, max(year(o_orderdate))::BIGINT AS last_year
FROM f JOIN orders ON o_orderkey = ut GROUP BY 1""")
def author_profile(spark, d) -> DataFrame:
    a = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ut"), F.col("l_suppkey").alias("author")).agg(F.min("l_linenumber").alias("pos"))
    first = a.withColumn("n", F.row_number().over(Window.partitionBy("ut").orderBy("pos", "author")))
    return first.join(T.papers(spark, d), "ut").groupBy("author").agg(
        F.count(F.lit(1)).alias("publications"), F.count_if(F.col("n") == 1).alias("first_author_count"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("""WITH seed AS (SELECT min(p_partkey) AS s FROM part), c AS (SELECT p_partkey AS ut, p_type AS v FROM part UNION ALL SELECT p_partkey, p_brand FROM part)
SELECT ut, string_agg(v, '|' ORDER BY v) AS shared FROM c, seed WHERE ut <> s AND v IN (SELECT v FROM c, seed WHERE ut = s) GROUP BY 1""")
def metadata_candidates(spark, d) -> DataFrame:
    c = T.graph_nodes(spark, d).select("ut", F.explode(F.array("concept", "venue")).alias("v"))
    seed = c.agg(F.min("ut")).first()[0]
    own = c.filter(F.col("ut") == seed).select("v").distinct()
    return c.filter(F.col("ut") != seed).join(own, "v").groupBy("ut").agg(F.array_join(F.sort_array(F.collect_list("v")), "|").alias("shared"))
