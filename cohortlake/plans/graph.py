"""Queries for neighbourhoods and graphs."""

from pyspark.sql import functions as F

from cohortlake.functions.prims import h, h_sql, materialize, table
from cohortlake.operators import graph as G
from cohortlake.operators import vectors as V

from .annotations import BXS  # noqa: F401
from .metrics import rounded
from .registry import query

U = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-8)) AS u FROM embeddings)"
KNN = f"""(WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_dot_product(a.u, b.u), 9) AS similarity FROM {U} a JOIN {U} b ON a.vec_id <> b.vec_id)
 SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) <= 5)"""


def nn(spark, d):
    e = table(spark, d, "embeddings")
    return G.knn(e, e, "vec_id", "embedding", 5)


@query("g01_cosine_top_k", f"SELECT vec_id, count(*) AS n, round(avg(similarity), 6) AS s FROM {KNN} GROUP BY 1")
def g01(spark, d):
    return rounded(nn(spark, d).groupBy("vec_id").agg(F.count("*").alias("n"), F.avg("similarity").alias("s")))


@query("g02_distance_percentiles", f"WITH x AS (SELECT vec_id, round(avg(1 - similarity), 6) AS distance FROM {KNN} GROUP BY 1) SELECT vec_id, distance, round(cume_dist() OVER (ORDER BY distance), 6) AS percentile FROM x")
def g02(spark, d):
    x = materialize(rounded(G.knn_distance(nn(spark, d), "vec_id")))
    return rounded(G.percentile_of(x, x.select("distance"), "distance"))


@query("g02_mid_rank_percentiles", f"""WITH x AS (SELECT vec_id, round(avg(1 - similarity), 6) AS distance FROM {KNN} GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM x WHERE vec_id % 3 = 0),
 p AS (SELECT vec_id, distance, (SELECT count(*) FROM x y WHERE y.vec_id % 3 = 0 AND y.distance <= x.distance) AS r FROM x) SELECT vec_id, distance, round(least(greatest((r - 0.5) / n, 0.5 / n), 1 - 0.5 / n), 6) AS percentile FROM p, n""")
def g02m(spark, d):
    x = materialize(rounded(G.knn_distance(nn(spark, d), "vec_id")))
    return rounded(G.percentile_of(x, x.where("vec_id % 3 = 0").select("distance"), "distance", mid=True))


@query("g03_hubness", f"SELECT neighbour, count(*) AS times FROM {KNN} GROUP BY 1")
def g03(spark, d):
    return G.hubness(nn(spark, d))


def graph_points(spark, d):
    from .annotations import points

    return points(spark, d).withColumn("features", F.array((F.col("key") % 7).cast("double"), (F.col("key") % 11).cast("double")))


GP = "(SELECT event_id AS key, user_id::DOUBLE AS x, value AS y, event_id % 7 AS f, event_id % 11 AS g FROM events)"
EDGES = f"(SELECT a.key AS src, b.key AS dst, round(1 - exp(-0.1 * sqrt((a.f - b.f) ** 2 + (a.g - b.g) ** 2)) * exp(-0.3 * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS weight FROM {GP} a JOIN {GP} b ON a.key < b.key AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4)"


def edges(spark, d):
    return rounded(G.radius_edges(graph_points(spark, d), 2.0, 0.3, 0.1))


@query("g04_radius_edges", f"SELECT * FROM {EDGES}")
def g04(spark, d):
    return edges(spark, d)


@query("g05_cluster_nodes", f"SELECT floor(x / 10)::BIGINT AS c, round(avg(f), 6) AS f, round(avg(x)) AS cx, round(avg(y)) AS cy FROM {GP} GROUP BY 1")
def g05(spark, d):
    c = G.cluster_nodes(graph_points(spark, d).withColumn("c", F.floor(F.col("cx") / 10)), "c", "features")
    return c.select("c", F.round(F.col("features")[0], 6).alias("f"), "cx", "cy")


@query("g06_edges_above", f"SELECT src, dst FROM {EDGES} WHERE weight > 0.6")
def g06(spark, d):
    return G.edges_above(edges(spark, d), 0.6)


@query("g07_triangles", f"WITH e AS (SELECT src, dst FROM {EDGES}) SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst")
def g07(spark, d):
    return G.triangles(edges(spark, d).select("src", "dst"))


NODES = "(SELECT DISTINCT l_suppkey AS graph_id, l_partkey AS node_id, l_partkey % 5 AS cls FROM lineitem)"
GE = "(SELECT DISTINCT l_suppkey AS graph_id, l_partkey AS src, l_partkey % 40 + 1 AS dst FROM lineitem WHERE (l_suppkey, l_partkey % 40 + 1) IN (SELECT l_suppkey, l_partkey FROM lineitem) AND l_partkey <> l_partkey % 40 + 1)"


def node_edge(spark, d):
    i = table(spark, d, "lineitem")
    n = i.select(F.col("l_suppkey").alias("graph_id"), F.col("l_partkey").alias("node_id"), (F.col("l_partkey") % 5).alias("cls")).distinct()
    e = i.select(F.col("l_suppkey").alias("graph_id"), F.col("l_partkey").alias("src"), (F.col("l_partkey") % 40 + 1).alias("dst")).distinct().where("src <> dst")
    return n, e.join(n.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst")


@query("g08_subgraph", f"""WITH n AS (SELECT * FROM {NODES} WHERE cls BETWEEN 1 AND 3), e AS (SELECT * FROM {GE} WHERE (graph_id, src) IN (SELECT graph_id, node_id FROM n) AND (graph_id, dst) IN (SELECT graph_id, node_id FROM n))
 SELECT graph_id, count(*) AS edges FROM e WHERE graph_id IN (SELECT graph_id FROM n GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1""")
def g08(spark, d):
    return G.subgraph(*node_edge(spark, d), 1, 3)[1].groupBy("graph_id").agg(F.count("*").alias("edges"))


@query("g09_graph_statistics", f"""WITH s AS (SELECT graph_id, src, dst FROM {GE} UNION ALL SELECT graph_id, dst, src FROM {GE}), g AS (SELECT graph_id, src AS node, count(*) AS deg FROM s GROUP BY 1, 2),
 a AS (SELECT s.graph_id, avg(y.deg) AS nd, CASE WHEN stddev_pop(x.deg) > 0 THEN corr(x.deg, y.deg) END AS r FROM s JOIN g x ON x.graph_id = s.graph_id AND x.node = s.src JOIN g y ON y.graph_id = s.graph_id AND y.node = s.dst GROUP BY 1)
 SELECT n.graph_id, nodes, coalesce(edges, 0) AS edges, round(nd, 6) AS neighbour_degree, round(r, 6) AS assortativity FROM (SELECT graph_id, count(*) AS nodes FROM {NODES} GROUP BY 1) n LEFT JOIN (SELECT graph_id, count(*) AS edges FROM {GE} GROUP BY 1) USING (graph_id) LEFT JOIN a USING (graph_id)""")
def g09(spark, d):
    return rounded(G.graph_stats(*node_edge(spark, d)))


@query("g09_components", f"""WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES} WHERE weight < 0.35), s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), c AS (SELECT src AS id, src AS r FROM s UNION SELECT s.dst, c.r FROM c JOIN s ON s.src = c.id)
 SELECT id, min(r) AS component FROM c GROUP BY 1""")
def g09c(spark, d):
    return G.components(edges(spark, d).where("weight < 0.35"))


@query("e28_voxel_components")
def e28(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("scan"), (F.col("l_partkey") % 60).alias("x"), (F.col("l_suppkey") % 60).alias("y"))
    return G.voxel_components(v, 1, 2, 5)


@query("g10_spanning_forest")
def g10(spark, d):
    return G.msf(edges(spark, d))


@query("g11_graph_discrepancy", f"""WITH s AS (SELECT graph_id, src FROM {GE} UNION ALL SELECT graph_id, dst FROM {GE}), g AS (SELECT graph_id, src, least(count(*), 5) AS b FROM s GROUP BY 1, 2), n AS (SELECT graph_id, b, count(*) / sum(count(*)) OVER (PARTITION BY graph_id) AS share FROM g GROUP BY 1, 2),
 v AS (SELECT graph_id, b, coalesce(share, 0) AS share FROM (SELECT DISTINCT graph_id FROM n) CROSS JOIN generate_series(0, 5) t(b) LEFT JOIN n USING (graph_id, b)), p AS (SELECT x.graph_id AS i, y.graph_id AS j, sum(abs(x.share - y.share)) / 2 AS tv FROM v x JOIN v y USING (b) GROUP BY 1, 2),
 k AS (SELECT i % 2 AS a, j % 2 AS b, avg(exp(-(tv ** 2) / 0.5)) AS k FROM p GROUP BY 1, 2) SELECT round(sum(CASE WHEN a = b THEN k ELSE -k END), 6) AS mmd2 FROM k""")
def g11(spark, d):
    n, e = node_edge(spark, d)
    side = n.select("graph_id").distinct().withColumn("side", F.col("graph_id") % 2)
    return rounded(G.graph_mmd(G.degree_histogram(e, 6), side, 6, 0.5))


@query("g11_clustering_discrepancy", f"""WITH u AS (SELECT DISTINCT graph_id, least(src, dst) AS a, greatest(src, dst) AS b FROM {GE}), s AS (SELECT graph_id, a, b FROM u UNION ALL SELECT graph_id, b, a FROM u), d AS (SELECT graph_id, a, count(*) AS deg FROM s GROUP BY 1, 2),
 t AS (SELECT x.graph_id, x.a, count(*) AS closed FROM s x JOIN s y ON x.graph_id = y.graph_id AND x.a = y.a AND x.b < y.b JOIN u z ON z.graph_id = x.graph_id AND z.a = x.b AND z.b = y.b GROUP BY 1, 2),
 g AS (SELECT graph_id, least(floor(CASE WHEN deg > 1 THEN 2 * coalesce(closed, 0) / (deg * (deg - 1)) ELSE 0 END * 4), 3)::INT AS b FROM d LEFT JOIN t USING (graph_id, a)), n AS (SELECT graph_id, b, count(*) / sum(count(*)) OVER (PARTITION BY graph_id) AS share FROM g GROUP BY 1, 2),
 v AS (SELECT graph_id, b, coalesce(share, 0) AS share FROM (SELECT DISTINCT graph_id FROM n) CROSS JOIN generate_series(0, 3) t(b) LEFT JOIN n USING (graph_id, b)), p AS (SELECT x.graph_id AS i, y.graph_id AS j, sum(abs(x.share - y.share)) / 2 AS tv FROM v x JOIN v y USING (b) GROUP BY 1, 2),
 k AS (SELECT i % 2 AS a, j % 2 AS b, avg(exp(-(tv ** 2) / 0.5)) AS k FROM p GROUP BY 1, 2) SELECT round(sum(CASE WHEN a = b THEN k ELSE -k END), 6) AS mmd2 FROM k""")
def g11c(spark, d):
    n, e = node_edge(spark, d)
    side = n.select("graph_id").distinct().withColumn("side", F.col("graph_id") % 2)
    return rounded(G.graph_mmd(G.clustering_histogram(e, 4), side, 4, 0.5))


@query("g12_embedding_discrepancy", """WITH p AS (SELECT a.vec_id % 2 AS a, b.vec_id % 2 AS b, list_distance(a.e, b.e) AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b), k AS (SELECT a, b, avg((exp(-d * d / 0.5) + exp(-d * d / 2)) / 2) AS k FROM p GROUP BY 1, 2)
 SELECT round(sum(CASE WHEN a = b THEN k ELSE -k END), 6) AS mmd2 FROM k""")
def g12(spark, d):
    return rounded(G.mmd(table(spark, d, "embeddings").withColumn("side", F.col("vec_id") % 2), "vec_id", "side", "embedding", [0.5, 1.0]))


@query("g12_median_heuristic", """WITH e AS (SELECT vec_id % 2 AS side, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT quantile_cont(list_distance(x.e, y.e), 0.5) AS m FROM e x JOIN e y ON x.side = 0 AND y.side = 1),
 p AS (SELECT a.side AS a, b.side AS b, list_distance(a.e, b.e) AS d FROM e a, e b), k AS (SELECT a, b, avg((exp(-d * d / (m * m / 2)) + exp(-d * d / (2 * m * m)) + exp(-d * d / (8 * m * m))) / 3) AS k FROM p, m GROUP BY 1, 2)
 SELECT round(sum(CASE WHEN a = b THEN k ELSE -k END), 6) AS mmd2 FROM k""")
def g12m(spark, d):
    return rounded(G.mmd(table(spark, d, "embeddings").withColumn("side", F.col("vec_id") % 2), "vec_id", "side", "embedding"))


@query("g13_concatenated", f"""WITH n AS (SELECT graph_id // 10 AS win, graph_id, max(node_id) + 1 AS n FROM {NODES} GROUP BY 1, 2), o AS (SELECT win, graph_id, coalesce(sum(n) OVER (PARTITION BY win ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM n)
 SELECT win, count(*) AS edges, sum(src + o)::BIGINT AS src, sum(dst + o)::BIGINT AS dst FROM {GE} JOIN o USING (graph_id) GROUP BY 1""")
def g13(spark, d):
    n, e = node_edge(spark, d)
    w = F.floor(F.col("graph_id") / 10)
    _, out = G.concat_graphs(n.withColumn("win", w), e.withColumn("win", w), "win")
    return out.groupBy("win").agg(F.count("*").alias("edges"), F.sum("src").alias("src"), F.sum("dst").alias("dst"))


@query("g14_k_hop_sample", f"""WITH r AS (SELECT graph_id, node_id, count(*) OVER (PARTITION BY graph_id) AS n, row_number() OVER (PARTITION BY graph_id ORDER BY {h_sql('node_id', 6)}, node_id) AS r FROM {NODES}), f0 AS (SELECT graph_id, node_id FROM r WHERE n <= 20 OR r <= greatest(1, floor(n * 0.05))),
 s AS (SELECT graph_id, src, dst FROM {GE} UNION SELECT graph_id, dst, src FROM {GE}), f1 AS (SELECT * FROM f0 UNION SELECT s.graph_id, dst FROM f0 JOIN s ON s.graph_id = f0.graph_id AND s.src = f0.node_id), f2 AS (SELECT * FROM f1 UNION SELECT s.graph_id, dst FROM f1 JOIN s ON s.graph_id = f1.graph_id AND s.src = f1.node_id)
 SELECT graph_id, count(*) AS n, sum(node_id)::BIGINT AS ids FROM f2 GROUP BY 1""")
def g14(spark, d):
    s = G.khop_sample(*node_edge(spark, d), 0.05, 2, 6, 20)
    return s.groupBy("graph_id").agg(F.count("*").alias("n"), F.sum("node_id").alias("ids"))


@query("g14_induced_edges", f"""WITH n AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS i FROM {NODES} WHERE node_id % 4 <> 1)
 SELECT e.graph_id, src, dst, x.i AS new_src, y.i AS new_dst FROM {GE} e JOIN n x ON x.graph_id = e.graph_id AND x.node_id = src JOIN n y ON y.graph_id = e.graph_id AND y.node_id = dst""")
def g14e(spark, d):
    n, e = node_edge(spark, d)
    out = G.induced(n.where("node_id % 4 <> 1"), e)
    return out.select("graph_id", "src", "dst", F.col("new_src").cast("long").alias("new_src"), F.col("new_dst").cast("long").alias("new_dst"))


@query("g03_neighbour_diagnostics", f"""WITH x AS (SELECT vec_id, avg(1 - similarity) AS d FROM {KNN} GROUP BY 1), q AS (SELECT avg(d) AS mean, stddev_pop(d) AS sd, quantile_cont(d, 0.05) AS q05, quantile_cont(d, 0.5) AS q50, quantile_cont(d, 0.95) AS q95 FROM x),
 h AS (SELECT vec_id, coalesce(n, 0) AS n FROM embeddings LEFT JOIN (SELECT neighbour AS vec_id, count(*) AS n FROM {KNN} GROUP BY 1) USING (vec_id)) SELECT round(mean, 6) AS mean, round(sd, 6) AS sd, round(q05, 6) AS q05, round(q50, 6) AS q50, round(q95, 6) AS q95, round((q95 - q05) / greatest(abs(q50), 1e-8), 6) AS concentration,
 (SELECT quantile_cont(n, 0.5) FROM h) AS median_times, (SELECT max(n) FROM h) AS max_times, (SELECT count(*) FROM h) AS n, (SELECT count(*) FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) <= 1e-16) AS zero_norms FROM q""")
def g03d(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(G.neighbour_diagnostics(nn(spark, d), e, "vec_id", "embedding"))


@query("g15_nearest_prototypes", f"""WITH m AS (SELECT label, pos, avg(v) AS v FROM (SELECT label, unnest(range(64)) AS pos, unnest(u) AS v FROM {U}) GROUP BY 1, 2), p AS (SELECT label, list(v ORDER BY pos) AS p, sqrt(sum(v * v)) AS n FROM m GROUP BY 1),
 s AS (SELECT vec_id, p.label AS nearest, round(list_dot_product(u, p) / n, 9) AS similarity FROM {U} x, p) SELECT vec_id, nearest, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, nearest) = 1""")
def g15(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(G.nearest_prototype(e, "vec_id", "embedding", G.prototypes(e, "label", "embedding"), "label"))


RECALL = """(SELECT {out} FROM (SELECT q, min(CASE WHEN hit THEN place END) AS f FROM (SELECT q, hit, row_number() OVER (PARTITION BY q ORDER BY s DESC, r) AS place FROM (SELECT {q} AS q, {r} AS r, li = lt AS hit, s FROM p)) WHERE place <= 10 GROUP BY 1))"""


def recall_sql(name, q, r):
    return RECALL.format(out=", ".join(f"avg((coalesce(f, 99) <= {k})::INT) AS {name}{k}" for k in (1, 5, 10)), q=q, r=r)


@query("e33_retrieval", f"""WITH i AS (SELECT vec_id AS i, label AS li, list_transform(list_zip(u, list_concat(u[33:64], u[1:32])), lambda z: (z[1] + z[2]) / 2) AS v FROM {U} WHERE vec_id % 2 = 0), t AS (SELECT vec_id AS t, label AS lt, u AS w FROM {U} WHERE vec_id % 2 = 1),
 p AS (SELECT i, t, li, lt, round(list_dot_product(v, w), 9) AS s FROM i, t) SELECT round(tr1, 6) AS tr1, round(tr5, 6) AS tr5, round(tr10, 6) AS tr10, round(ir1, 6) AS ir1, round(ir5, 6) AS ir5, round(ir10, 6) AS ir10, round(tr1 + ir1, 6) AS irtr FROM {recall_sql('tr', 'i', 't')}, {recall_sql('ir', 't', 'i')}""")
def e33(spark, d):
    # Even ids stand for images, odd ones for texts; an image's second vector is its halves changed over.
    e = table(spark, d, "embeddings").withColumn("other", F.concat(F.slice("embedding", 33, 32), F.slice("embedding", 1, 32)))
    return rounded(G.retrieval(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "vec_id", "embedding", "label", [1, 5, 10], second="other"))


def approximate(spark, d):
    """Every row whose id is divisible by 100 against all rows, through the index."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0")
    return e, asked, V.search(V.build_index(e, "vec_id", "embedding", 10), asked, "vec_id", "embedding", 10)


@query("g01_approximate_top_k")
def g01a(spark, d):
    return approximate(spark, d)[2]


@query("g01_approximate_recall", "SELECT count(*) AS queries, true AS recalled, 10 * count(*) AS found FROM embeddings WHERE vec_id % 100 = 0")
def g01r(spark, d):
    e, asked, found = approximate(spark, d)
    exact = G.knn(asked, e, "vec_id", "embedding", 10)
    one = V.recall_of(found, exact, "vec_id").crossJoin(found.agg(F.count("*").alias("found")))
    return one.select("queries", (F.col("recall") >= 0.9).alias("recalled"), "found")
