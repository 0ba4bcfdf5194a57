"""Queries for feature assembly and models."""

from pyspark.sql import functions as F

from cohortlake.functions.prims import h, h_sql, l2, table
from cohortlake.operators import features as D

from .cohort import SURV, survival
from .metrics import rounded
from .registry import query

VEC = "(SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def vectors(spark, d):
    return table(spark, d, "embeddings")


@query("d01_pooled_vectors", f"SELECT label, pos::INT AS pos, round(avg(v), 6) AS value FROM (SELECT label, vec_id % 7 AS unit, pos, max(v) AS v FROM {VEC} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def d01(spark, d):
    return rounded(D.pool_features(vectors(spark, d).withColumn("unit", F.col("vec_id") % 7), "unit", "label", "embedding", "max", "mean"))


@query("d02_pooled_subset", f"WITH s AS (SELECT vec_id % 40 AS subject, label, pos, v FROM {VEC}) SELECT subject, pos::INT AS pos, round(coalesce(avg(v) FILTER (label BETWEEN 2 AND 3), 0), 6) AS value FROM s GROUP BY 1, 2")
def d02(spark, d):
    return rounded(D.pool_subset(vectors(spark, d).withColumn("subject", F.col("vec_id") % 40), "subject", "label", "embedding", 2, 3))


@query("d03_k_means")
def d03(spark, d):
    return rounded(D.kmeans_pool(table(spark, d, "part").withColumn("size", F.col("p_size").cast("double")), ["size", "p_retailprice"], 4))


@query("d04_voted_vectors", f"""WITH n AS (SELECT vec_id % 30 AS subject, label, count(*) AS n, min(vec_id) AS f FROM embeddings GROUP BY 1, 2), b AS (SELECT subject, label FROM n QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, f) = 1)
 SELECT subject, label, pos::INT AS pos, round(avg(v), 6) AS value FROM (SELECT *, vec_id % 30 AS subject FROM {VEC}) JOIN b USING (subject, label) GROUP BY 1, 2, 3""")
def d04(spark, d):
    return rounded(D.voted_embedding(vectors(spark, d).withColumn("subject", F.col("vec_id") % 30), "subject", "label", "vec_id", "embedding"))


@query("d05_selected_features", "SELECT feature, count(*) AS n FROM (SELECT lower(p_type) || '_' || p_brand AS feature FROM part) WHERE regexp_matches(feature, '^(economy|small)') GROUP BY 1")
def d05(spark, d):
    return D.select_features(table(spark, d, "part").select(F.concat_ws("_", F.lower("p_type"), "p_brand").alias("feature")), "feature", ["economy", "small"]).groupBy("feature").agg(F.count("*").alias("n"))


@query("d06_assembled", """SELECT coalesce(a.k, b.k) AS k, round(a.F, 9) AS o_F, round(a.O, 9) AS o_O, round(b.click, 9) AS e_click FROM (SELECT o_custkey AS k, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS F, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS O FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1) a
 FULL JOIN (SELECT user_id AS k, avg(value) AS click FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.k = b.k""")
def d06(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus in ('F', 'O')").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("feature")).agg(F.avg("o_totalprice").alias("value"))
    e = table(spark, d, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("k"), F.col("event_type").alias("feature")).agg(F.avg("value").alias("value"))
    return rounded(D.assemble({"o": (o, ["F", "O"]), "e": (e, ["click"])}, "k"), 9)


@query("d07_moments", "SELECT event_type, round(avg(value), 6) AS mean, max(value) AS max, min(value) AS min, round(var_pop(value), 5) AS var FROM events GROUP BY 1")
def d07(spark, d):
    m = D.describe_values(table(spark, d, "events"), ["event_type"], "value")
    return m.select("event_type", F.round("mean", 6).alias("mean"), "max", "min", F.round("var", 5).alias("var"))


@query("d07_entropy", """WITH r AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), b AS (SELECT event_type, least(63, floor((value - lo) / (hi - lo) * 64)) AS b, count(*) AS n FROM events JOIN r USING (event_type) GROUP BY 1, 2)
 SELECT event_type, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM b) GROUP BY 1""")
def d07e(spark, d):
    return rounded(D.entropy(table(spark, d, "events"), ["event_type"], "value"))


@query("d08_shells", """WITH v AS (SELECT l_suppkey AS scan, l_partkey % 50 AS x, l_orderkey % 50 AS y, l_quantity AS v FROM lineitem), c AS (SELECT scan, avg(x) AS cx, avg(y) AS cy FROM v GROUP BY 1)
 SELECT scan, floor(sqrt((x - cx) ** 2 + (y - cy) ** 2) / 5)::BIGINT AS shell, count(*) AS n, round(avg(v), 6) AS mean, max(v) AS max FROM v JOIN c USING (scan) GROUP BY 1, 2""")
def d08(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("scan"), (F.col("l_partkey") % 50).alias("x"), (F.col("l_orderkey") % 50).alias("y"), F.col("l_quantity").alias("v"))
    return rounded(D.shells(v, "scan", 5.0))


@query("d09_graph_features", "SELECT o_custkey, round(CASE WHEN count(*) = 1 THEN min(o_totalprice) ELSE stddev_pop(o_totalprice) END, 3) AS f FROM orders GROUP BY 1")
def d09(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    return o.select("o_custkey", F.round(D.graph_feature(F.col("v")), 3).alias("f"))


@query("d10_variance_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING var_pop(value) > 2500) GROUP BY 1")
def d10(spark, d):
    return D.variance_filter(table(spark, d, "events"), "event_type", "value", 2500).groupBy("event_type").agg(F.count("*").alias("n"))


@query("d11_f_scores", """WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_linenumber, l_extendedprice) AS c, corr(l_linenumber, l_tax) AS e FROM lineitem)
 SELECT 'l_quantity' AS feature, round((a*a / (1 - a*a) + b*b / (1 - b*b)) * (n - 2) / 2, 3) AS f FROM c UNION ALL SELECT 'l_linenumber', round((c*c / (1 - c*c) + e*e / (1 - e*e)) * (n - 2) / 2, 3) FROM c""")
def d11(spark, d):
    return rounded(D.f_scores(table(spark, d, "lineitem"), ["l_quantity", "l_linenumber"], ["l_extendedprice", "l_tax"]), 3)


@query("d12_l1_selection")
def d12(spark, d):
    return D.l1_select(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice", 100.0, 3)


@query("d13_pca")
def d13(spark, d):
    e = vectors(spark, d).select("vec_id", *(F.col("embedding")[i].alias(f"v{i}") for i in range(64)))
    return D.pca(e.where("vec_id % 4 <> 0"), e.where("vec_id % 4 = 0"), [f"v{i}" for i in range(64)], 3).select("vec_id", "components")


@query("d12_l1_classes")
def d12c(spark, d):
    x = table(spark, d, "lineitem").withColumn("y", F.when(F.col("l_quantity") < 17, 0.0).when(F.col("l_quantity") < 34, 1.0).otherwise(2.0))
    return D.l1_select(x, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "y", 0.05, 3, kind="class")


@query("d13_pca_by_share", """WITH s AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem) SELECT CASE WHEN (1 + abs(r)) / 2 >= 0.9 THEN 1 ELSE 2 END::BIGINT AS k,
 round(CASE WHEN (1 + abs(r)) / 2 >= 0.9 THEN (1 + abs(r)) / 2 ELSE 1 END, 6) AS share, round((1 + abs(r)) * (n - 1) / n, 6) AS first_variance FROM s""")
def d13s(spark, d):
    x, c = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"]
    _, k, share = D.fit_pca(x, c, 0.9)
    one = D.pca(x, x, c, 0.9).agg(F.max(F.size("components")).cast("long").alias("k"), F.var_pop(F.col("components")[0]).alias("first_variance"))
    return rounded(one.where(F.col("k") == k).select("k", F.lit(share).alias("share"), "first_variance"))


@query("d14_unit_vectors", f"SELECT vec_id, round(sum(v * v) / greatest(sqrt(sum(v * v)), 1e-8) ** 2, 6) AS length, round(max(v) / sqrt(sum(v * v)), 6) AS top FROM {VEC} GROUP BY 1")
def d14(spark, d):
    n = vectors(spark, d).select("vec_id", l2("embedding").alias("u"))
    return rounded(n.select("vec_id", F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x).alias("length"), F.array_max("u").alias("top")))


@query("d15_robust_scaling", """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m, stddev_pop(value) AS s FROM events GROUP BY 1), k AS (SELECT event_type, quantile_cont(abs(value - m), 0.5) * 1.4826 AS d FROM events JOIN m USING (event_type) GROUP BY 1)
 SELECT event_id, round((value - m) / coalesce(CASE WHEN d > 0 THEN d END, CASE WHEN s > 0 THEN s END, 1), 6) AS scaled FROM events JOIN m USING (event_type) JOIN k USING (event_type)""")
def d15(spark, d):
    return rounded(D.robust_scale(table(spark, d, "events"), "event_type", "value").select("event_id", "scaled"))


@query("d16_robust_bounds", "SELECT user_id, count(*) AS n, round(CASE WHEN count(*) < 60 THEN 0 ELSE quantile_cont(value, 0.01) - 0.1 * (quantile_cont(value, 0.99) - quantile_cont(value, 0.01)) END, 6) AS lo, round(CASE WHEN count(*) < 60 THEN 100 ELSE quantile_cont(value, 0.99) + 0.1 * (quantile_cont(value, 0.99) - quantile_cont(value, 0.01)) END, 6) AS hi FROM events GROUP BY 1")
def d16(spark, d):
    return rounded(D.robust_bounds(table(spark, d, "events"), "user_id", "value", 0.1, 60, (0.0, 100.0)))


@query("d17_model_search", "SELECT count(*) AS n, 0.01::DOUBLE AS chosen, true AS ranks_well, true AS flat_is_worse, true AS is_right FROM lineitem")
def d17(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_quantity") > 25).cast("double").alias("y"), "l_quantity", "l_discount", "l_tax")
    rows, scores, best = D.search(x, ["l_quantity", "l_discount", "l_tax"], "y", "logistic", {"regParam": [0.01, 10.0], "elasticNetParam": [1.0]}, 2)
    right = rows.agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("a"), F.count("*").alias("n"))
    # A penalty of 10 leaves no coefficient, so the choice and its lead are the same for any folds.
    return right.select("n", F.lit(best["regParam"]).alias("chosen"), (F.lit(max(scores)) > 0.9).alias("ranks_well"), (F.lit(min(scores)) < 0.6).alias("flat_is_worse"), (F.col("a") > 0.8).alias("is_right"))


@query("d18_cox_loss", f"""WITH s AS (SELECT grp, duration, event, 1.0 + subject % 3 AS w, risk / 250000 AS eta FROM {SURV}), p AS (SELECT grp, duration, sum(w * exp(eta)) AS s, sum(w * event) AS d, sum(w * event * eta) AS l FROM s GROUP BY 1, 2), c AS (SELECT *, sum(s) OVER (PARTITION BY grp ORDER BY duration DESC) AS r FROM p)
 SELECT grp, round(sum(CASE WHEN d > 0 THEN d * ln(r) - l ELSE 0 END) / sum(d), 6) AS loss, sum(d)::DOUBLE AS events FROM c GROUP BY 1""")
def d18(spark, d):
    return rounded(D.cox_sums(survival(spark, d), ["grp"], F.col("risk") / 250000, weight=1.0 + F.col("subject") % 3))


def cox_rounds(rounds: int, alpha: float, ridge: float) -> str:
    """The fit's proximal rounds for two columns, one after the other, each as sums over distinct times."""
    parts = [f"s AS (SELECT duration AS t, event::DOUBLE AS ev, risk / 250000 AS a, (subject % 5)::DOUBLE AS b FROM {SURV})", "b0 AS (SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS y)"]
    for k in range(rounds):
        parts.append(f"""w{k} AS (SELECT t, ev, a, b, exp(a * x + b * y) AS w FROM s, b{k}), p{k} AS (SELECT t, sum(ev) AS d, sum(w) AS s0, sum(w * a) AS sa, sum(w * b) AS sb, sum(w * a * a) AS qa, sum(w * b * b) AS qb, sum(ev * a) AS xa, sum(ev * b) AS xb FROM w{k} GROUP BY 1),
 c{k} AS (SELECT d, xa, xb, sum(s0) OVER o AS s0, sum(sa) OVER o AS sa, sum(sb) OVER o AS sb, sum(qa) OVER o AS qa, sum(qb) OVER o AS qb FROM p{k} WINDOW o AS (ORDER BY t DESC)),
 g{k} AS (SELECT sum(xa - d * sa / s0) / sum(d) AS ga, sum(xb - d * sb / s0) / sum(d) AS gb, sum(d * (qa / s0 - (sa / s0) ** 2)) / sum(d) AS ha, sum(d * (qb / s0 - (sb / s0) ** 2)) / sum(d) AS hb FROM c{k} WHERE d > 0),
 n{k} AS (SELECT 0.9 / (ha * sqrt(2) + {ridge} + 1e-9) AS ta, 0.9 / (hb * sqrt(2) + {ridge} + 1e-9) AS tb, x, y, ga, gb FROM g{k}, b{k}), m{k} AS (SELECT ta, tb, x + ta * (ga - {ridge} * x) AS u, y + tb * (gb - {ridge} * y) AS v FROM n{k}),
 b{k + 1} AS (SELECT CASE WHEN abs(u) > ta * {alpha} THEN sign(u) * (abs(u) - ta * {alpha}) ELSE 0 END AS x, CASE WHEN abs(v) > tb * {alpha} THEN sign(v) * (abs(v) - tb * {alpha}) ELSE 0 END AS y FROM m{k})""")
    return "WITH " + ", ".join(parts) + f" SELECT (SELECT count(*) FROM s) AS n, round(x, 4) AS a, round(y, 4) AS b FROM b{rounds}"


@query("d19_cox_fit", cox_rounds(6, 0.005, 0.005))
def d19(spark, d):
    s = survival(spark, d).withColumns({"a": F.col("risk") / 250000, "b": (F.col("subject") % 5).cast("double")})
    beta = D.cox_fit(s, ["a", "b"], 0.01, 0.5, rounds=6)
    return s.agg(F.count("*").alias("n")).withColumns({"a": F.lit(round(beta[0], 4)), "b": F.lit(round(beta[1], 4))})


def screen_rounds(rounds: int) -> str:
    """Newton rounds of a one-column fit for every feature, unrolled."""
    parts = [f"s AS (SELECT duration AS t, event::DOUBLE AS ev, 'a' AS feature, risk / 250000 AS v FROM {SURV} UNION ALL SELECT duration, event, 'b', (subject % 5)::DOUBLE FROM {SURV})", "b0 AS (SELECT DISTINCT feature, 0.0::DOUBLE AS beta, 0.0::DOUBLE AS h FROM s)"]
    for k in range(rounds):
        parts.append(f"""p{k} AS (SELECT feature, t, sum(ev) AS d, sum(exp(beta * v)) AS s0, sum(exp(beta * v) * v) AS s1, sum(exp(beta * v) * v * v) AS s2, sum(ev * v) AS x FROM s JOIN b{k} USING (feature) GROUP BY 1, 2),
 c{k} AS (SELECT feature, d, x, sum(s0) OVER o AS s0, sum(s1) OVER o AS s1, sum(s2) OVER o AS s2 FROM p{k} WINDOW o AS (PARTITION BY feature ORDER BY t DESC)), g{k} AS (SELECT feature, sum(x - d * s1 / s0) AS g, sum(d * (s2 / s0 - (s1 / s0) ** 2)) AS h FROM c{k} WHERE d > 0 GROUP BY 1),
 b{k + 1} AS (SELECT feature, beta + greatest(-1, least(1, g / g{k}.h)) AS beta, g{k}.h AS h FROM b{k} JOIN g{k} USING (feature))""")
    return "WITH " + ", ".join(parts) + f" SELECT feature, round(beta, 4) AS beta, round(beta * sqrt(h), 4) AS z FROM b{rounds}"


@query("d20_cox_screen", screen_rounds(4))
def d20(spark, d):
    s = survival(spark, d).select("duration", "event", F.explode(F.create_map(F.lit("a"), F.col("risk") / 250000, F.lit("b"), (F.col("subject") % 5).cast("double"))).alias("feature", "value"))
    return rounded(D.cox_screen(s, "feature", "value", rounds=4).drop("p"), 4)


@query("d21_stability", "SELECT p_brand, round(avg((p_size > 12)::INT), 6) AS share FROM part GROUP BY 1 HAVING avg((p_size > 12)::INT) >= 0.75")
def d21(spark, d):
    p = table(spark, d, "part").withColumn("c", F.when(F.col("p_size") > 12, F.col("p_size")).otherwise(0))
    return rounded(D.stability(p, "p_brand", "c", 0.75))


PREDS = f"(SELECT vec_id, m AS model, c AS cls, ({h_sql('vec_id * 10 + m * 3 + c', 4)} % 97 + 1)::DOUBLE AS score FROM embeddings, (VALUES (0), (1), (2)) a(m), (VALUES (0), (1)) b(c))"


def preds(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("model")).select("vec_id", "model", F.explode(F.array(F.lit(0), F.lit(1))).alias("cls"))
    return e.withColumn("score", (h(F.col("vec_id") * 10 + F.col("model") * 3 + F.col("cls"), 4) % 97 + 1).cast("double"))


@query("d22_fused", f"WITH s AS (SELECT vec_id, cls, sum(score * (model + 1) / 6.0) AS s FROM {PREDS} GROUP BY 1, 2) SELECT vec_id, cls, round(s / sum(s) OVER (PARTITION BY vec_id), 9) AS score FROM s")
def d22(spark, d):
    w = spark.createDataFrame([(m, (m + 1) / 6.0) for m in range(3)], "model int, weight double")
    return rounded(D.fuse(preds(spark, d), "vec_id", w), 9)


@query("d22_votes", f"WITH b AS (SELECT vec_id, model, cls FROM {PREDS} QUALIFY row_number() OVER (PARTITION BY vec_id, model ORDER BY score DESC, cls) = 1), n AS (SELECT vec_id, cls, count(*) AS votes FROM b GROUP BY 1, 2) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, cls) = 1")
def d22v(spark, d):
    return D.vote(preds(spark, d), "vec_id")


@query("d23_metric_weights", "SELECT o_custkey, o_orderkey, round(s / sum(s) OVER (PARTITION BY o_custkey), 6) AS weight FROM (SELECT o_custkey, o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 500000 END, 0.5) AS s FROM orders)")
def d23(spark, d):
    o = table(spark, d, "orders").withColumn("score", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 500000))
    return rounded(D.metric_weights(o, "o_custkey").select("o_custkey", "o_orderkey", "weight"))


@query("d24_top_weights", """WITH m AS (SELECT l_returnflag, l_suppkey, round(avg(l_discount - 0.05), 9) AS weight FROM lineitem GROUP BY 1, 2)
 SELECT l_returnflag, l_suppkey, round(weight, 6) AS weight, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(weight) DESC, l_suppkey)::INT AS place FROM m WHERE abs(weight) >= 0.0001 QUALIFY place <= 5""")
def d24(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.avg(F.col("l_discount") - 0.05), 9).alias("c"))
    return rounded(D.top_weights(m, "l_returnflag", "l_suppkey", "c", 5, 0.0001))


@query("d24_summed_weights", """WITH w AS (SELECT l_returnflag || l_linenumber AS outcome, l_suppkey AS feature, round(avg(l_discount - 0.05), 9) AS weight FROM lineitem GROUP BY 1, 2), t AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY abs(weight) DESC, feature) <= 12),
 f AS (SELECT feature FROM t GROUP BY 1 ORDER BY round(sum(abs(weight)), 9) DESC, feature LIMIT 20), o AS (SELECT outcome FROM t GROUP BY 1 ORDER BY round(sum(abs(weight)), 9) DESC, outcome LIMIT 8)
 SELECT outcome, feature, weight FROM t WHERE abs(weight) >= 0.005 AND feature IN (SELECT feature FROM f) AND outcome IN (SELECT outcome FROM o)""")
def d24s(spark, d):
    i = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linenumber").alias("outcome"), F.col("l_suppkey").alias("feature")).agg(F.round(F.avg(F.col("l_discount") - 0.05), 9).alias("weight"))
    return D.summed_weights(i, "outcome", "feature", "weight", 12, 20, 8, 0.005)


@query("d16_positive_bounds", """WITH q AS (SELECT o_custkey % 50 AS unit, count(*) FILTER (o_totalprice > 100000) AS n, quantile_cont(ln(o_totalprice - 100000), 0.01) FILTER (o_totalprice > 100000) AS a, quantile_cont(ln(o_totalprice - 100000), 0.99) FILTER (o_totalprice > 100000) AS b FROM orders GROUP BY 1)
 SELECT unit, n, round(CASE WHEN n < 200 THEN 1 ELSE exp(a - greatest((b - a) * 0.1, 0.05)) END, 3) AS lo, round(CASE WHEN n < 200 THEN 9 ELSE exp(b + greatest((b - a) * 0.1, 0.05)) END, 3) AS hi FROM q""")
def d16p(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("unit"), (F.col("o_totalprice") - 100000).alias("v"))
    return rounded(D.robust_positive_bounds(o, "unit", "v", 200, (1.0, 9.0)), 3)


@query("d27_window_scale", """WITH q AS (SELECT user_id, quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS b FROM events WHERE value <> 0 AND event_type <> 'error' GROUP BY 1)
 SELECT event_id, round(CASE WHEN event_type = 'error' THEN least(1, greatest(0, (value - 5) / 200)) WHEN b > a THEN (least(b, greatest(a, value)) - a) / (b - a) ELSE 0 END, 6) AS scaled FROM events LEFT JOIN q USING (user_id)""")
def d27w(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return rounded(D.window_scale(e, "user_id", "event_type", "value", {"error": (5.0, 205.0)}).select("event_id", "scaled"))


@query("d25_group_ecdf", """WITH b AS (SELECT event_id, event_type, greatest(0, least(49, floor(value / 10)))::BIGINT AS bin FROM events), n AS (SELECT event_type, bin, count(*) AS n FROM b GROUP BY 1, 2), c AS (SELECT event_type, bin, (sum(n) OVER (PARTITION BY event_type ORDER BY bin) - n / 2) / sum(n) OVER (PARTITION BY event_type) AS ecdf FROM n)
 SELECT event_id, bin, round(ecdf, 6) AS ecdf FROM b JOIN c USING (event_type, bin)""")
def d25(spark, d):
    return rounded(D.group_ecdf(table(spark, d, "events"), "event_type", "value", 0.0, 500.0, 50).select("event_id", "bin", "ecdf"))


@query("d26_block_means", "SELECT l_returnflag, floor(l_partkey / 100)::BIGINT AS bx, floor(l_suppkey / 10)::BIGINT AS by, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def d26(spark, d):
    x = table(spark, d, "lineitem").withColumn("y", F.col("l_suppkey") * 10)
    return rounded(D.block_mean(x, ["l_returnflag"], "l_partkey", "y", "l_quantity", 100))


@query("d27_clip_scale", """WITH q AS (SELECT event_type, quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS b FROM events WHERE value <> 0 GROUP BY 1)
 SELECT event_id, round(CASE WHEN b > a THEN (least(b, greatest(a, value)) - a) / (b - a) ELSE 0 END, 6) AS scaled FROM events JOIN q USING (event_type)""")
def d27(spark, d):
    return rounded(D.clip_scale(table(spark, d, "events"), "event_type", "value").select("event_id", "scaled"))
