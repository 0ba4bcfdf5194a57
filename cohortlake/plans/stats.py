"""Queries for reports, resampling and tests."""

from pyspark.sql import functions as F

from cohortlake.functions.prims import h_sql, table
from cohortlake.operators import stats as S

from .cohort import SURV, survival
from .metrics import AUROC, CELLS, CIDX, cells, coarse, rounded
from .registry import query


@query("f01_parsed_runs", r"SELECT p_partkey, p_type AS omics, split_part(p_name, ' ', 1) AS model, lower(p_brand) AS aggregation FROM part")
def f01(spark, d):
    p = table(spark, d, "part").withColumn("path", F.concat_ws("/", F.lit("runs"), "p_type", F.concat(F.split("p_name", " ")[0], F.lit("_x_"), F.lower("p_brand"), F.lit("_results.json"))))
    return p.select("p_partkey", *(c.alias(n) for n, c in S.parse_run(F.col("path")).items()))


@query("f02_flat_metrics", """SELECT l_orderkey, 'fold' || l_linenumber AS fold, 'auc' AS metric, cls::INT AS cls, v AS value FROM (SELECT l_orderkey, l_linenumber, min(l_discount) AS a, max(l_tax) AS b FROM lineitem GROUP BY 1, 2),
 LATERAL (SELECT 0 AS cls, nullif(a, 0) AS v UNION ALL SELECT 1, nullif(b, 0))""")
def f02(spark, d):
    i = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("a"), F.max("l_tax").alias("b"))
    entry = F.struct(F.concat(F.lit("fold"), F.col("l_linenumber")), F.create_map(F.lit("auc"), F.array("a", "b")))
    m = i.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(entry)).alias("metrics"))
    return S.flatten_metrics(m, zero_is_missing=True)


@query("f03_cv_summary", "SELECT l_partkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, round(quantile_cont(l_quantity, 0.025), 6) AS lo, round(quantile_cont(l_quantity, 0.975), 6) AS hi FROM lineitem GROUP BY 1")
def f03(spark, d):
    return rounded(S.cv_summary(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity"))


@query("f04_best_by", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def f04(spark, d):
    return S.best_by(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("f05_ranks", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS b FROM part")
def f05(spark, d):
    r = S.rank_runs(table(spark, d, "part"), {"p_size": True, "p_retailprice": False}, ["p_brand"])
    return r.select("p_partkey", F.col("rank_p_size").cast("long").alias("a"), F.col("rank_p_retailprice").cast("long").alias("b"))


@query("f06_summary", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 3) AS sd, min(o_totalprice) AS min, max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1")
def f06(spark, d):
    s = S.summary(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return s.select("o_orderpriority", "n", *(F.round(c, 3).alias(c) for c in ("mean", "sd")), "min", "max", *(F.round(c, 4).alias(c) for c in ("median", "q1", "q3")))


@query("f07_log_curves", """WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN event_id // 5 END AS e, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events), c AS (SELECT user_id, v, last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM l)
 SELECT user_id, epoch::INT AS epoch, round(avg(v), 9) AS loss, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY 1, 2""")
def f07(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("start of epoch "), F.floor(F.col("event_id") / 5))).otherwise(F.concat(F.lit("step loss "), "value")).alias("line"))
    return S.log_curves(e, "user_id", "event_id", "line").groupBy("user_id", "epoch").agg(F.round(F.avg("loss"), 9).alias("loss"), F.count("*").alias("n"))


@query("f07_fold_curves", """WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN event_id // 50 END AS e, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events), c AS (SELECT user_id % 5 AS fold, v, last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM l),
 f AS (SELECT fold, epoch::INT AS epoch, avg(v) AS v FROM c WHERE v IS NOT NULL AND epoch IS NOT NULL GROUP BY 1, 2) SELECT epoch, count(*) AS folds, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS low, round(max(v), 6) AS high FROM f GROUP BY 1""")
def f07c(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("epoch "), F.floor(F.col("event_id") / 50))).otherwise(F.concat(F.lit("loss "), "value")).alias("line"))
    c = S.log_curves(e, "user_id", "event_id", "line").withColumn("fold", F.col("user_id") % 5)
    return rounded(S.fold_curves(c, "fold", "epoch", "loss"))


@query("f08_with_overall", "SELECT coalesce(c_mktsegment, 'overall') AS c_mktsegment, round(sum(c_acctbal), 2) AS total, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())")
def f08(spark, d):
    return rounded(S.with_overall(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"), 2)


@query("f09_totals", "SELECT p_brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def f09(spark, d):
    return rounded(S.totals(table(spark, d, "part"), "p_brand", "p_retailprice"), 2)


B = 20
X = h_sql(f"({h_sql('key', 1)} + b * 7919)", 2)
WEIGHT = "(" + " + ".join(f"({X} >= {c})::INT" for c in S.POISSON) + ")"
WAUC = """WITH p AS (SELECT {g}, {s} AS score, sum(w * truth) AS pos, sum(w * (1 - truth)) AS neg FROM {t} GROUP BY ALL), c AS (SELECT *, sum(neg) OVER (PARTITION BY {g} ORDER BY score) AS cn FROM p)
 SELECT {g}, sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM c GROUP BY {g}"""
BOOT = f"(SELECT *, {WEIGHT}::DOUBLE AS w FROM (SELECT cls, scan * 100 + p AS key, truth, score, n FROM {CELLS}), generate_series(0, {B - 1}) r(b))"


@query("f10_bootstrap_auroc", f"SELECT cls, round(avg(auroc), 6) AS mean, round(quantile_cont(auroc, 0.025), 6) AS lo, round(quantile_cont(auroc, 0.975), 6) AS hi FROM ({WAUC.format(g='cls, b', s='score', t=BOOT)}) GROUP BY 1")
def f10(spark, d):
    c = cells(spark, d).withColumn("key", F.col("scan") * 100 + F.col("p"))
    return rounded(S.bootstrap_auroc(c, ["cls"], "key", B, 1))


SB = f"(SELECT *, {WEIGHT} AS w FROM (SELECT grp || b AS gb, * FROM (SELECT *, subject AS key FROM {SURV}), generate_series(0, {B - 1}) r(b)))"


@query("f10_bootstrap_c_index", f"""WITH s AS (SELECT * FROM {SB} WHERE w > 0), c AS (SELECT gb, grp, sum(a.w * b.w) AS pairs, sum(a.w * b.w * CASE WHEN a.risk > b.risk THEN 1 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) AS won FROM s a JOIN s b USING (gb, grp)
 WHERE a.event = 1 AND (b.duration > a.duration OR b.duration = a.duration AND b.event = 0) GROUP BY 1, 2) SELECT grp, round(avg(won / pairs), 6) AS mean, round(quantile_cont(won / pairs, 0.025), 6) AS lo, round(quantile_cont(won / pairs, 0.975), 6) AS hi FROM c GROUP BY 1""")
def f10c(spark, d):
    return rounded(S.bootstrap_cindex(survival(spark, d), ["grp"], "subject", B, 1))


@query("f11_bootstrap_difference", f"""SELECT cls, round(avg(x.auroc - y.auroc), 6) AS mean, round(quantile_cont(x.auroc - y.auroc, 0.025), 6) AS lo, round(quantile_cont(x.auroc - y.auroc, 0.975), 6) AS hi
 FROM ({WAUC.format(g='cls, b', s='score', t=BOOT)}) x JOIN ({WAUC.format(g='cls, b', s='n', t=BOOT)}) y USING (cls, b) GROUP BY 1""")
def f11(spark, d):
    c = cells(spark, d).withColumn("key", F.col("scan") * 100 + F.col("p"))
    return rounded(S.bootstrap_diff(c, ["cls"], "key", "score", "n", "truth", B, 1))


Z = 1.959963984540054
T95 = f"({Z} + {(Z**3 + Z) / 4} / v + {(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96} / v ** 2 + {(3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384} / v ** 3 + {(79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160} / v ** 4)"


@query("f12_paired_t_interval", f"""WITH d AS (SELECT o_custkey % 200 AS unit, o_totalprice - s AS d FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
 a AS (SELECT unit, count(*) AS n, count(*) - 1.0 AS v, avg(d) AS diff, stddev_samp(d) AS sd FROM d GROUP BY 1 HAVING count(*) > 5)
 SELECT unit, n - 1 AS df, round(diff - {T95} * sd / sqrt(n), 3) AS conf_low, round(diff + {T95} * sd / sqrt(n), 3) AS conf_high FROM a""")
def f12i(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    o = table(spark, d, "orders").join(s, "o_orderkey").withColumn("unit", F.col("o_custkey") % 200)
    t = S.paired_t(o, ["unit"], "o_totalprice", "s").where("n > 5")
    return rounded(t.select("unit", "df", "conf_low", "conf_high"), 3)


@query("f12_paired_t", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice - s), 4) AS diff, round(stddev_samp(o_totalprice - s), 4) AS sd, round(avg(o_totalprice - s) / (stddev_samp(o_totalprice - s) / sqrt(count(*))), 6) AS t FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def f12(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    t = S.paired_t(table(spark, d, "orders").join(s, "o_orderkey"), ["o_orderpriority"], "o_totalprice", "s")
    return t.select("o_orderpriority", "n", F.round("diff", 4).alias("diff"), F.round("sd", 4).alias("sd"), F.round("t", 6).alias("t"))


#: Two-sided p of Student's t for whole degrees of freedom, as the finite sums of its distribution.
TP = """(1 - CASE WHEN v % 2 = 1 THEN 2 / pi() * (th + CASE WHEN v > 1 THEN sin(th) * list_sum(list_transform(range(((v - 1) // 2)::BIGINT), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * cos(th) ** (2 * k + 1))) ELSE 0 END)
 ELSE sin(th) * list_sum(list_transform(range((v // 2)::BIGINT), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * cos(th) ** (2 * k))) END)"""


@query("f12_paired_t_p", f"""WITH d AS (SELECT o_custkey AS unit, o_totalprice - s AS d FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
 a AS (SELECT unit, count(*)::BIGINT - 1 AS v, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d GROUP BY 1 HAVING count(*) > 1), b AS (SELECT unit, v, t, atan(abs(t) / sqrt(v)) AS th FROM a) SELECT unit, v AS df, round(t, 6) AS t, round({TP}, 6) AS p FROM b""")
def f12p(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    o = table(spark, d, "orders").join(s, "o_orderkey").withColumn("unit", F.col("o_custkey"))
    return rounded(S.paired_t(o, ["unit"], "o_totalprice", "s").where("n > 1").select("unit", "df", "t", "p"))


#: Two-sided p of a normal z by the series of erf.
NP = "(1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(200), lambda k: exp(k * ln(2) + (2 * k + 1) * ln(greatest(z, 1e-300) / sqrt(2)) + lgamma(k + 1) + k * ln(2) - lgamma(2 * k + 2)))))"


@query("f13_mann_whitney_p", f"""WITH e AS (SELECT event_type, floor(value / 10) AS value FROM events), r AS (SELECT a.event_type AS ga, b.event_type AS gb, count(*) FILTER (a.value > b.value) + 0.5 * count(*) FILTER (a.value = b.value) AS u FROM e a JOIN e b ON a.event_type < b.event_type GROUP BY 1, 2), n AS (SELECT event_type, count(*)::DOUBLE AS n FROM e GROUP BY 1),
 c AS (SELECT event_type, value, count(*)::DOUBLE AS c FROM e GROUP BY 1, 2), t AS (SELECT ga, gb, sum(t ** 3 - t) AS ties FROM (SELECT ga, gb, value, sum(c) AS t FROM r JOIN c ON event_type IN (ga, gb) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 x AS (SELECT ga, gb, greatest(abs(u - x.n * y.n / 2) - 0.5, 0) / sqrt(x.n * y.n / 12 * (x.n + y.n + 1 - ties / ((x.n + y.n) * (x.n + y.n - 1)))) AS z FROM r JOIN t USING (ga, gb) JOIN n x ON x.event_type = ga JOIN n y ON y.event_type = gb) SELECT ga, gb, round({NP}, 6) AS p FROM x""")
def f13p(spark, d):
    e = table(spark, d, "events").withColumn("value", F.floor(F.col("value") / 10).cast("double"))
    return rounded(S.mann_whitney(e, "event_type", "value").select("ga", "gb", "p"))


@query("f13_mann_whitney", """WITH r AS (SELECT a.event_type AS ga, b.event_type AS gb, count(*) FILTER (a.value > b.value) + 0.5 * count(*) FILTER (a.value = b.value) AS u FROM events a JOIN events b ON a.event_type < b.event_type GROUP BY 1, 2), n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
 SELECT ga, gb, x.n AS na, y.n AS nb, u::DOUBLE AS u, round((u - x.n * y.n / 2) / sqrt(x.n * y.n * (x.n + y.n + 1) / 12), 6) AS z FROM r JOIN n x ON x.event_type = ga JOIN n y ON y.event_type = gb""")
def f13(spark, d):
    return rounded(S.mann_whitney(table(spark, d, "events"), "event_type", "value").drop("p"))


#: Every replicate's distance over all distinct values, as the integral of the squared gap of distribution functions.
ENERGY = f"""WITH s AS (SELECT *, (event_type = 'error')::INT AS side, event_id AS key FROM events), r AS (SELECT b, value, CASE WHEN b = 0 THEN side ELSE ({X} / 2147483647.0 < (SELECT avg(side) FROM s))::INT END AS side FROM s, generate_series(0, 19) r(b)),
 p AS (SELECT b, value, sum(side) AS x, sum(1 - side) AS y FROM r GROUP BY 1, 2), c AS (SELECT b, sum(x) OVER w / sum(x) OVER (PARTITION BY b) - sum(y) OVER w / sum(y) OVER (PARTITION BY b) AS f, lead(value) OVER (PARTITION BY b ORDER BY value) - value AS d FROM p WINDOW w AS (PARTITION BY b ORDER BY value)),
 e AS (SELECT b, 2 * sum(f * f * coalesce(d, 0)) AS e FROM c GROUP BY 1) SELECT round((SELECT e FROM e WHERE b = 0), 6) AS energy, round((count(*) FILTER (e >= (SELECT e FROM e WHERE b = 0)) + 1) / (count(*) + 1), 6) AS p FROM e WHERE b > 0"""


@query("f14_energy_test", ENERGY)
def f14(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("side"), "value")
    return rounded(S.energy_test(e, "event_id", "side", "value", 19))


@query("f15_benjamini_hochberg", """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice / 5000 END AS p FROM part), r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM p WHERE p IS NOT NULL WINDOW w AS (PARTITION BY p_brand ORDER BY p, p_partkey))
 SELECT p_partkey, round(least(1, min(p * n / r) OVER (PARTITION BY p_brand ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r UNION ALL SELECT p_partkey, NULL FROM p WHERE p IS NULL""")
def f15(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice") / 5000).alias("p"))
    return rounded(S.bh(p, "p", ["p_brand"]).select("p_partkey", "q"), 9)


@query("f15_benjamini_hochberg_all", """WITH r AS (SELECT o_orderkey, o_totalprice / 600000 AS p, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
 SELECT o_orderkey, round(least(1, min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""")
def f15a(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 600000).alias("p"))
    return rounded(S.bh(p, "p").select("o_orderkey", "q"), 9)


@query("f05_ranks_overall", "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC) AS a, rank() OVER (ORDER BY o_custkey) AS b, (rank() OVER (ORDER BY o_totalprice DESC) + rank() OVER (ORDER BY o_custkey)) / 2 AS m FROM orders")
def f05o(spark, d):
    r = S.rank_runs(table(spark, d, "orders"), {"o_totalprice": True, "o_custkey": False})
    return r.select("o_orderkey", F.col("rank_o_totalprice").cast("long").alias("a"), F.col("rank_o_custkey").cast("long").alias("b"), F.col("mean_rank").alias("m"))


@query("f16_correlations", """WITH r AS (SELECT event_type, value, user_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS ry FROM events)
 SELECT event_type, count(*) AS n, round(corr(value, user_id), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""")
def f16(spark, d):
    e = table(spark, d, "events").select("event_type", "value", F.col("user_id").cast("double").alias("u"))
    return rounded(S.correlations(e, ["event_type"], "value", "u"))


@query("f16_levels", f"""WITH e AS (SELECT event_type, user_id, (user_id % 7)::DOUBLE AS t, value AS s FROM events), c AS (SELECT event_type, t, avg(s::DECIMAL(18, 9)) AS m, max(s) AS x FROM e GROUP BY event_type, user_id, t),
 l AS (SELECT event_type, 'row' AS level, t, s FROM e UNION ALL SELECT event_type, 'case_mean', t, m FROM c UNION ALL SELECT event_type, 'case_max', t, x FROM c), a AS (SELECT *, 'all' AS subset FROM l UNION ALL SELECT *, 'positive' FROM l WHERE t > 0),
 r AS (SELECT *, rank() OVER (PARTITION BY event_type, level, subset ORDER BY t) + (count(*) OVER (PARTITION BY event_type, level, subset, t) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY event_type, level, subset ORDER BY s) + (count(*) OVER (PARTITION BY event_type, level, subset, s) - 1) / 2.0 AS rs FROM a),
 g AS (SELECT event_type, level, subset, count(*)::BIGINT AS n, corr(t, s) AS pearson, corr(rt, rs) AS spearman FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 3), p AS (SELECT *, n - 2 AS v, atan(abs(pearson) / sqrt(1 - pearson ** 2)) AS th FROM g)
 SELECT event_type, level, subset, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round({TP}, 6) AS pearson_p FROM p""")
def f16l(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", (F.col("user_id") % 7).cast("double").alias("t"), F.col("value").alias("s"))
    return rounded(S.level_correlations(e, ["event_type"], "user_id", "t", "s").drop("spearman_p"))


@query("f17_channel_correlation", """SELECT l_suppkey, pair, round(c, 6) AS corr FROM (SELECT l_suppkey, corr(l_quantity, l_discount) AS a, corr(l_quantity, l_extendedprice) AS b, corr(l_discount, l_extendedprice) AS c3 FROM lineitem GROUP BY 1),
 LATERAL (SELECT 'l_quantity~l_discount' AS pair, a AS c UNION ALL SELECT 'l_quantity~l_extendedprice', b UNION ALL SELECT 'l_discount~l_extendedprice', c3)""")
def f17(spark, d):
    return rounded(S.channel_corr(table(spark, d, "lineitem"), "l_suppkey", ["l_quantity", "l_discount", "l_extendedprice"]))


@query("f18_probabilities", """WITH p AS (SELECT o_orderkey, [x / (x + y + 1), y / (x + y + 1), 1 / (x + y + 1)] AS p FROM (SELECT o_orderkey, (o_orderkey % 13)::DOUBLE AS x, (o_custkey % 7)::DOUBLE AS y FROM orders))
 SELECT o_orderkey, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)), 6) AS entropy, round(list_max(p), 6) AS top, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin, round(1 / list_sum(list_transform(p, lambda x: x * x)), 6) AS ess FROM p""")
def f18(spark, d):
    x, y = (F.col("o_orderkey") % 13).cast("double"), (F.col("o_custkey") % 7).cast("double")
    o = table(spark, d, "orders").select("o_orderkey", F.array(x / (x + y + 1), y / (x + y + 1), 1 / (x + y + 1)).alias("p"))
    return rounded(S.prob_diagnostics(o, "p").drop("p"))


@query("f19_churn", "SELECT round(avg((c_custkey % 3 <> (c_custkey + (c_nationkey > 12)::INT) % 3)::INT), 6) AS changed FROM customer")
def f19(spark, d):
    c = table(spark, d, "customer")
    a, b = c.select("c_custkey", (F.col("c_custkey") % 3).alias("k")), c.select("c_custkey", ((F.col("c_custkey") + (F.col("c_nationkey") > 12).cast("int")) % 3).alias("k"))
    return rounded(S.churn(a, b, "c_custkey", "k"))


@query("f19_soft_churn", """WITH p AS (SELECT [x / (x + y + 1), y / (x + y + 1), 1 / (x + y + 1)] AS a, [y / (x + y + 2), x / (x + y + 2), 2 / (x + y + 2)] AS b FROM (SELECT (o_orderkey % 13)::DOUBLE AS x, (o_custkey % 7)::DOUBLE AS y FROM orders))
 SELECT round(avg((abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3])) / 2), 6) AS changed FROM p""")
def f19s(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 13).cast("double").alias("x"), (F.col("o_custkey") % 7).cast("double").alias("y"))
    to = lambda a, b, c: F.transform(F.array(a, b, c), lambda v: v / (F.col("x") + F.col("y") + c))
    before, now = o.select("o_orderkey", to(F.col("x"), F.col("y"), F.lit(1.0)).alias("p")), o.select("o_orderkey", to(F.col("y"), F.col("x"), F.lit(2.0)).alias("p"))
    return rounded(S.soft_churn(before, now, "o_orderkey", "p"))


@query("f20_rhat", """WITH e AS (SELECT event_type, user_id % 4 AS chain, event_id, value FROM events), c AS (SELECT event_type, chain, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM e GROUP BY 1, 2),
 x AS (SELECT event_type, value - m AS x, lag(value - m) OVER (PARTITION BY event_type, chain ORDER BY event_id) AS l FROM e JOIN c USING (event_type, chain)), r AS (SELECT event_type, greatest(-0.99, least(0.99, avg(x * l) / avg(x * x))) AS r FROM x GROUP BY 1),
 s AS (SELECT event_type, avg(n) AS n, sum(n) AS k, avg(v) AS w, var_samp(m) AS b FROM c GROUP BY 1) SELECT event_type, round(sqrt(((n - 1) / n * w + b) / w), 6) AS rhat, round(r, 6) AS lag1, round(k * (1 - r) / (1 + r), 3) AS ess FROM s JOIN r USING (event_type)""")
def f20(spark, d):
    r = S.rhat(table(spark, d, "events").withColumn("chain", F.col("user_id") % 4), "event_type", "chain", "event_id", "value")
    return r.select("event_type", F.round("rhat", 6).alias("rhat"), F.round("lag1", 6).alias("lag1"), F.round("ess", 3).alias("ess"))


@query("f21_paired_gap", """WITH j AS (SELECT o_orderpriority AS g, o_totalprice AS a, o_totalprice + (o_orderkey % 5) * 40000 AS b FROM orders), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2.0 AS rb FROM j)
 SELECT g AS o_orderpriority, count(*) AS n, round(corr(ra, rb), 6) AS spearman, round(quantile_cont(abs(a - b), 0.5), 4) AS median_change FROM r GROUP BY 1""")
def f21(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("v"))
    b = o.withColumn("v", F.col("v") + (F.col("o_orderkey") % 5) * 40000)
    g = S.paired_gap(o, b, "o_orderkey", ["o_orderpriority"], "v")
    return g.select("o_orderpriority", "n", F.round("spearman", 6).alias("spearman"), F.round("median_change", 4).alias("median_change"))


EVENTS = ["click", "error", "purchase", "signup", "view"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("f22_presence_matrix", f"""SELECT user_id, {', '.join(f"round(avg(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in EVENTS)} FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1""")
def f22(spark, d):
    return rounded(S.presence_matrix(table(spark, d, "events"), "user_id", "event_type", "value", "error", EVENTS))


@query("f23_significance", f"""WITH e AS (SELECT p_brand AS outcome, p_type AS run, p_retailprice / 20000 AS p FROM part)
 SELECT outcome, {', '.join(f"min(p) FILTER (p < 0.06 AND run = '{t}') AS {t}" for t in TYPES)}, count(*) FILTER (p < 0.06) AS hits FROM e GROUP BY 1
 UNION ALL SELECT 'total', {', '.join(f"count(*) FILTER (p < 0.06 AND run = '{t}')" for t in TYPES)}, count(*) FILTER (p < 0.06) FROM e""")
def f23(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("outcome"), F.col("p_type").alias("run"), (F.col("p_retailprice") / 20000).alias("p"))
    return S.significance_table(p, "outcome", "run", "p", 0.06, TYPES)


@query("f23_significance_ordered", """WITH e AS (SELECT p_brand AS outcome, p_type AS run, p_retailprice / 20000 AS p FROM part), h AS (SELECT outcome, count(*) FILTER (p < 0.06) AS hits, min(p) FILTER (p < 0.06) AS least FROM e GROUP BY 1)
 SELECT outcome, hits, least, row_number() OVER (ORDER BY hits DESC, outcome)::INT AS place FROM h UNION ALL SELECT 'total', count(*) FILTER (p < 0.06), (SELECT max(n) FROM (SELECT count(*) FILTER (p < 0.06) AS n FROM e GROUP BY run)), NULL FROM e""")
def f23o(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("outcome"), F.col("p_type").alias("run"), (F.col("p_retailprice") / 20000).alias("p"))
    t = S.significance_table(p, "outcome", "run", "p", 0.06)
    runs = t.columns[1:-2]
    # Of the totals the first column is the largest; of an outcome the least p of all columns.
    one = F.when(F.col("outcome") == "total", F.col(f"`{runs[0]}`")).otherwise(F.array_min(F.array(*(F.col(f"`{r}`") for r in runs))))
    return t.select("outcome", "hits", one.alias("least"), "place")


@query("f24_parameter_stability", "WITH n AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY p_brand), 6) AS share, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS place FROM n) SELECT * FROM s WHERE place <= 3")
def f24(spark, d):
    return rounded(S.param_stability(table(spark, d, "part"), "p_brand", "p_size"))
