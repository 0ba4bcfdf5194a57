"""Queries for evaluation metrics."""

from pyspark.sql import functions as F

from cohortlake.functions.prims import h, h_sql, materialize, table
from cohortlake.operators import metrics as E

from .cohort import SURV, survival
from .registry import query

CELLS = "(SELECT l_orderkey AS scan, l_returnflag AS cls, l_suppkey AS p, l_linenumber AS n, l_discount * 10 AS score, (l_linestatus = 'F')::INT AS truth, (l_discount > 0.05)::INT AS pred, l_partkey FROM lineitem)"
COUNTS = "count(*) FILTER (truth = 1 AND pred = 1) AS tp, count(*) FILTER (truth = 0 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred = 0) AS fn, count(*) FILTER (truth = 0 AND pred = 0) AS tn"


def cells(spark, d):
    i = table(spark, d, "lineitem")
    return i.select(F.col("l_orderkey").alias("scan"), F.col("l_returnflag").alias("cls"), F.col("l_suppkey").alias("p"), F.col("l_linenumber").alias("n"), (F.col("l_discount") * 10).alias("score"), (F.col("l_linestatus") == "F").cast("int").alias("truth"), (F.col("l_discount") > 0.05).cast("int").alias("pred"), "l_partkey")


def rounded(df, digits=6, *skip):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes))


@query("e01_binary_metrics", f"""SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
 round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity FROM (SELECT cls, {COUNTS} FROM {CELLS} GROUP BY 1)""")
def e01(spark, d):
    return rounded(E.binary_metrics(cells(spark, d), ["cls"]))


AUROC = "SELECT {g}, (sum(rk) FILTER (truth = 1) - count(*) FILTER (truth = 1) * (count(*) FILTER (truth = 1) + 1) / 2.0) / nullif(count(*) FILTER (truth = 1) * count(*) FILTER (truth = 0), 0) AS auroc FROM (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY score) + (count(*) OVER (PARTITION BY {g}, score) - 1) / 2.0 AS rk FROM {t}) GROUP BY {g}"


@query("e05_auroc", f"SELECT cls, round(auroc, 6) AS auroc FROM ({AUROC.format(g='cls', t=CELLS)})")
def e05(spark, d):
    return rounded(E.auroc(cells(spark, d), ["cls"]).select("cls", "auroc"))


@query("e05_auroc_labels", f"SELECT lang, round(auroc, 6) AS auroc FROM ({AUROC.format(g='lang', t='(SELECT lang, quality AS truth, n_chars AS score FROM labels JOIN documents USING (doc_id))')})")
def e05l(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rounded(E.auroc(x.select("lang", F.col("quality").alias("truth"), F.col("n_chars").alias("score")), ["lang"]).select("lang", "auroc"))


AP = """WITH p AS (SELECT {g}, score, sum(truth) AS pos, count(*) AS n FROM {t} GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM p WINDOW w AS (PARTITION BY {g} ORDER BY score DESC))
 SELECT {g}, sum(pos * cp / cn) / nullif(sum(pos), 0) AS auprc FROM c GROUP BY 1"""


@query("e06_auprc", f"SELECT cls, round(auprc, 6) AS auprc FROM ({AP.format(g='cls', t=CELLS)})")
def e06(spark, d):
    return rounded(E.auprc(cells(spark, d), ["cls"]))


MULTI = f"(SELECT vec_id, label % 3 AS truth, {h_sql('vec_id', 1)} % 100 AS s0, {h_sql('vec_id', 2)} % 100 AS s1, {h_sql('vec_id', 3)} % 100 AS s2 FROM embeddings)"


def multi(spark, d):
    """Class (0..2) and three integer scores for each vector."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", (F.col("label") % 3).alias("truth"), F.array(*((h("vec_id", s) % 100).cast("double") for s in (1, 2, 3))).alias("scores"))


@query("e02_one_vs_rest", f"""WITH m AS (SELECT vec_id, truth AS t, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS p, s0, s1, s2 FROM {MULTI}),
 x AS (SELECT cls, (t = cls)::INT AS truth, (p = cls)::INT AS pred, CASE cls WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS score FROM m, (VALUES (0), (1), (2)) v(cls)),
 b AS (SELECT cls, {COUNTS} FROM x GROUP BY 1) SELECT cls, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc
 FROM b JOIN ({AUROC.format(g='cls', t='x')}) USING (cls) JOIN ({AP.format(g='cls', t='x').replace('WITH p AS', 'WITH p AS')}) USING (cls)""")
def e02(spark, d):
    return rounded(E.ovr_metrics(multi(spark, d), [0, 1, 2]))


F1 = """WITH k AS (SELECT {g}, cls, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM (SELECT {g}, truth AS cls, 1 AS t, 0 AS p, (truth = pred)::INT AS tp FROM {x} UNION ALL SELECT {g}, pred, 0, 1, 0 FROM {x}) GROUP BY 1, 2)
 SELECT {g}, sum(t)::BIGINT AS n, round(avg(2.0 * tp / (t + p)), 6) AS macro_f1, round(sum(tp) / sum(t), 6) AS accuracy FROM k GROUP BY 1"""


@query("e03_subgroup_f1", f"SELECT * FROM ({F1.format(g='l_partkey', x=CELLS)}) WHERE n >= 30")
def e03(spark, d):
    return rounded(E.subgroup_f1(cells(spark, d), ["l_partkey"], 30))


@query("e04_confusion", "SELECT l_returnflag AS truth, l_linestatus AS pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY 1, 2")
def e04(spark, d):
    return rounded(E.confusion(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(F.col("l_returnflag").alias("truth"), F.col("l_linestatus").alias("pred"), "n", "share"))


@query("e04_confusion_matrix", """WITH r AS (SELECT l_linenumber % 3 AS t, l_linenumber % 3 + l_linenumber % 4 AS p FROM lineitem), c AS (SELECT t AS k FROM r UNION SELECT p FROM r), n AS (SELECT t, p, count(*) AS n FROM r GROUP BY 1, 2)
 SELECT a.k AS truth, b.k AS pred, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM n x WHERE x.t = a.k), 6) AS share FROM c a CROSS JOIN c b LEFT JOIN n ON n.t = a.k AND n.p = b.k""")
def e04m(spark, d):
    i = table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("truth"), (F.col("l_linenumber") % 3 + F.col("l_linenumber") % 4).alias("pred"))
    return rounded(E.confusion_matrix(i))


PAIRS3 = "(SELECT l_linenumber % 4 AS i, (l_linenumber + (l_discount > 0.06)::INT) % 4 AS j FROM lineitem)"


@query("e07_agreement", f"""WITH c AS (SELECT i, j, count(*)::DOUBLE AS n FROM {PAIRS3} GROUP BY 1, 2), r AS (SELECT i, sum(n) AS r, sum(n) FILTER (i = j) AS dd FROM c GROUP BY 1), k AS (SELECT j, sum(n) AS c FROM c GROUP BY 1),
 x AS (SELECT sum((i - j) ** 2 / 9.0 * r * c) AS we, sum(r * c) FILTER (i = j) AS pe FROM r, k), o AS (SELECT sum(n) AS n, sum((i - j) ** 2 / 9.0 * n) AS wo, sum(n) FILTER (i = j) AS po FROM c)
 SELECT round((SELECT avg(dd / r) FROM r), 6) AS balanced_accuracy, round((po / n - pe / n ** 2) / (1 - pe / n ** 2), 6) AS kappa, round(1 - wo / n / (we / n ** 2), 6) AS quadratic_kappa FROM o, x""")
def e07(spark, d):
    i = table(spark, d, "lineitem").select((F.col("l_linenumber") % 4).alias("truth"), ((F.col("l_linenumber") + (F.col("l_discount") > 0.06).cast("int")) % 4).alias("pred"))
    return rounded(E.agreement(i, 4))


@query("e08_top_k", f"WITH r AS (SELECT (s0 >= own)::INT + (s1 >= own)::INT + (s2 >= own)::INT AS r FROM (SELECT *, CASE truth WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS own FROM {MULTI})) SELECT round(avg((r <= 1)::INT), 6) AS top1, round(avg((r <= 2)::INT), 6) AS top2 FROM r")
def e08(spark, d):
    return rounded(E.topk_acc(multi(spark, d), [1, 2]))


REG = "(SELECT l_returnflag AS grp, l_extendedprice AS truth, l_quantity * 1500 + l_linenumber AS pred FROM lineitem)"


def regression(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("truth"), (F.col("l_quantity") * 1500 + F.col("l_linenumber")).alias("pred"))


@query("e09_regression", f"SELECT grp, count(*) AS n, round(1 - avg((truth - pred) ** 2) / var_pop(truth), 6) AS r2, round(sqrt(avg((truth - pred) ** 2)), 4) AS rmse, round(avg(abs(truth - pred)), 4) AS mae, round(1 - var_pop(truth - pred) / var_pop(truth), 6) AS explained FROM {REG} GROUP BY 1")
def e09(spark, d):
    return E.reg_metrics(regression(spark, d), ["grp"]).select("grp", "n", *(F.round(c, k).alias(c) for c, k in (("r2", 6), ("rmse", 4), ("mae", 4), ("explained", 6))))


@query("e10_above_mean", f"""WITH m AS (SELECT grp, avg(truth) AS mt, avg(pred) AS mp FROM {REG} GROUP BY 1), x AS (SELECT grp, (truth > mt)::INT AS truth, (pred > mp)::INT AS pred FROM {REG} JOIN m USING (grp))
 SELECT grp, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT grp, {COUNTS} FROM x GROUP BY 1)""")
def e10(spark, d):
    return rounded(E.binarised(regression(spark, d), ["grp"]).select("grp", "accuracy", "f1"))


CIDX = """SELECT {g}, count(*)::DOUBLE AS pairs, round((count(*) FILTER (a.risk > b.risk) + 0.5 * count(*) FILTER (a.risk = b.risk)) / count(*), 6) AS c_index FROM {s} a JOIN {s} b USING ({g})
 WHERE a.event = 1 AND (b.duration > a.duration OR b.duration = a.duration AND b.event = 0) GROUP BY 1"""
SURV_R = SURV.replace("o_totalprice AS risk", "floor(o_totalprice / 5000) AS risk")


def coarse(spark, d):
    return survival(spark, d).withColumn("risk", F.floor(F.col("risk") / 5000))


@query("e11_c_index", CIDX.format(g="grp", s=SURV_R))
def e11(spark, d):
    return rounded(E.c_index(coarse(spark, d), ["grp"]))


@query("e12_subgroup_c_index", f"""WITH s AS (SELECT *, grp || (subject % 7) AS sub FROM {SURV_R}), k AS (SELECT sub, count(*) AS n, sum(event)::BIGINT AS events FROM s GROUP BY 1 HAVING count(*) >= 50 AND sum(event) >= 120), x AS (SELECT * FROM s WHERE sub IN (SELECT sub FROM k))
 SELECT sub, pairs, c_index, n, events FROM ({CIDX.format(g='sub', s='x')}) JOIN k USING (sub)""")
def e12(spark, d):
    s = coarse(spark, d).withColumn("sub", F.concat("grp", (F.col("subject") % 7).cast("string")))
    return rounded(E.subgroup_cindex(s, ["sub"], 50, 120))


RISK = f"SELECT grp, duration AS t, sum(event)::BIGINT AS d, count(*) - sum(event)::BIGINT AS c, sum(count(*)) OVER (PARTITION BY grp ORDER BY duration DESC)::BIGINT AS n FROM {SURV} GROUP BY 1, 2"


@query("e13_kaplan_meier", f"SELECT grp, t::BIGINT AS t, d, c, n, round(CASE WHEN bool_or(d = n) OVER w THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END, 6) AS survival FROM ({RISK}) WINDOW w AS (PARTITION BY grp ORDER BY t)")
def e13(spark, d):
    return rounded(E.km(survival(spark, d), ["grp"]).withColumn("t", F.col("t").cast("long")))


@query("e14_risk_groups", f"WITH q AS (SELECT quantile_cont(risk, [0.25, 0.5, 0.75]) AS c FROM {SURV}) SELECT risk_group::INT AS risk_group, count(*) AS n FROM (SELECT (risk > c[1])::INT + (risk > c[2])::INT + (risk > c[3])::INT AS risk_group FROM {SURV}, q) GROUP BY 1")
def e14(spark, d):
    return E.risk_groups(survival(spark, d), "quartile").groupBy("risk_group").agg(F.count("*").alias("n"))


@query("e15_log_rank", f"""WITH s AS (SELECT grp, duration, event, (risk > 250000)::INT AS side FROM {SURV}), p AS (SELECT grp, duration, sum(event) AS d, count(*) AS a, sum(event * side) AS d1, sum(side) AS a1 FROM s GROUP BY 1, 2),
 c AS (SELECT *, sum(a) OVER w AS n, sum(a1) OVER w AS n1 FROM p WINDOW w AS (PARTITION BY grp ORDER BY duration DESC)),
 z AS (SELECT grp, sum(d1)::DOUBLE AS observed, sum(d * n1 / n) AS expected, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance FROM c WHERE d > 0 GROUP BY 1)
 SELECT grp, round(observed, 6) AS observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round((observed - expected) ** 2 / variance, 6) AS chi2 FROM z""")
def e15(spark, d):
    s = survival(spark, d).withColumn("side", (F.col("risk") > 250000).cast("int"))
    return rounded(E.logrank(s, "side", ["grp"]).drop("p"))


@query("e15_log_rank_pairwise", f"""WITH g AS (SELECT DISTINCT grp FROM {SURV}), d AS (SELECT x.grp AS ga, y.grp AS gb FROM g x JOIN g y ON x.grp < y.grp), s AS (SELECT ga, gb, duration, event, (grp = gb)::INT AS side FROM {SURV} JOIN d ON grp = ga OR grp = gb),
 p AS (SELECT ga, gb, duration, sum(event) AS d, count(*) AS a, sum(event * side) AS d1, sum(side) AS a1 FROM s GROUP BY 1, 2, 3), c AS (SELECT *, sum(a) OVER w AS n, sum(a1) OVER w AS n1 FROM p WINDOW w AS (PARTITION BY ga, gb ORDER BY duration DESC)),
 z AS (SELECT ga, gb, sum(d1)::DOUBLE AS observed, sum(d * n1 / n) AS expected, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance FROM c WHERE d > 0 GROUP BY 1, 2)
 SELECT ga, gb, round(observed, 6) AS observed, round(expected, 6) AS expected, round((observed - expected) ** 2 / variance, 6) AS chi2 FROM z""")
def e15p(spark, d):
    return rounded(E.logrank_pairwise(survival(spark, d), "grp").select("ga", "gb", "observed", "expected", "chi2"))


#: Rows with the inverse probability of being uncensored just before their time.
IPCW = f"""(WITH s AS (SELECT * FROM {SURV}), r AS (SELECT duration AS t, sum(1 - event) AS c, sum(count(*)) OVER (ORDER BY duration DESC) AS n FROM s GROUP BY 1),
 g AS (SELECT t, coalesce(CASE WHEN max((c = n)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN c < n THEN ln(1 - c / n) ELSE 0 END) OVER w) END, 1) AS g FROM r WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT s.*, CASE WHEN event = 1 AND g > 0 THEN 1 / g ELSE 0 END AS ipcw FROM s JOIN g ON t = duration)"""


@query("e16_ipcw_weights", f"SELECT grp, round(sum(ipcw), 4) AS weight, count(*) AS n FROM {IPCW} GROUP BY 1")
def e16(spark, d):
    return E.ipcw_weights(survival(spark, d)).groupBy("grp").agg(F.round(F.sum("ipcw"), 4).alias("weight"), F.count("*").alias("n"))


@query("e16_ipcw_concordance", f"""WITH i AS (SELECT *, floor(risk / 5000) AS r FROM {IPCW}) SELECT a.grp, round(sum(a.ipcw ** 2 * CASE WHEN a.r > b.r THEN 1 WHEN a.r = b.r THEN 0.5 ELSE 0 END) / sum(a.ipcw ** 2), 6) AS c_index FROM i a JOIN i b ON a.grp = b.grp
 WHERE a.event = 1 AND a.duration <= 1500 AND (b.duration > a.duration OR b.duration = a.duration AND b.event = 0) GROUP BY 1""")
def e16c(spark, d):
    return rounded(E.ipcw_c_index(coarse(spark, d), ["grp"], tau=1500).select("grp", "c_index"))


TIMES = "(VALUES (200.0::DOUBLE), (500.0), (800.0), (1100.0), (1400.0), (1700.0), (2000.0)) v(h)"


@query("e17_dynamic_auc", f"""WITH r AS (SELECT h, risk, (duration <= h)::INT AS truth, CASE WHEN duration <= h THEN ipcw ELSE 1 END AS w FROM {IPCW}, {TIMES} WHERE duration <= h AND event = 1 OR duration > h),
 p AS (SELECT h, risk, sum(w * truth) AS pos, sum(w * (1 - truth)) AS neg FROM r GROUP BY 1, 2), c AS (SELECT *, sum(neg) OVER (PARTITION BY h ORDER BY risk) AS cn FROM p)
 SELECT h AS at, round(sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)), 6) AS auroc FROM c GROUP BY 1 HAVING sum(pos) * sum(neg) > 0 UNION ALL SELECT h, NULL FROM c GROUP BY 1 HAVING sum(pos) * sum(neg) = 0""")
def e17(spark, d):
    return rounded(E.dynamic_auc(survival(spark, d), [200.0, 500.0, 800.0, 1100.0, 1400.0, 1700.0, 2000.0]))


@query("e18_task_families", f"SELECT family, round(avg(score), 6) AS score, count(*) AS tasks FROM (SELECT 'binary' AS family, auroc AS score FROM ({AUROC.format(g='cls', t=CELLS)}) UNION ALL SELECT 'regression', 1 - avg((truth - pred) ** 2) / var_pop(truth) FROM {REG} GROUP BY grp UNION ALL SELECT 'survival', c_index FROM ({CIDX.format(g='grp', s=SURV_R)})) GROUP BY 1")
def e18(spark, d):
    a = E.auroc(cells(spark, d), ["cls"]).select(F.lit("binary").alias("family"), F.col("auroc").alias("score"))
    r = E.reg_metrics(regression(spark, d), ["grp"]).select(F.lit("regression").alias("family"), F.col("r2").alias("score"))
    c = E.c_index(coarse(spark, d), ["grp"]).select(F.lit("survival").alias("family"), F.round("c_index", 6).alias("score"))
    return rounded(a.union(r).union(c).groupBy("family").agg(F.avg("score").alias("score"), F.count("*").alias("tasks")))


@query("e19_dice_iou", f"SELECT scan, round(2 * sum(pred * truth) / nullif(sum(pred) + sum(truth), 0), 6) AS dice, round(sum(pred * truth) / nullif(sum(pred) + sum(truth) - sum(pred * truth), 0), 6) AS iou FROM {CELLS} GROUP BY 1")
def e19(spark, d):
    return rounded(E.overlap(cells(spark, d), ["scan"], F.col("pred"), F.col("truth")))


@query("e20_semantic_segmentation", """WITH k AS (SELECT cls, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM (SELECT l_linenumber AS cls, 1 AS t, 0 AS p, (l_linenumber = l_suppkey % 7 + 1)::INT AS tp FROM lineitem UNION ALL SELECT l_suppkey % 7 + 1, 0, 1, 0 FROM lineitem) GROUP BY 1)
 SELECT round(avg(tp / (t + p - tp)), 6) AS miou, round(sum(tp / (t + p - tp) * t) / sum(t), 6) AS fwiou, round(avg(tp / nullif(t, 0)), 6) AS macc, round(sum(tp) / sum(t), 6) AS pacc FROM k""")
def e20(spark, d):
    return rounded(E.semseg_metrics(table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("truth"), (F.col("l_suppkey") % 7 + 1).alias("pred"))))


@query("e21_grounding", f"""WITH s AS (SELECT scan, sum(pred * truth) AS i, sum(pred) AS p, sum(truth) AS g FROM {CELLS} GROUP BY 1), m AS (SELECT *, coalesce(i / nullif(p + g - i, 0), 0) AS iou, coalesce(2 * i / nullif(p + g, 0), 0) AS dice FROM s)
 SELECT round(sum(i) / sum(p + g - i), 6) AS ciou, round(avg(iou), 6) AS miou, round(2 * sum(i) / sum(p + g), 6) AS cdice, round(avg(dice), 6) AS mdice, round(avg((iou >= 0.5)::INT), 6) AS p50, round(avg((iou >= 0.75)::INT), 6) AS p75 FROM m""")
def e21(spark, d):
    return rounded(E.grounding_metrics(cells(spark, d), "scan", F.col("pred"), F.col("truth"), [0.5, 0.75]))


BOXES = "(SELECT l_orderkey, l_partkey % 100 AS ax, l_suppkey % 50 AS ay, l_quantity AS aw, l_linenumber * 4.0 AS ah, (l_partkey + l_linenumber) % 100 AS bx, l_suppkey % 50 AS \"by\", l_quantity + 2 AS bw, l_linenumber * 5.0 AS bh FROM lineitem)"


@query("e21_box_iou", f"""WITH o AS (SELECT aw * ah AS a, bw * bh AS b, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, "by" + bh) - greatest(ay, "by")) AS i FROM {BOXES}), u AS (SELECT coalesce(i / nullif(a + b - i, 0), 0) AS iou FROM o)
 SELECT round(avg(iou), 6) AS mbiou, round(avg((iou >= 0.5)::INT), 6) AS b50, round(avg((iou >= 0.75)::INT), 6) AS b75 FROM u""")
def e21b(spark, d):
    c = F.col
    i = table(spark, d, "lineitem").select((c("l_partkey") % 100).alias("ax"), (c("l_suppkey") % 50).alias("ay"), c("l_quantity").alias("aw"), (c("l_linenumber") * 4.0).alias("ah"), ((c("l_partkey") + c("l_linenumber")) % 100).alias("bx"), (c("l_suppkey") % 50).alias("by"), (c("l_quantity") + 2).alias("bw"), (c("l_linenumber") * 5.0).alias("bh"))
    return rounded(E.box_metrics(i, ("ax", "ay", "aw", "ah"), ("bx", "by", "bw", "bh"), [0.5, 0.75]))


SWEEP = "(SELECT b / 100.0 AS threshold, 2.0 * count(*) FILTER (s >= b AND t = 1) / (count(*) FILTER (s >= b) + count(*) FILTER (t = 1)) AS dice FROM (SELECT (l_linenumber * 9 + l_suppkey) % 101 AS s, (l_linestatus = 'F')::INT AS t FROM lineitem), generate_series(0, 100) g(b) GROUP BY b)"


def sweep_rows(spark, d):
    return table(spark, d, "lineitem").select((((F.col("l_linenumber") * 9 + F.col("l_suppkey")) % 101) / 100).alias("s"), (F.col("l_linestatus") == "F").cast("int").alias("t"))


@query("e22_threshold_sweep", f"SELECT round(threshold, 2) AS threshold, round(dice, 6) AS dice FROM {SWEEP}")
def e22(spark, d):
    return rounded(E.threshold_sweep(sweep_rows(spark, d), "s", F.col("t")))


@query("e22_best_threshold", f"SELECT round(threshold, 2) AS threshold, round(dice, 6) AS dice FROM {SWEEP} ORDER BY round(dice, 9) DESC, threshold LIMIT 1")
def e22b(spark, d):
    return rounded(E.best_threshold(sweep_rows(spark, d), "s", F.col("t")))


@query("e23_sensitivity_specificity", f"SELECT th AS threshold, round(count(*) FILTER (truth = 1 AND score >= th) / count(*) FILTER (truth = 1), 6) AS sensitivity, round(count(*) FILTER (truth = 0 AND score < th) / count(*) FILTER (truth = 0), 6) AS specificity FROM {CELLS}, (VALUES (0.15::DOUBLE), (0.35), (0.55), (0.85)) t(th) GROUP BY 1")
def e23(spark, d):
    return rounded(E.sens_spec_curve(cells(spark, d), [0.15, 0.35, 0.55, 0.85]))


@query("e23_quantile_thresholds", """WITH r AS (SELECT o_totalprice AS score, (o_orderstatus = 'F')::INT AS truth FROM orders), q AS (SELECT DISTINCT unnest(quantile_cont(score, [0.1, 0.25, 0.5, 0.75, 0.9])) AS th FROM r)
 SELECT round(th, 4) AS threshold, round(count(*) FILTER (truth = 1 AND score >= th) / count(*) FILTER (truth = 1), 6) AS sensitivity, round(count(*) FILTER (truth = 0 AND score < th) / count(*) FILTER (truth = 0), 6) AS specificity FROM r, q GROUP BY 1""")
def e23q(spark, d):
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("truth"))
    s = E.sens_spec_curve(o, E.quantile_thresholds(o, [0.1, 0.25, 0.5, 0.75, 0.9]))
    return s.select(F.round("threshold", 4).alias("threshold"), F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


@query("e24_case_rollup", f"SELECT cls, p, max(truth) AS truth, round(avg(score), 6) AS score, count(*) AS scans FROM (SELECT cls, p, scan, max(truth) AS truth, max(score) AS score FROM {CELLS} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def e24c(spark, d):
    return rounded(E.case_rollup(cells(spark, d), ["cls", "p"], "scan"))


@query("e24_scan_rollup", f"SELECT scan, max(truth) AS truth, round(max(score), 6) AS score FROM {CELLS} GROUP BY 1")
def e24(spark, d):
    return rounded(E.scan_rollup(cells(spark, d), ["scan"]))


OBJ = """(SELECT l_partkey % 50 AS grp, l_suppkey % 9 AS p, l_linenumber AS g, count(*) AS cnt FROM lineitem GROUP BY 1, 2, 3)"""


@query("e25_matched_objects", f"""WITH o AS (SELECT * FROM {OBJ} WHERE cnt > 2), sp AS (SELECT grp, p, sum(cnt) AS size_p FROM {OBJ} GROUP BY 1, 2), sg AS (SELECT grp, g, sum(cnt) AS size_g FROM {OBJ} GROUP BY 1, 2),
 i AS (SELECT *, cnt / (size_p + size_g - cnt) AS iou FROM o JOIN sp USING (grp, p) JOIN sg USING (grp, g)), b AS (SELECT * FROM i WHERE iou >= 0.08 QUALIFY row_number() OVER (PARTITION BY grp, p ORDER BY iou DESC, g) = 1),
 c AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY grp, p ORDER BY iou DESC, g) = 1), e AS (SELECT * FROM c WHERE iou >= 0.08 QUALIFY row_number() OVER (PARTITION BY grp, g ORDER BY iou DESC, p) = 1),
 n AS (SELECT grp, count(*) AS tp, count(DISTINCT g) AS found FROM e GROUP BY 1)
 SELECT grp, coalesce(tp, 0) AS tp, np - coalesce(tp, 0) AS fp, ng - coalesce(found, 0) AS fn FROM (SELECT grp, count(*) AS np FROM sp GROUP BY 1) JOIN (SELECT grp, count(*) AS ng FROM sg GROUP BY 1) USING (grp) LEFT JOIN n USING (grp)""")
def e25(spark, d):
    o = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("grp"), (F.col("l_suppkey") % 9).alias("p"), F.col("l_linenumber").alias("g")).agg(F.count("*").alias("both"))
    sp, sg = o.groupBy("grp", "p").agg(F.sum("both").alias("size_p")), o.groupBy("grp", "g").agg(F.sum("both").alias("size_g"))
    return E.match_objects(o.where("both > 2"), sp, sg, "grp", 0.08)


@query("e26_froc", f"""WITH t AS (SELECT th AS threshold, count(*) FILTER (truth = 0) / 15000 AS fp_per_scan, count(DISTINCT CASE WHEN truth = 1 THEN scan END) / 12000 AS s FROM {CELLS}, (VALUES (0.15::DOUBLE), (0.45), (0.75)) v(th) WHERE score >= th GROUP BY 1)
 SELECT threshold, round(fp_per_scan, 6) AS fp_per_scan, round(max(s) OVER (ORDER BY threshold DESC), 6) AS sensitivity FROM t""")
def e26(spark, d):
    return rounded(E.froc(cells(spark, d).withColumn("lesion", F.when(F.col("truth") == 1, F.col("scan"))), [0.15, 0.45, 0.75], 15000, 12000))


@query("e26_froc_all_thresholds", f"""WITH t AS (SELECT th AS threshold, count(*) FILTER (truth = 0 AND score >= th) / 15000 AS fp_per_scan, count(DISTINCT CASE WHEN truth = 1 AND score >= th THEN scan END) / 12000 AS sensitivity FROM {CELLS}, (SELECT unnest(range(51)) / 25.0::DOUBLE AS th) GROUP BY 1)
 SELECT threshold, round(fp_per_scan, 6) AS fp_per_scan, round(sensitivity, 6) AS sensitivity FROM t""")
def e26a(spark, d):
    return rounded(E.froc(cells(spark, d).withColumn("lesion", F.when(F.col("truth") == 1, F.col("scan"))), [k / 25 for k in range(51)], 15000, 12000))


@query("e26_precision_recall", f"""WITH t AS (SELECT th AS threshold, count(*) FILTER (truth = 0 AND score >= th) AS fp, count(DISTINCT CASE WHEN truth = 1 AND score >= th THEN scan END) AS tp FROM {CELLS}, (VALUES (0.15::DOUBLE), (0.45), (0.75), (2.0)) v(th) GROUP BY 1)
 SELECT threshold, round(coalesce(tp / nullif(tp + fp, 0), 1), 6) AS precision, round(tp / 12000, 6) AS recall FROM t""")
def e26p(spark, d):
    return rounded(E.lesion_pr(cells(spark, d).withColumn("lesion", F.when(F.col("truth") == 1, F.col("scan"))), [0.15, 0.45, 0.75, 2.0], 12000))


@query("e27_false_positives", f"SELECT quantile_cont(fp, 0.5) AS median, quantile_cont(fp, 0.9) AS p90 FROM (SELECT scan, sum((truth = 0 AND pred = 1)::INT)::DOUBLE AS fp FROM {CELLS} GROUP BY 1)")
def e27(spark, d):
    fp = E.binary_metrics(cells(spark, d), ["scan"])
    return fp.agg(F.percentile("fp", F.lit(0.5)).alias("median"), F.percentile("fp", F.lit(0.9)).alias("p90"))


@query("e29_volumes", f"SELECT scan, cls, round(sum(score) * 2.5, 4) AS volume FROM {CELLS} GROUP BY 1, 2")
def e29(spark, d):
    return rounded(E.volumes(cells(spark, d), ["scan", "cls"], "score", 2.5), 4)


@query("e30_group_max", f"SELECT scan, n, p, CASE WHEN mx IS NULL AND scan % 2 = 0 THEN 0 ELSE mx END AS case_label, k AS labelled FROM (SELECT scan, n, p, max(CASE WHEN score > 0.8 THEN n END) OVER (PARTITION BY scan) AS mx, count(CASE WHEN score > 0.8 THEN n END) OVER (PARTITION BY scan) AS k FROM {CELLS})")
def e30(spark, d):
    c = cells(spark, d).withColumn("label", F.when(F.col("score") > 0.8, F.col("n")))
    return E.propagate_max(c, "scan", "label", F.col("scan") % 2 == 0).select("scan", "n", "p", "case_label", "labelled")


@query("e31_label_problems", """WITH b AS (SELECT l_orderkey AS k, count(*) AS n, min(l_linenumber) AS label FROM lineitem WHERE l_discount > 0.08 GROUP BY 1)
 SELECT o_orderkey AS k, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'double' ELSE 'range' END AS problem FROM orders LEFT JOIN b ON k = o_orderkey WHERE n IS NULL OR n > 1 OR label NOT IN (1, 2, 3)""")
def e31(spark, d):
    b = table(spark, d, "lineitem").where("l_discount > 0.08").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("label"))
    return E.join_labels(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), b, "k", [1, 2, 3])


@query("e32_recall_table", f"""WITH r AS (SELECT cls, n, p, th AS threshold, avg((score >= th)::INT) AS recall FROM {CELLS}, (VALUES (0.25::DOUBLE), (0.55)) v(th) GROUP BY 1, 2, 3, 4)
 SELECT cls, n, threshold, count(*) AS units, round(quantile_cont(recall, 0.25), 6) AS q1, round(quantile_cont(recall, 0.5), 6) AS median, round(quantile_cont(recall, 0.75), 6) AS q3 FROM r GROUP BY 1, 2, 3""")
def e32(spark, d):
    return rounded(E.recall_table(cells(spark, d), ["cls", "n"], "p", [0.25, 0.55]))


@query("e34_clicks_to_iou", "SELECT o_custkey AS item, th AS threshold, coalesce(min(CASE WHEN iou >= th THEN click END), 20)::INT AS clicks FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS click, o_totalprice / 500000 AS iou FROM orders), (VALUES (0.5::DOUBLE), (0.85)) v(th) GROUP BY 1, 2")
def e34(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("click"), (F.col("o_totalprice") / 500000).alias("iou"))
    return E.noc(c, "item", [0.5, 0.85], 20)


MUTUAL = """WITH a AS (SELECT event_id, user_id AS x, value AS y, event_type FROM events), p AS (SELECT a.event_id AS a, b.event_id AS b, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 6) AS dist FROM a JOIN a b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9 WHERE a.event_type = 'error' AND b.event_type = 'signup')
 SELECT a, b, dist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY dist, a) AS rb FROM p) WHERE ra = 1 AND rb = 1"""


@query("e35_mutual_nearest", MUTUAL)
def e35(spark, d):
    from cohortlake.operators.annotations import neighbours

    from .annotations import points

    pts = points(spark, d).select("key", "event_type", "cx", "cy", "min_x", "min_y", "max_x", "max_y")
    at = pts.select("key", "cx", "cy")
    p = neighbours(pts.where("event_type = 'error'"), pts.where("event_type = 'signup'"), 3.0)
    p = p.join(at, "key").join(at.withColumnsRenamed({"key": "n_key", "cx": "nx", "cy": "ny"}), "n_key")
    p = p.select(F.col("key").alias("a"), F.col("n_key").alias("b"), F.round((F.col("cx") - F.col("nx")) ** 2 + (F.col("cy") - F.col("ny")) ** 2, 6).alias("dist"))
    return E.mutual_nearest(p, "a", "b", "dist")


@query("e35_detection_f1", f"""WITH m AS ({MUTUAL}), n AS (SELECT (SELECT count(*) FROM m) AS tp, count(*) FILTER (event_type = 'error') AS p, count(*) FILTER (event_type = 'signup') AS t FROM events)
 SELECT tp, p - tp AS fp, t - tp AS fn, round(tp / (tp + (p - tp + t - tp) / 2), 6) AS f1 FROM n""")
def e35f(spark, d):
    e = table(spark, d, "events")
    return rounded(E.detection_f1(e35(spark, d), e.where("event_type = 'error'"), e.where("event_type = 'signup'")))


def answers(spark, d):
    c = table(spark, d, "conversations")
    q = c.select("conv_id", "turn", F.col("text").alias("truth"))
    return c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")).join(q, ["conv_id", "turn"]).withColumn("key", F.col("conv_id") * 1000 + F.col("turn")).select("key", "answer", "truth")


ANS = """(SELECT b.conv_id * 1000 + b.turn AS key, a.text AS answer, b.text AS truth FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"""
TOK = r"list_filter(string_split_regex(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"


@query("e36_answer_scores", f"""WITH r AS (SELECT key, {TOK.format(c='answer')} AS a, {TOK.format(c='truth')} AS t FROM {ANS}), x AS (SELECT key, w, count(*) AS n FROM (SELECT key, unnest(a) AS w FROM r) GROUP BY 1, 2), y AS (SELECT key, w, count(*) AS m FROM (SELECT key, unnest(t) AS w FROM r) GROUP BY 1, 2),
 c AS (SELECT key, sum(least(n, m)) AS c FROM x JOIN y USING (key, w) GROUP BY 1) SELECT key, (array_to_string(a, ' ') = array_to_string(t, ' '))::INT AS exact, round(coalesce(coalesce(c, 0) / nullif(len(a), 0), 0), 6) AS precision, round(coalesce(coalesce(c, 0) / nullif(len(t), 0), 0), 6) AS recall,
 round(coalesce(2 * coalesce(c, 0) / nullif(len(a) + len(t), 0), 0), 6) AS f1 FROM r LEFT JOIN c USING (key)""")
def e36(spark, d):
    return rounded(E.answer_scores(answers(spark, d), "key", "answer", "truth"))


@query("e37_bleu_2", f"""WITH r AS (SELECT key, {TOK.format(c='answer')} AS a, {TOK.format(c='truth')} AS t FROM {ANS}), g AS (SELECT key, n, side, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM
 (SELECT key, 'a' AS side, a AS w FROM r UNION ALL SELECT key, 't', t FROM r), (VALUES (1), (2)) v(n) WHERE len(w) >= n), k AS (SELECT key, n, g, count(*) FILTER (side = 'a') AS x, count(*) FILTER (side = 't') AS y FROM g GROUP BY 1, 2, 3),
 p AS (SELECT key, n, sum(least(x, y)) AS m, sum(x) AS x FROM k GROUP BY 1, 2 HAVING sum(x) > 0), s AS (SELECT key, count(*) FILTER (m > 0) AS k, avg(CASE WHEN m > 0 THEN ln(m / x) END) AS l FROM p GROUP BY 1)
 SELECT key, round(CASE WHEN k = 2 THEN CASE WHEN len(a) >= len(t) THEN 1 ELSE exp(1 - len(t) / len(a)) END * exp(l) ELSE 0 END, 6) AS bleu FROM r LEFT JOIN s USING (key)""")
def e37(spark, d):
    return rounded(E.bleu(answers(spark, d), "key", "answer", "truth", 2))


@query("e39_judge_summary", "SELECT role, turn % 3 AS domain, count(*) AS n, round(avg(length(text)), 4) AS score, round(sum(length(text)) / (SELECT sum(length(text)) FROM conversations), 6) AS relative FROM conversations GROUP BY 1, 2")
def e39(spark, d):
    c = table(spark, d, "conversations")
    total = c.agg(F.sum(F.length("text")).alias("all"))
    s = c.groupBy("role", (F.col("turn") % 3).alias("domain")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("score"), F.sum(F.length("text")).alias("s"))
    return s.crossJoin(F.broadcast(total)).select("role", "domain", "n", "score", F.round(F.col("s") / F.col("all"), 6).alias("relative"))


@query("e40_top_j_pool", """WITH r AS (SELECT l_partkey AS slide, l_linenumber AS cls, l_extendedprice AS score, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_extendedprice DESC) AS r FROM lineitem), m AS (SELECT slide, j, cls, round(avg(score), 4) AS score FROM r, (VALUES (1), (3)) v(j) WHERE r <= j GROUP BY 1, 2, 3)
 SELECT slide, j, cls, score FROM m QUALIFY row_number() OVER (PARTITION BY slide, j ORDER BY score DESC, cls) = 1""")
def e40(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_partkey").alias("slide"), F.col("l_linenumber").alias("cls"), F.col("l_extendedprice").alias("score"))
    return rounded(E.topj_pool(i, "slide", [1, 3]), 4)


@query("e41_paired_slices", """WITH p AS (SELECT l_orderkey, sum((l_discount > 0.05)::INT) AS p, sum((l_linestatus = 'F' AND l_discount > 0.05)::INT) AS i FROM lineitem GROUP BY 1), g AS (SELECT l_orderkey, sum((l_linestatus = 'F')::INT) AS g FROM lineitem GROUP BY 1)
 SELECT o_orderkey AS slice, round(2 * i / nullif(p + g, 0), 6) AS dice FROM orders LEFT JOIN p ON p.l_orderkey = o_orderkey LEFT JOIN g ON g.l_orderkey = o_orderkey""")
def e41(spark, d):
    m = E.overlap(cells(spark, d), ["scan"], F.col("pred"), F.col("truth")).select(F.col("scan").alias("slice"), "dice")
    return rounded(table(spark, d, "orders").select(F.col("o_orderkey").alias("slice")).join(m, "slice", "left"))


@query("e42_resolved_classes", """WITH l AS (SELECT l_suppkey AS image, l_partkey AS cell, l_linenumber AS cls, round(avg(l_quantity) / 50, 6) AS score FROM lineitem GROUP BY 1, 2, 3), v AS (SELECT * FROM l WHERE score > 0.5), k AS (SELECT image, cls, count(*) AS area, round(avg(score), 9) AS m FROM v GROUP BY 1, 2),
 o AS (SELECT image, cls FROM (SELECT *, area >= 0.12 * sum(area) OVER (PARTITION BY image) OR m = max(m) OVER (PARTITION BY image) AS keep FROM k) WHERE keep)
 SELECT image, cell, cls, score FROM v JOIN o USING (image, cls) QUALIFY row_number() OVER (PARTITION BY image, cell ORDER BY score DESC, cls) = 1""")
def e42(spark, d):
    i = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("image"), F.col("l_partkey").alias("cell"), F.col("l_linenumber").alias("cls")).agg(F.round(F.avg("l_quantity") / 50, 6).alias("score"))
    return E.resolve_classes(i, "image", ["cell"], 0.12).select("image", "cell", "cls", "score")


@query("e38_closed_questions", f"""WITH c AS (SELECT conv_id * 1000 + turn AS key, role, text, (conv_id + turn) % 7 AS truth FROM conversations), a AS (SELECT DISTINCT key, unnest({TOK.format(c='text')}) AS w FROM c),
 k AS (SELECT DISTINCT item_id, unnest({TOK.format(c='text')}) AS w FROM benchmark), n AS (SELECT key, item_id, count(*) AS n FROM a JOIN k USING (w) GROUP BY 1, 2), b AS (SELECT key, item_id FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, item_id) = 1)
 SELECT role, count(*) AS n, round(avg(coalesce((item_id = truth)::INT, 0)), 6) AS accuracy FROM c LEFT JOIN b USING (key) GROUP BY 1""")
def e38(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "role", "text", ((F.col("conv_id") + F.col("turn")) % 7).alias("truth"))
    b = table(spark, d, "benchmark")
    return rounded(E.vqa_accuracy(c, "key", "text", "truth", b, "item_id", "text", ["role"]))


@query("e38_open_questions", f"""WITH r AS (SELECT key, key // 1000 % 3 AS modality, {TOK.format(c='answer')} AS a, {TOK.format(c='truth')} AS t FROM {ANS}),
 c AS (SELECT key, sum(least(n, m)) AS c FROM (SELECT key, w, count(*) AS n FROM (SELECT key, unnest(a) AS w FROM r) GROUP BY 1, 2) x JOIN (SELECT key, w, count(*) AS m FROM (SELECT key, unnest(t) AS w FROM r) GROUP BY 1, 2) y USING (key, w) GROUP BY 1),
 k AS (SELECT DISTINCT array_to_string({TOK.format(c='text')}, ' ') AS text, len(list_distinct({TOK.format(c='text')})) AS n FROM (SELECT truth AS text FROM {ANS})),
 h AS (SELECT key, text, n, count(*) AS k FROM (SELECT DISTINCT key, unnest(a) AS w FROM r) JOIN (SELECT text, n, unnest(list_distinct(string_split(text, ' '))) AS w FROM k WHERE n > 0) USING (w) GROUP BY 1, 2, 3 HAVING count(*) = n),
 b AS (SELECT key, text FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, text) = 1)
 SELECT modality, count(*) AS n, round(avg((array_to_string(a, ' ') = array_to_string(t, ' '))::INT), 6) AS exact, round(avg(coalesce(coalesce(c, 0) / nullif(len(a), 0), 0)), 6) AS precision, round(avg(coalesce(coalesce(c, 0) / nullif(len(t), 0), 0)), 6) AS recall, round(avg(coalesce(2 * coalesce(c, 0) / nullif(len(a) + len(t), 0), 0)), 6) AS f1, round(avg((coalesce(text, '') = array_to_string(t, ' ') AND text IS NOT NULL)::INT), 6) AS hit
 FROM r LEFT JOIN c USING (key) LEFT JOIN b USING (key) GROUP BY 1""")
def e38o(spark, d):
    a = materialize(answers(spark, d).withColumn("modality", F.floor(F.col("key") / 1000) % 3))
    return rounded(E.open_accuracy(a, "key", "answer", "truth", a.select("truth"), "truth", ["modality"], 2).drop("bleu"))
