"""Reports over result tables, resampling and significance tests."""

from math import erf, pi, tan

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.prims import M, corr, exact_mean, first_by, h, mid_ranks, prefix
from cohortlake.functions.special import correlation_p, normal_p, t_p

from .metrics import auroc, drawn_c_index, ratio


def parse_run(path) -> dict[str, Column]:
    """Model, omics and aggregation of ``.../<omics>/<model>_<aggregation>_results.json``."""
    seg = F.split(path, "/")
    name = F.regexp_extract(F.element_at(seg, -1), r"^(.*)_results\.json$", 1)
    return {"omics": F.element_at(seg, -2), "model": F.regexp_extract(name, r"^([^_]+)", 1), "aggregation": F.regexp_extract(name, r"_([^_]+)$", 1)}


def flatten_metrics(df: DataFrame, column: str = "metrics", zero_is_missing: bool = False) -> DataFrame:
    """map<fold, map<metric, array<double>>> -> (.., fold, metric, cls, value)."""
    keys = [c for c in df.columns if c != column]
    out = df.select(*keys, F.explode(column).alias("fold", "_m")).select(*keys, "fold", F.explode("_m").alias("metric", "_v")).select(*keys, "fold", "metric", F.posexplode("_v").alias("cls", "value"))
    return out.withColumn("value", F.when(F.col("value") != 0, F.col("value"))) if zero_is_missing else out


def cv_summary(df: DataFrame, group: list[str], value: str, ddof: int = 0) -> DataFrame:
    """Mean, standard deviation and 2.5 / 97.5 percentiles over folds; NaN is no value."""
    v = F.when(~F.isnan(value), F.col(value))
    sd = F.stddev_samp(v) if ddof else F.stddev_pop(v)
    return df.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), sd.alias("sd"), F.percentile(v, F.lit(0.025)).alias("lo"), F.percentile(v, F.lit(0.975)).alias("hi"))


def best_by(df: DataFrame, group: list[str], metric: str, tie: str, ascending: bool = False) -> DataFrame:
    return first_by(df, group, F.col(metric).asc() if ascending else F.col(metric).desc(), F.col(tie))


def rank_runs(df: DataFrame, metrics: dict[str, bool], group: list[str] | None = None) -> DataFrame:
    """Competition ranks; {metric: higher is better}, and their mean; missing metrics have no rank."""
    out, g = df, group or []
    for m, up in metrics.items():
        p = prefix(df.where(F.col(m).isNotNull()), g, m, {"_n": F.lit(1)}, descending=up)
        out = out.join(p.select(*g, m, (F.col("_n_upto") - F.col("_n") + 1).alias(f"rank_{m}")), [*g, m], "left")
    return out.select(*df.columns, *(f"rank_{m}" for m in metrics)).withColumn("mean_rank", sum(F.col(f"rank_{m}") for m in metrics) / len(metrics))


def summary(df: DataFrame, group: list[str], v: str) -> DataFrame:
    q = lambda x: F.percentile(v, F.lit(x))
    return df.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"))


def log_curves(lines: DataFrame, file: str, line: str, text: str) -> DataFrame:
    """Carries the epoch of ``epoch N`` lines forward to the ``loss X`` lines after it."""
    epoch = F.regexp_extract(text, r"epoch (\d+)", 1)
    loss = F.regexp_extract(text, r"loss ([0-9.]+)", 1)
    w = Window.partitionBy(file).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("epoch", F.last(F.when(epoch != "", epoch.cast("int")), ignorenulls=True).over(w))
    return out.where(loss != "").select(file, "epoch", loss.cast("double").alias("loss"))


def fold_curves(curves: DataFrame, fold: str, epoch: str, value: str, group: list[str] | None = None) -> DataFrame:
    """A curve over folds: each fold's mean at an epoch, then their number, mean, standard deviation and range."""
    g = group or []
    one = curves.where(F.col(epoch).isNotNull()).groupBy(*g, fold, epoch).agg(F.avg(value).alias("_v"))
    return one.groupBy(*g, epoch).agg(F.count("*").alias("folds"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("sd"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def with_overall(df: DataFrame, group: str, value: str, label: str = "overall") -> DataFrame:
    """Sums and counts by group, and over all of them."""
    s = df.groupBy(group).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    return s.unionByName(s.agg(F.lit(label).alias(group), F.sum("total").alias("total"), F.sum("n").alias("n")))


def totals(df: DataFrame, category: str, value: str) -> DataFrame:
    return df.groupBy(category).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), category)


# --- resampling -----------------------------------------------------------------------

#: Cumulative Poisson(1) probabilities times 2147483647: weight k where the hash is below the k-th, at most 7.
POISSON = [790015084, 1580030168, 1975037710, 2106706891, 2139624186, 2146207645, 2147304888]


def dealt(df: DataFrame, key: str, first: int, last: int, seed: int, name: str) -> DataFrame:
    """Rows by replicate ``b`` (first to last), each with a hash of its key and replicate.

    Both hashes pass a generator, which binds them: as plain expressions they would be put in
    anew wherever a weight names them, more code than the JVM compiles.
    """
    rows = df.withColumn("_k", F.explode(F.array(h(key, seed)))).withColumn("b", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return rows.withColumn(name, F.explode(F.array(h(F.col("_k") + F.col("b").cast("long") * 7919, seed + 1)))).drop("_k")


def replicates(df: DataFrame, key: str, b: int, seed: int) -> DataFrame:
    """Rows by replicate with their integer weight (Poisson bootstrap); weight 0 is left out."""
    weight = sum(F.when(F.col("_x") >= c, 1).otherwise(0) for c in POISSON)
    return dealt(df, key, 0, b - 1, seed, "_x").where(F.col("_x") >= POISSON[0]).withColumn("w", weight.cast("double")).drop("_x")


def interval(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.975)).alias("hi"))


def bootstrap_auroc(df: DataFrame, group: list[str], key: str, b: int = 100, seed: int = 1, truth: str = "truth", score: str = "score") -> DataFrame:
    return interval(auroc(replicates(df, key, b, seed), [*group, "b"], truth, score, F.col("w")), group, "auroc")


def bootstrap_cindex(df: DataFrame, group: list[str], key: str, b: int = 100, seed: int = 1) -> DataFrame:
    """Interval of the concordance index over replicates; their weights, those of ``replicates``, are drawn where pairs are counted."""
    return interval(drawn_c_index(df, group, h(key, seed), lambda k: weights(k, b, seed)), group, "c_index")


def weights(k: np.ndarray, b: int, seed: int) -> np.ndarray:
    """The weights of ``replicates`` for keys' hashes: a row for each of b replicates."""
    out = np.zeros((b, len(k)), np.uint8)
    for i in range(b):
        u = ((k + i * 7919) % M * 48271 + (seed + 1) * 40503 + 11) % M
        v = (u * u + 12345) % M
        out[i] = np.searchsorted(POISSON, (v * 69621 + u) % M, side="right")
    return out


def bootstrap_diff(df: DataFrame, group: list[str], key: str, score_a: str, score_b: str, truth: str = "truth", b: int = 100, seed: int = 1) -> DataFrame:
    """Interval of AUROC(a) - AUROC(b) with the same weights for both."""
    r = replicates(df, key, b, seed)
    x = auroc(r, [*group, "b"], truth, score_a, F.col("w")).select(*group, "b", F.col("auroc").alias("_a"))
    y = auroc(r, [*group, "b"], truth, score_b, F.col("w")).select(*group, "b", F.col("auroc").alias("_b"))
    return interval(x.join(y, [*group, "b"]).withColumn("diff", F.col("_a") - F.col("_b")), group, "diff")


# --- tests ----------------------------------------------------------------------------


def t_quantile(df_, z: float) -> Column:
    """The t value of the probability of normal quantile z: exact for 1 and 2 degrees of freedom, else an
    expansion in 1 / df (to 0.002 at 3, 0.0003 at 4, better above)."""
    v = df_.cast("double")
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    wide = F.lit(z) + sum(F.lit(c) / F.pow(v, F.lit(float(i + 1))) for i, c in enumerate(g))
    p = 0.5 * (1 + erf(z / 2**0.5))
    a = 4 * p * (1 - p)
    return F.when(v <= 0, None).when(v == 1, tan(pi * (p - 0.5))).when(v == 2, 2 * (p - 0.5) * (2 / a) ** 0.5).otherwise(wide)


def paired_t(df: DataFrame, group: list[str], a: str, b: str, z: float = 1.959963984540054) -> DataFrame:
    """Paired t statistic over complete rows: n, mean difference, t, degrees of freedom, interval (95 %) and two-sided p."""
    d = F.col(a) - F.col(b)
    s = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.avg(d).alias("diff"), F.stddev_samp(d).alias("sd"))
    half = t_quantile(F.col("n") - 1, z) * F.col("sd") / F.sqrt("n")
    out = s.withColumns({"t": ratio("diff", F.col("sd") / F.sqrt("n")), "df": F.col("n") - 1, "conf_low": F.col("diff") - half, "conf_high": F.col("diff") + half})
    return out.withColumn("p", t_p("t", "df"))


def mann_whitney(df: DataFrame, group: str, value: str, least: int = 2) -> DataFrame:
    """U, z and a two-sided p for every pair of groups with at least ``least`` values; pairs of groups, never of rows.

    p is that of the normal approximation, with the variance less its part for ties and half a
    rank for continuity; null where all values are the same.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    a, b = n.select(F.col(group).alias("ga"), F.col("n").alias("na")), n.select(F.col(group).alias("gb"), F.col("n").alias("nb"))
    duels = a.join(b, F.col("ga") < F.col("gb")).withColumn("_g", F.explode(F.array("ga", "gb")))
    cnt = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    both = cnt.join(duels, "_g")
    own = lambda g: F.when(F.col("_g") == F.col(g), F.col("c")).otherwise(0)
    p = prefix(both, ["ga", "gb", "na", "nb"], "v", {"a": own("ga"), "b": own("gb")})
    t = (F.col("a") + F.col("b")).cast("double")
    u = p.groupBy("ga", "gb", "na", "nb").agg(F.sum(F.col("a") * (F.col("b_upto") - F.col("b") / 2)).alias("u"), F.sum(t**3 - t).alias("_ties"))
    n = F.col("na") + F.col("nb")
    mu, var = F.col("na") * F.col("nb") / 2, F.col("na") * F.col("nb") / 12
    spread = F.sqrt(var * (n + 1 - F.col("_ties") / (n * (n - 1))))
    p_value = F.when(spread > 0, normal_p(F.greatest(F.abs(F.col("u") - mu) - 0.5, F.lit(0.0)) / spread))
    return u.withColumn("z", (F.col("u") - mu) / F.sqrt(var * (n + 1))).withColumn("p", p_value).drop("_ties")


def energy_test(df: DataFrame, key: str, side: str, value: str, perms: int, seed: int = 1) -> DataFrame:
    """Energy distance of two samples of one number and a permutation p value.

    The distance is 2 * integral of (F - G)^2, from distribution functions over distinct
    values; replicate 0 has the given sides, the others sides dealt out by hash.
    """
    share = df.agg(F.avg(F.col(side).cast("double")).alias("_s"))
    drawn = (F.col("_x") / 2147483647.0 < F.col("_s")).cast("int")
    rows = dealt(df, key, 0, perms, seed, "_x").crossJoin(F.broadcast(share)).withColumn("_side", F.when(F.col("b") == 0, F.col(side)).otherwise(drawn))
    p = prefix(rows, ["b"], value, {"x": F.col("_side").cast("double"), "y": 1.0 - F.col("_side")})
    w = Window.partitionBy("b")
    f = F.col("x_upto") / F.sum("x").over(w) - F.col("y_upto") / F.sum("y").over(w)
    p = p.withColumn("_f", f).withColumn("_d", F.lead(value).over(w.orderBy(value)) - F.col(value))
    e = p.groupBy("b").agg((2 * F.sum(F.col("_f") ** 2 * F.coalesce("_d", F.lit(0.0)))).alias("e"))
    own = e.where("b = 0").select(F.col("e").alias("energy"))
    return e.where("b > 0").crossJoin(F.broadcast(own)).groupBy("energy").agg(((F.count_if(F.col("e") >= F.col("energy")) + 1) / (F.count("*") + 1)).alias("p"))


def bh(df: DataFrame, p: str, group: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p values; missing stays missing.

    Equal p values share the rank of the last of them, the one that decides; minima run from the
    largest p value down.
    """
    g = group or []
    at = prefix(df.where(F.col(p).isNotNull()), g, p, {"_n": F.lit(1)})
    n = df.where(F.col(p).isNotNull()).groupBy(*g).agg(F.count("*").alias("_all"))
    at = at.join(n, g) if g else at.crossJoin(F.broadcast(n))
    low = prefix(at, g, p, {"_q": F.col(p) * F.col("_all") / F.col("_n_upto")}, descending=True, least=True)
    q = low.select(*g, p, F.least(F.lit(1.0), "_q_upto").alias("q"))
    return df.join(q, [*g, p], "left").select(*df.columns, "q")


def correlations(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Pearson, and Spearman on mid-ranks; null where a side is constant."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = mid_ranks(mid_ranks(d, group, x, "_rx"), group, y, "_ry")
    return r.groupBy(*group).agg(F.count("*").alias("n"), corr(x, y).alias("pearson"), corr("_rx", "_ry").alias("spearman"))


def correlation_tests(df: DataFrame, group: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """``correlations`` with two-sided p values, for groups of at least ``least`` complete pairs."""
    c = correlations(df, group, x, y).where(F.col("n") >= least)
    return c.withColumns({"pearson_p": correlation_p("pearson", "n"), "spearman_p": correlation_p("spearman", "n")})


def level_correlations(df: DataFrame, group: list[str], case: str, target: str, score: str) -> DataFrame:
    """Correlations of a score with its target by level and subset of targets.

    Levels: every row (``row``), a case's mean score (``case_mean``) and largest one (``case_max``),
    against the case's target, of which it has one.  Means are exact, so that cases of equal means
    are ties.  Subsets: ``all`` and those over 0 (``positive``).
    """
    row = df.select(*group, F.lit("row").alias("level"), F.col(target).alias("_t"), F.col(score).alias("_s"))
    one = df.groupBy(*group, case).agg(F.max(target).alias("_t"), exact_mean(score).alias("case_mean"), F.max(score).alias("case_max"))
    levels = row.unionByName(one.unpivot([*group, "_t"], ["case_mean", "case_max"], "level", "_s"))
    subsets = F.when(F.col("_t") > 0, F.array(F.lit("all"), F.lit("positive"))).otherwise(F.array(F.lit("all")))
    return correlation_tests(levels.withColumn("subset", F.explode(subsets)), [*group, "level", "subset"], "_t", "_s")


def channel_corr(df: DataFrame, group: str, channels: list[str]) -> DataFrame:
    """Correlation of every pair of columns; null where one is constant."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]
    one = df.groupBy(group).agg(*(corr(a, b).alias(f"{a}~{b}") for a, b in pairs))
    return one.unpivot(group, [f"{a}~{b}" for a, b in pairs], "pair", "corr")


def prob_diagnostics(df: DataFrame, probs: str) -> DataFrame:
    """Entropy, largest probability, margin of the top two and effective number."""
    p, s = F.col(probs), F.reverse(F.array_sort(probs))
    ent = -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return df.withColumns({"entropy": ent, "top": s[0], "margin": s[0] - s[1], "ess": 1 / F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x)})


def churn(prev: DataFrame, cur: DataFrame, key: str, label: str) -> DataFrame:
    """Share of keys whose label changed."""
    return prev.select(key, F.col(label).alias("_p")).join(cur.select(key, F.col(label).alias("_c")), key).agg(F.avg((F.col("_p") != F.col("_c")).cast("double")).alias("changed"))


def soft_churn(prev: DataFrame, cur: DataFrame, key: str, probs: str) -> DataFrame:
    """Mean total variation between a key's class probabilities before and after."""
    both = prev.select(key, F.col(probs).alias("_p")).join(cur.select(key, F.col(probs).alias("_c")), key)
    gap = F.aggregate(F.zip_with("_p", "_c", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 2
    return both.agg(F.avg(gap).alias("changed"))


def rhat(df: DataFrame, param: str, chain: str, step: str, value: str) -> DataFrame:
    """Potential scale reduction over chains, lag-one correlation about each chain's mean, and effective sample size.

    Chains that don't vary have a null ``rhat`` and an effective size of 0.
    """
    c = df.groupBy(param, chain).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    s = c.groupBy(param).agg(F.avg("n").alias("n"), F.sum("n").alias("all"), F.avg("v").alias("w"), F.var_samp("m").alias("b"))
    out = s.withColumn("rhat", F.when(F.col("w") > 0, F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w"))))
    x = df.join(c.select(param, chain, "m"), [param, chain]).withColumn("_x", F.col(value) - F.col("m"))
    x = x.withColumn("_l", F.lag("_x").over(Window.partitionBy(param, chain).orderBy(step)))
    lag = x.groupBy(param).agg(ratio(F.avg(F.col("_x") * F.col("_l")), F.avg(F.col("_x") ** 2)).alias("_r"))
    r = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("_r")))
    return out.join(lag, param).select(param, "rhat", r.alias("lag1"), F.when(F.col("w") > 0, F.col("all") * (1 - r) / (1 + r)).otherwise(0.0).alias("ess"))


def paired_gap(a: DataFrame, b: DataFrame, key: str, group: list[str], value: str) -> DataFrame:
    """Spearman and median absolute change between two fits."""
    j = a.select(key, *group, F.col(value).alias("_a")).join(b.select(key, *group, F.col(value).alias("_b")), [key, *group])
    return correlations(j, group, "_a", "_b").join(j.groupBy(*group).agg(F.percentile(F.abs(F.col("_a") - F.col("_b")), F.lit(0.5)).alias("median_change")), group).drop("pearson")


def presence_matrix(df: DataFrame, item: str, cls: str, metric: str, wanted: str, classes: list[str]) -> DataFrame:
    """Class columns for the items that have the wanted class, best first, missing last."""
    has = df.where(F.col(cls) == wanted).select(item).distinct()
    return df.join(has, item, "left_semi").groupBy(item).pivot(cls, classes).avg(metric).orderBy(F.desc_nulls_last(wanted), item)


def significance_order(df: DataFrame, run: str, p: str, alpha: float) -> list[str]:
    """Runs, which become columns, by their number of p values under alpha, the most first (ties: by name)."""
    n = df.groupBy(run).agg(F.count_if(F.col(p) < alpha).alias("n")).collect()
    return [r[run] for r in sorted(n, key=lambda r: (-r["n"], r[run]))]


def significance_table(df: DataFrame, outcome: str, run: str, p: str, alpha: float, runs: list[str] | None = None) -> DataFrame:
    """p values under alpha by outcome and run, with their number, and a row of totals.

    Without ``runs`` all of them are columns, by their number of hits, and the outcomes' ``place``
    by theirs is added (the totals have none).
    """
    if runs is None:
        t = significance_table(df, outcome, run, p, alpha, significance_order(df, run, p, alpha))
        total = F.col(outcome) == "total"
        place = F.row_number().over(Window.partitionBy(total).orderBy(F.desc("hits"), outcome))
        return t.withColumn("place", F.when(~total, place))
    hit = df.withColumn("_p", F.when(F.col(p) < alpha, F.col(p)))
    t = hit.groupBy(outcome).pivot(run, runs).agg(F.min("_p")).join(hit.groupBy(outcome).agg(F.count("_p").alias("hits")), outcome)
    total = hit.groupBy(F.lit("total").alias(outcome)).pivot(run, runs).agg(F.count("_p").cast("double")).join(hit.agg(F.count("_p").alias("hits")))
    return t.unionByName(total)


def param_stability(df: DataFrame, model: str, params: str, top: int = 3) -> DataFrame:
    """Share of folds by setting, the most frequent ones first."""
    n = df.groupBy(model, params).agg(F.count("*").alias("n"))
    n = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(model)))
    w = Window.partitionBy(model).orderBy(F.desc("n"), params)
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
