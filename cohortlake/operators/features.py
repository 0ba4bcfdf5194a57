"""Patient-level features and models."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.prims import col, corr, elements, first_by, forget, gather, materialize, prefix

from .metrics import chi2_p, ratio


def pool_features(df: DataFrame, unit: str, subject: str, vector: str, how1: str = "mean", how2: str = "mean") -> DataFrame:
    """Instance vectors -> units -> subjects, element by element: (subject, pos, value)."""
    one = elements(df, [subject, unit], vector, {"v": how1})
    made = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_pop, "std_sample": F.stddev_samp}
    return one.groupBy(subject, "pos").agg(made[how2]("v").alias("value"))


def pool_subset(df: DataFrame, subject: str, cls: str, vector: str, lo: int, hi: int) -> DataFrame:
    """Mean vector of the instances in a class range; zeros where there is none."""
    some = elements(df.where(F.col(cls).between(lo, hi)), [subject], vector, {"value": "mean"})
    every = df.groupBy(subject).agg(F.max(F.size(vector)).alias("_n")).select(subject, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("pos"))
    return every.join(some, [subject, "pos"], "left").fillna(0.0, ["value"])


def kmeans_pool(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """Standardised k-means: a row a cluster with its size and column means."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=columns, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), KMeans(k=k, seed=seed, featuresCol="_s", predictionCol="cluster")]
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))


def voted_embedding(df: DataFrame, subject: str, text: str, order: str, vector: str) -> DataFrame:
    """The mean vector of a subject's most frequent text (ties: the first seen)."""
    n = df.groupBy(subject, text).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = first_by(n, [subject], F.desc("_n"), F.col("_first")).select(subject, text)
    return elements(df.join(best, [subject, text]), [subject, text], vector, {"value": "mean"})


def select_features(long: DataFrame, feature: str, families: list[str]) -> DataFrame:
    return long.where(F.col(feature).rlike("^(" + "|".join(families) + ")") & ~F.col(feature).rlike("diagnostics"))


def assemble(tables: dict[str, tuple[DataFrame, list[str]]], subject: str) -> DataFrame:
    """Long tables (subject, feature, value) with their features -> wide, side by side on the subject."""
    out = None
    for name, (long, names) in tables.items():
        wide = long.groupBy(subject).pivot("feature", names).agg(F.first("value"))
        wide = wide.select(subject, *(F.col(c).alias(f"{name}_{c}") for c in names))
        out = wide if out is None else out.join(wide, subject, "full_outer")
    return out


def describe_values(df: DataFrame, group: list[str], v: str) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.var_pop(v).alias("var"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"))


def entropy(df: DataFrame, group: list[str], v: str, bins: int = 64) -> DataFrame:
    """Entropy in bits of a histogram over the group's range."""
    r = df.groupBy(*group).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0)
    h = df.join(F.broadcast(r), group).groupBy(*group, b.alias("_b")).agg(F.count("*").alias("_n"))
    p = F.col("_n") / F.sum("_n").over(Window.partitionBy(*group))
    return h.withColumn("_p", p).groupBy(*group).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


def shells(voxels: DataFrame, scan: str, thickness: float) -> DataFrame:
    """Statistics of v by distance shell about the scan's centroid."""
    c = voxels.groupBy(scan).agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"))
    d = voxels.join(c, scan).withColumn("shell", F.floor(F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2) / thickness))
    return d.groupBy(scan, "shell").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("max"))


def graph_feature(values: Column, default: float = 0.0) -> Column:
    """A list of one as it is, a longer one as its standard deviation, missing as the default."""
    m = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    sd = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(values))
    return F.when(values.isNull() | (F.size(values) == 0), default).when(F.size(values) == 1, values[0]).otherwise(sd)


def variance_filter(long: DataFrame, feature: str, value: str, t: float) -> DataFrame:
    ok = long.groupBy(feature).agg(F.var_pop(value).alias("_v")).where(F.col("_v") > t).select(feature)
    return long.join(ok, feature, "left_semi")


def f_scores(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Mean F statistic of each feature over the targets, in one pass."""
    n = df.agg(F.count("*").alias("n"), *(corr(f, t).alias(f"{f}~{t}") for f in features for t in targets))
    r2 = lambda f, t: F.col(f"{f}~{t}") ** 2
    score = lambda f: sum(r2(f, t) / (1 - r2(f, t)) * (F.col("n") - 2) for t in targets) / len(targets)
    return n.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), score(f).alias("f")) for f in features))).alias("s")).select("s.*")


def _vector(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


def _ranked(df: DataFrame, columns: list[str], coef, top: int, floor: float) -> DataFrame:
    rows = sorted(((c, float(w)) for c, w in zip(columns, coef) if abs(w) >= floor), key=lambda x: (-abs(x[1]), x[0]))[:top]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def l1_select(df: DataFrame, columns: list[str], label: str, reg: float, top: int, floor: float = 1e-6, kind: str = "regression") -> DataFrame:
    """Features with an L1 coefficient at or over the floor, largest first.

    ``kind`` is ``regression`` or ``class``; of several classes' coefficients the one of the largest size counts.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    made = LinearRegression if kind == "regression" else LogisticRegression
    m = made(labelCol=label, regParam=reg, elasticNetParam=1.0, standardization=True).fit(_vector(df, columns))
    coef = m.coefficients.toArray() if kind == "regression" else [max(c, key=abs) for c in m.coefficientMatrix.toArray().T]
    return _ranked(df, columns, coef, top, floor)


def fit_pca(train: DataFrame, columns: list[str], k: int | float):
    """(fitted pipeline, number of components, share of the variance they explain).

    ``k``: so many components, or, under 1, as few as explain that share.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler

    most = len(columns) if isinstance(k, float) and k < 1 else int(k)
    p = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="_s", withMean=True), PCA(k=most, inputCol="_s", outputCol="_p")]).fit(_vector(train, columns))
    share = np.cumsum(p.stages[1].explainedVariance.toArray())
    n = int(np.searchsorted(share, k - 1e-12) + 1) if most != k else most
    return p, min(n, most), float(share[min(n, most) - 1])


def pca(train: DataFrame, test: DataFrame, columns: list[str], k: int | float) -> DataFrame:
    """Standardise and project; fitted on train, applied to test; ``k`` as in ``fit_pca``."""
    from pyspark.ml.functions import vector_to_array

    p, n, _ = fit_pca(train, columns, k)
    return p.transform(_vector(test, columns)).withColumn("components", F.slice(vector_to_array("_p"), 1, n)).drop("features", "_s", "_p")


def search(df: DataFrame, columns: list[str], label: str, model: str, grid: dict[str, list], folds: int = 3, seed: int = 1):
    """Cross-validated search; -> (rows of the best model, mean score of every setting, the best setting)."""
    from pyspark.ml import classification as mc
    from pyspark.ml import regression as mr
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    classes = {"logistic": mc.LogisticRegression, "forest": mc.RandomForestClassifier, "boosted": mc.GBTClassifier, "svc": mc.LinearSVC}
    numbers = {"linear": mr.LinearRegression, "ridge": mr.LinearRegression, "forest_regression": mr.RandomForestRegressor, "boosted_regression": mr.GBTRegressor}
    est = (classes | numbers)[model](labelCol=label, featuresCol="features")
    if model == "ridge":
        est = est.setElasticNetParam(0.0)
    score = RegressionEvaluator(labelCol=label) if model in numbers else BinaryClassificationEvaluator(labelCol=label)
    g = ParamGridBuilder()
    for name, values in grid.items():
        g = g.addGrid(est.getParam(name), values)
    data = _vector(df, columns)
    settings = g.build()
    m = CrossValidator(estimator=est, estimatorParamMaps=settings, evaluator=score, numFolds=folds, seed=seed).fit(data)
    best = (max if score.isLargerBetter() else min)(range(len(settings)), key=lambda i: m.avgMetrics[i])
    return m.transform(data), m.avgMetrics, {k.name: v for k, v in settings[best].items()}


def robust_scale(df: DataFrame, group: str, v: str) -> DataFrame:
    """(v - median) / (1.4826 MAD); the standard deviation, then 1, where that is 0."""
    med = df.groupBy(group).agg(F.percentile(v, F.lit(0.5)).alias("_m"), F.stddev_pop(v).alias("_s"))
    x = df.join(med, group)
    mad = x.groupBy(group).agg((F.percentile(F.abs(F.col(v) - F.col("_m")), F.lit(0.5)) * 1.4826).alias("_d"))
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    return x.join(mad, group).withColumn("scaled", (F.col(v) - F.col("_m")) / F.coalesce(pos("_d"), pos("_s"), F.lit(1.0))).drop("_m", "_s", "_d")


def robust_bounds(df: DataFrame, group: str, v: str, margin: float, least: int, fallback: tuple[float, float]) -> DataFrame:
    """1 % and 99 % with a margin of their distance; the fallback for small groups."""
    q = df.groupBy(group).agg(F.count(v).alias("n"), F.percentile(v, F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    w = (F.col("q")[1] - F.col("q")[0]) * margin
    few = F.col("n") < least
    return q.select(group, "n", F.when(few, fallback[0]).otherwise(F.col("q")[0] - w).alias("lo"), F.when(few, fallback[1]).otherwise(F.col("q")[1] + w).alias("hi"))


def robust_positive_bounds(df: DataFrame, group: str, v: str, least: int, fallback: tuple[float, float], margin: float = 0.1, floor: float = 0.05) -> DataFrame:
    """Bounds of positive values in log space: 1 % and 99 % of the logarithms with a margin of their
    distance (``floor`` at least), back on the scale; the fallback for groups with few positive values."""
    x = F.when(F.col(v) > 0, F.log(F.col(v).cast("double")))
    q = df.groupBy(group).agg(F.count(x).alias("n"), F.percentile(x, F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    w = F.greatest((F.col("q")[1] - F.col("q")[0]) * margin, F.lit(floor))
    few = F.col("n") < least
    return q.select(group, "n", F.when(few, fallback[0]).otherwise(F.exp(F.col("q")[0] - w)).alias("lo"), F.when(few, fallback[1]).otherwise(F.exp(F.col("q")[1] + w)).alias("hi"))


def cox_sums(df: DataFrame, group: list[str], eta: Column, time: str = "duration", event: str = "event", weight: Column | None = None) -> DataFrame:
    """(group, loss, events): Breslow partial likelihood with weights and ties, negative, over the weighted events."""
    w = F.lit(1.0) if weight is None else weight
    e = F.when(F.col(event) == 1, w).otherwise(0.0)
    p = prefix(df.withColumn("_eta", eta), group, time, {"s": w * F.exp("_eta"), "d": e, "l": e * F.col("_eta")}, descending=True)
    return p.groupBy(*group).agg(ratio(F.sum(F.when(F.col("d") > 0, F.col("d") * F.log("s_upto") - F.col("l")).otherwise(0.0)), F.sum("d")).alias("loss"), F.sum("d").alias("events"))


#: Numbers in a chunk of ``cox_table``: 32 MB.
CHUNK = 1 << 22


def cox_table(df: DataFrame, columns: list[str], time: str = "duration", event: str = "event", chunk: int = CHUNK) -> DataFrame:
    """The data of a Cox fit, written once in order of falling time: chunks (part, seq, t, e, x) of packed numbers.

    The source is read once, into a table whose times alone are then sampled for ranges; in each
    range the sorted rows are packed into matrices of ``chunk`` numbers, a row each, so that a pass
    needs neither a sort nor a shuffle.  Rows with a null time or value are left out.
    """
    rows = df.select(F.col(time).cast("double").alias("t"), F.coalesce(F.col(event) == 1, F.lit(False)).cast("double").alias("e"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    whole = materialize(rows.where(F.col("t").isNotNull() & ~F.exists("x", lambda v: v.isNull())))
    most = max(1, chunk // max(1, len(columns)))

    def pack(batches):
        from pyspark import TaskContext

        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for at in range(0, len(batch), most):
                held.append(batch.iloc[at : at + most])
                n += len(held[-1])
                if n >= most:
                    yield packed(part, seq, held)
                    seq, held, n = seq + 1, [], 0
        if n:
            yield packed(part, seq, held)

    def packed(part, seq, held):
        own = pd.concat(held)
        x = np.stack(own.x.to_numpy()) if len(columns) else np.zeros((len(own), 0))
        return pd.DataFrame({"part": [part], "seq": [seq], "t": [own.t.to_numpy().tobytes()], "e": [own.e.to_numpy().tobytes()], "x": [x.tobytes()]})

    spread = whole.repartitionByRange(F.desc("t")).sortWithinPartitions(F.desc("t"))
    out = materialize(spread.mapInPandas(pack, "part int, seq int, t binary, e binary, x binary"))
    forget(whole)
    return out


def _unpacked(row, beta: np.ndarray):
    """Times, events, values and weights of a chunk, and the row at which each time begins."""
    t, e = np.frombuffer(row.t), np.frombuffer(row.e)
    x = np.frombuffer(row.x).reshape(len(t), len(beta))
    return t, e, x, np.exp(x @ beta), np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))


def _risk(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([[w.sum()], w @ x, w @ x**2])


def cox_step(table: DataFrame, beta: list[float]):
    """Gradient and information of the mean partial likelihood over ``cox_table``, and the number of events.

    The sums over all at risk are vectors that run on from chunk to chunk: one pass adds up each
    chunk, and the rows of its first time by themselves, since that time may have begun in the chunk
    before; another goes through each chunk from what those before it hold.  A chunk sends 2n + 1
    numbers of its millions; nothing is planned a column.
    """
    b = np.array(beta, dtype=float)
    n = len(b)

    def totals(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples():
                t, _, x, w, first = _unpacked(row, b)
                end = first[1] if len(first) > 1 else len(t)
                out.append((row.part, row.seq, t[0], t[-1], _risk(x, w).tolist(), _risk(x[:end], w[:end]).tolist()))
            yield pd.DataFrame(out, columns=["part", "seq", "first", "last", "whole", "head"])

    told = table.mapInPandas(totals, "part int, seq int, first double, last double, whole array<double>, head array<double>").collect()
    told.sort(key=lambda r: (r.part, r.seq))
    before, after = {}, {}
    run = np.zeros(2 * n + 1)
    for r in told:
        before[r.part, r.seq] = run
        run = run + np.array(r.whole)
    # What later chunks hold of a chunk's last time, from the end backwards.
    more, since = np.zeros(2 * n + 1), None
    for r in reversed(told):
        after[r.part, r.seq] = more if since == r.last else np.zeros(2 * n + 1)
        more = np.array(r.head) + (after[r.part, r.seq] if r.first == r.last else 0)
        since = r.first

    def terms(batches):
        out = np.zeros(2 * n + 1)
        for batch in batches:
            for row in batch.itertuples():
                _, e, x, w, first = _unpacked(row, b)
                own = np.add.reduceat(np.column_stack([w, w[:, None] * x, w[:, None] * x**2]), first, axis=0)
                risk = before[row.part, row.seq] + np.cumsum(own, axis=0)
                risk[-1] += after[row.part, row.seq]
                d = np.add.reduceat(e, first)
                live = d > 0
                d, mean = d[live, None], risk[live, 1:] / risk[live, :1]
                g = e @ x - (d * mean[:, :n]).sum(0)
                h = (d * (mean[:, n:] - mean[:, :n] ** 2)).sum(0)
                out += np.concatenate([[d.sum()], g, h])
        yield pd.DataFrame({"s": [out.tolist()]})

    got = table.mapInPandas(terms, "s array<double>").collect()
    all_ = np.sum([r.s for r in got], axis=0) if got else np.zeros(2 * n + 1)
    d = all_[0] or 1.0
    return (all_[1 : n + 1] / d).tolist(), (all_[n + 1 :] / d).tolist(), float(d)


def cox_fit(df: DataFrame, columns: list[str], alpha: float = 0.0, l1_ratio: float = 1.0, time: str = "duration", event: str = "event", rounds: int = 30, tol: float = 1e-6) -> list[float]:
    """Elastic-net Cox coefficients by proximal steps with diagonal curvature, over data written once."""
    table, beta = cox_table(df, columns, time, event), [0.0] * len(columns)
    for _ in range(rounds):
        g, hs, _ = cox_step(table, beta)
        new = []
        for b, gi, hi in zip(beta, g, hs):
            step = 0.9 / (hi * len(columns) ** 0.5 + alpha * (1 - l1_ratio) + 1e-9)
            x = b + step * (gi - alpha * (1 - l1_ratio) * b)
            t = step * alpha * l1_ratio
            new.append((abs(x) - t) * (1 if x > 0 else -1) if abs(x) > t else 0.0)
        moved, beta = max((abs(a - b) for a, b in zip(beta, new)), default=0.0), new
        if moved < tol:
            break
    forget(table)
    return beta


def cox_screen(long: DataFrame, feature: str, value: str, time: str = "duration", event: str = "event", rounds: int = 8) -> DataFrame:
    """Univariate Cox fit of every feature at once: (feature, beta, z, p), by Newton rounds.

    The rows are written once, and so is each round's table of coefficients, one row a feature,
    which meets them in a join: nothing goes through the driver.
    """
    rows = materialize(long.select(F.col(feature).alias("f"), F.col(value).cast("double").alias("v"), F.col(time).alias("t"), (F.col(event) == 1).cast("double").alias("e")))
    beta, h = rows.select("f").distinct().withColumn("beta", F.lit(0.0)), None
    for _ in range(rounds):
        x = rows.join(beta, "f").withColumn("w", F.exp(F.col("beta") * F.col("v")))
        w, v = F.col("w"), F.col("v")
        p = prefix(x, ["f", "beta"], "t", {"d": F.col("e"), "s": w, "s1": w * v, "s2": w * v * v, "x": F.col("e") * v}, descending=True).where("d > 0")
        m = F.col("s1_upto") / F.col("s_upto")
        n = p.groupBy("f", "beta").agg(F.sum(F.col("x") - F.col("d") * m).alias("g"), F.sum(F.col("d") * (F.col("s2_upto") / F.col("s_upto") - m * m)).alias("h"))
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("g") / F.col("h")))
        h = materialize(n.select("f", F.when(F.col("h") > 0, F.col("beta") + step).otherwise(0.0).alias("beta"), F.greatest("h", F.lit(0.0)).alias("h")))
        beta = h.select("f", "beta")
    forget(rows)
    z = F.col("beta") * F.sqrt("h")
    return h.select(F.col("f").alias(feature), "beta", z.alias("z"), chi2_p(z**2).alias("p"))


def stability(coefs: DataFrame, feature: str, coef: str, threshold: float) -> DataFrame:
    """Share of replicates with a coefficient, for features at or over a threshold."""
    return coefs.groupBy(feature).agg(F.avg((F.col(coef) != 0).cast("double")).alias("share")).where(F.col("share") >= threshold)


def fuse(preds: DataFrame, key: str, weights: DataFrame | None = None) -> DataFrame:
    """(key, model, cls, score) -> weighted and renormalised class scores; weights: (model, weight)."""
    w = preds.withColumn("weight", F.lit(1.0)) if weights is None else preds.join(F.broadcast(weights), "model")
    s = w.groupBy(key, "cls").agg(F.sum(F.col("weight") * F.col("score")).alias("s"))
    return s.withColumn("score", ratio("s", F.sum("s").over(Window.partitionBy(key)))).drop("s")


def vote(preds: DataFrame, key: str) -> DataFrame:
    """Each model votes for its best class; the most votes win (ties: the lower class)."""
    best = first_by(preds, [key, "model"], F.desc("score"), F.col("cls"))
    n = best.groupBy(key, "cls").agg(F.count("*").alias("votes"))
    return first_by(n, [key], F.desc("votes"), F.col("cls"))


def metric_weights(scores: DataFrame, cls: str) -> DataFrame:
    """A model's share of the summed score of a class; missing counts 0.5."""
    s = F.coalesce("score", F.lit(0.5))
    return scores.withColumn("weight", s / F.sum(s).over(Window.partitionBy(cls)))


def top_weights(df: DataFrame, outcome: str, feature: str, coef: str, k: int, least: float) -> DataFrame:
    """Fold-mean coefficients: the k largest of each outcome."""
    m = df.groupBy(outcome, feature).agg(F.avg(coef).alias("weight")).where(F.abs("weight") >= least)
    w = Window.partitionBy(outcome).orderBy(F.desc(F.abs("weight")), feature)
    return m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def summed_weights(df: DataFrame, outcome: str, feature: str, weight: str, per_outcome: int, features: int, outcomes: int, least: float) -> DataFrame:
    """Weights between the features and outcomes of largest summed absolute weight.

    Of every outcome the ``per_outcome`` largest weights count; sums over these rank the features
    and the outcomes (ties by name), and of the pairs left those of at least ``least`` stay.
    """
    size = F.abs(F.col(weight))
    top = df.withColumn("_r", F.row_number().over(Window.partitionBy(outcome).orderBy(F.desc(size), feature))).where(F.col("_r") <= per_outcome).drop("_r")
    best = lambda c, n: top.groupBy(c).agg(F.sum(size).alias("total")).orderBy(F.desc(F.round("total", 9)), c).limit(n).select(c)
    return top.where(size >= least).join(best(feature, features), feature, "left_semi").join(best(outcome, outcomes), outcome, "left_semi").select(outcome, feature, weight)


def window_scale(df: DataFrame, group: str, kind: str, v: str, fixed: dict[str, tuple[float, float]], lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """``scaled`` to 0..1: kinds with a fixed window by it, the rest by percentiles of their group's finite non-zero values."""
    ok = F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    out = clip_scale(df.where(~F.col(kind).isin(list(fixed)) | F.col(kind).isNull()).where(ok), group, v, lo, hi)
    for name, (a, b) in fixed.items():
        scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(v) - a) / (b - a)))
        out = out.unionByName(df.where(F.col(kind) == name).where(ok).withColumn("scaled", scaled))
    return out


def group_ecdf(df: DataFrame, group: str, v: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Mid-point distribution function by fixed bins."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(v) - lo) / ((hi - lo) / bins))))
    x = df.withColumn("bin", b)
    n = x.groupBy(group, "bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    c = n.withColumn("ecdf", (F.sum("_n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") / 2) / F.sum("_n").over(w))
    return x.join(c.drop("_n"), [group, "bin"])


def block_mean(cells: DataFrame, group: list[str], x: str, y: str, v: str, size: float) -> DataFrame:
    return cells.groupBy(*group, F.floor(F.col(x) / size).alias("bx"), F.floor(F.col(y) / size).alias("by")).agg(F.avg(v).alias("mean"), F.count("*").alias("n"))


def clip_scale(df: DataFrame, group: str, v: str, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Clipped to percentiles of the non-zero values and scaled to 0..1; a flat group is 0."""
    q = df.where(F.col(v) != 0).groupBy(group).agg(F.percentile(v, F.array(F.lit(lo), F.lit(hi))).alias("_q"))
    a, b = F.col("_q")[0], F.col("_q")[1]
    return df.join(q, group, "left").withColumn("scaled", F.coalesce(F.when(b > a, (F.least(b, F.greatest(a, col(v))) - a) / (b - a)), F.lit(0.0))).drop("_q")
