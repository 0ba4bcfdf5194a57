"""p values against tables, curves over thresholds, spanning forests, Cox fits, selection."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import special
from cohortlake.operators import features as D
from cohortlake.operators import graph as G
from cohortlake.operators import metrics as E
from cohortlake.operators import stats as S

# Two-sided critical points of Student's t from printed tables.
T_TABLE = [(1, 12.7062, 0.05), (1, 63.6567, 0.01), (2, 4.30265, 0.05), (2, 9.92484, 0.01), (5, 2.57058, 0.05), (5, 4.03214, 0.01), (30, 2.04227, 0.05), (30, 2.75000, 0.01), (120, 1.97993, 0.05)]
NORMAL_TABLE = [(0.0, 1.0), (0.5, 0.6170750775), (1.0, 0.3173105079), (1.959963985, 0.05), (3.0, 0.002699796063), (3.6, 0.000318217), (6.0, 1.973175e-09), (-2.575829304, 0.01)]


def test_t_and_normal_p_values(spark):
    df = spark.createDataFrame(T_TABLE, "v int, t double, p double").withColumn("got", special.t_p("t", "v"))
    assert all(r.got == pytest.approx(r.p, abs=2e-6) for r in df.collect())
    df = spark.createDataFrame(NORMAL_TABLE, "z double, p double").withColumn("got", special.normal_p("z"))
    assert all(r.got == pytest.approx(r.p, rel=1e-6) for r in df.collect())
    edge = spark.createDataFrame([(0, 1.0), (4, 0.0), (4, 1e6), (50_000, 1.96), (9_999, 1.96)], "v int, t double").select("v", special.t_p("t", "v").alias("p")).collect()
    assert edge[0].p is None and edge[1].p == pytest.approx(1) and edge[2].p == pytest.approx(0, abs=1e-9)
    assert edge[3].p == pytest.approx(0.05, abs=1e-5) and edge[4].p == pytest.approx(0.05002, abs=2e-5)


def test_incomplete_beta_against_binomial_sums(spark):
    from math import comb

    rows = [(a, b, x) for a in (1, 2, 5, 40) for b in (1, 3, 60) for x in (0.01, 0.3, 0.5, 0.77, 0.99)]
    df = spark.createDataFrame(rows, "a int, b int, x double").withColumn("got", special.incomplete_beta("a", "b", "x"))
    for r in df.collect():
        n = r.a + r.b - 1
        assert r.got == pytest.approx(sum(comb(n, j) * r.x**j * (1 - r.x) ** (n - j) for j in range(r.a, n + 1)), abs=1e-10)


def test_paired_tests_on_degenerate_groups(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("same", 1.0, 2.0), ("same", 2.0, 3.0), ("two", 1.0, 2.0), ("two", 5.0, 2.0), ("two", None, 1.0)], "g string, a double, b double")
    got = {r.g: (r.n, r.p) for r in S.paired_t(df, ["g"], "a", "b").collect()}
    assert got["one"] == (1, None) and got["same"] == (2, None) and got["two"][1] == pytest.approx(0.7048, abs=1e-4)
    flat = spark.createDataFrame([(g, 1.0) for g in "aabbb"], "g string, v double")
    r = S.mann_whitney(flat, "g", "v").collect()[0]
    assert (r.u, r.p) == (3.0, None)
    exact = spark.createDataFrame([("x", float(i), 2.0 * i) for i in range(5)] + [("y", 1.0, 1.0), ("y", 2.0, 0.0)], "g string, a double, b double")
    rows = {r.g: r for r in S.correlation_tests(exact, ["g"], "a", "b").collect()}
    assert set(rows) == {"x"} and rows["x"].pearson_p == pytest.approx(0, abs=1e-9)


def test_benjamini_hochberg_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.choice([rng.random() ** 3, 0.01, 0.2])) for _ in range(800)] + [("a", None)]
    got = {(r.g, r.p): r.q for r in S.bh(spark.createDataFrame(rows, "g string, p double"), "p", ["g"]).collect()}
    for g in "ab":
        own = sorted(p for h, p in rows if h == g and p is not None)
        low = 1.0
        for i in range(len(own) - 1, -1, -1):
            if i == len(own) - 1 or own[i + 1] != own[i]:
                low = min(low, own[i] * len(own) / (i + 1))
            assert got[g, own[i]] == pytest.approx(low)
    assert got["a", None] is None


def test_froc_keeps_thresholds_that_nothing_reaches(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, None), (0.4, 2), (0.3, None), (None, 3)]
    df = spark.createDataFrame(rows, "score double, lesion int")
    got = {r.threshold: (r.fp_per_scan, r.sensitivity) for r in E.froc(df, [0.1, 0.4, 0.75, 0.95, 2.0], 2, 4).collect()}
    assert got == {0.1: (1.0, 0.5), 0.4: (0.5, 0.5), 0.75: (0.0, 0.25), 0.95: (0.0, 0.0), 2.0: (0.0, 0.0)}
    assert [(r.fp_per_scan, r.sensitivity) for r in E.froc(df.limit(0), [0.5], 2, 4).collect()] == [(0.0, 0.0)]
    plan = E.froc(df, [k / 100 for k in range(100)], 2, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # thresholds meet the histogram, above the aggregation


def test_histogram_curves_against_each_row(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(2), rng.choice([rng.random(), 0.5, None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, truth int, score double, k int")
    cuts = [0.0, 0.25, 0.5, 0.9, 1.5]
    for r in E.sens_spec_curve(df, cuts).collect():
        pos, neg = [x for x in rows if x[1] == 1], [x for x in rows if x[1] == 0]
        assert r.sensitivity == pytest.approx(sum(x[2] is not None and x[2] >= r.threshold for x in pos) / len(pos))
        assert r.specificity == pytest.approx(sum(x[2] is not None and x[2] < r.threshold for x in neg) / len(neg))
    low = {(r.g, r.threshold): r.k for r in E.at_or_over(df, ["g"], "score", cuts, {"k": F.col("k")}, least=True).collect()}
    assert low == {(g, t): min((x[3] for x in rows if x[0] == g and x[2] is not None and x[2] >= t), default=None) for g in "ab" for t in cuts}


def kruskal(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = set()
    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in edges if a != b}):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b, w))
    return out


def test_spanning_forest_is_kruskals(spark, sf):
    rng = random.Random(8)
    for n, m in ((1, 3), (30, 60), (200, 500), (60, 900)):
        e = [(rng.randrange(n), rng.randrange(n), float(rng.randrange(1, 9))) for _ in range(m)]
        got = {tuple(r) for r in G.msf(spark.createDataFrame(e, "src long, dst long, weight double")).collect()}
        assert got == kruskal(e)
    path = [(i, i + 1, float((i * 37) % 11)) for i in range(300)]  # long chains contract too
    assert {tuple(r) for r in G.msf(spark.createDataFrame(path, "src long, dst long, weight double")).collect()} == kruskal(path)


def test_spanning_forest_on_the_tables(spark, sf):
    from cohortlake.plans import graph as plans

    e = [tuple(r) for r in plans.edges(spark, sf).collect()]
    assert {tuple(r) for r in plans.g10(spark, sf).collect()} == kruskal(e)


def cox_by_hand(t, e, x, beta):
    w = np.exp(x @ beta)
    g, h = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for i in np.flatnonzero(e):
        at = t >= t[i]
        s0, s1, s2 = w[at].sum(), w[at] @ x[at], w[at] @ x[at] ** 2
        g, h = g + x[i] - s1 / s0, h + s2 / s0 - (s1 / s0) ** 2
    return g / e.sum(), h / e.sum()


@pytest.mark.parametrize("chunk", [3, 40, 1 << 22])
def test_cox_sums_over_chunks(spark, chunk):
    rng = np.random.default_rng(5)
    t, e, x = rng.integers(1, 9, 120).astype(float), rng.integers(0, 2, 120), rng.normal(size=(120, 3))
    df = spark.createDataFrame([(float(a), int(b), *map(float, c)) for a, b, c in zip(t, e, x)] + [(None, 1, 0.0, 0.0, 0.0), (3.0, 1, None, 0.0, 0.0)], "duration double, event int, a double, b double, c double")
    table = D.cox_table(df, ["a", "b", "c"], chunk=chunk)
    beta = [0.3, -0.2, 0.1]
    g, h, d = D.cox_step(table, beta)
    want_g, want_h = cox_by_hand(t, e, x, np.array(beta))
    assert d == e.sum() and g == pytest.approx(want_g.tolist()) and h == pytest.approx(want_h.tolist())
    assert D.cox_fit(df.limit(0), ["a", "b"], rounds=2) == [0.0, 0.0]


def test_cox_fit_of_many_columns_reads_its_source_once(spark):
    n, k = 400, 500
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, k))
    t = np.exp(-x[:, 3]) * rng.exponential(size=n)
    columns = [f"x{i}" for i in range(k)]
    import pandas as pd

    pdf = pd.DataFrame(x, columns=columns).assign(duration=t, event=1)
    df = spark.createDataFrame(pdf)
    df = df.mapInPandas(count, df.schema)
    beta = D.cox_fit(df, columns, alpha=0.1, l1_ratio=1.0, rounds=6)
    assert seen.value == n and max(range(k), key=lambda i: abs(beta[i])) == 3 and beta[3] > 0


def test_cox_screen_keeps_its_feature_type(spark):
    rng = random.Random(3)
    rows = [(f, float(rng.randrange(1, 30)), rng.randrange(2), rng.random()) for f in (1, 2, 3) for _ in range(60)] + [(4, 1.0, 1, 2.0), (4, 2.0, 1, 2.0)]
    got = {r.f: r for r in D.cox_screen(spark.createDataFrame(rows, "f int, duration double, event int, v double"), "f", "v").collect()}
    assert set(got) == {1, 2, 3, 4} and got[4].beta == 0.0 and got[4].p == pytest.approx(1, abs=1e-6)
    for f in (1, 2, 3):
        t, e, v = (np.array([r[i] for r in rows if r[0] == f]) for i in (1, 2, 3))
        g, _ = cox_by_hand(t, e, v[:, None], np.array([got[f].beta]))
        assert abs(g[0]) < 1e-6


def test_selection_of_three_classes_and_share_of_variance(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        y = i % 3
        rows.append((float(y), rng.gauss(2.0 * y, 1), rng.gauss(0, 1), rng.gauss(-1.0 * (y == 2), 1)))
    df = spark.createDataFrame(rows, "y double, a double, noise double, b double")
    got = D.l1_select(df, ["a", "noise", "b"], "y", 0.05, 3, kind="class").collect()
    assert [r.feature for r in got][0] == "a" and "noise" not in {r.feature for r in got}
    two = D.l1_select(df.where("y < 2"), ["a", "noise", "b"], "y", 0.05, 3, kind="class").collect()
    assert [r.feature for r in two] == ["a"]
    wide = df.withColumns({"a2": F.col("a") * 2 + 1, "a3": -F.col("a")})
    cols = ["a", "a2", "a3", "noise"]
    for share, k in ((0.7, 1), (0.99, 2), (0.75, 1)):
        _, n, got_share = D.fit_pca(wide, cols, share)
        assert n == k and got_share >= share
        assert len(D.pca(wide, wide, cols, share).first().components) == k
    assert len(D.pca(wide, wide, cols, 3).first().components) == 3


@pytest.mark.parametrize("model", ["logistic", "forest", "boosted", "svc", "linear", "ridge", "forest_regression", "boosted_regression"])
def test_every_model_of_the_search(spark, model):
    rng = random.Random(2)
    rows = [(a := rng.gauss(0, 1), rng.gauss(0, 1), float(a > 0), 3 * a + rng.gauss(0, 0.1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double, z double")
    number = model in ("linear", "ridge", "forest_regression", "boosted_regression")
    grid = {"regParam": [0.001, 50.0]} if model in ("logistic", "svc", "linear", "ridge") else {"maxDepth": [2, 1]} if "boosted" not in model else {"maxIter": [3]}
    out, scores, best = D.search(df, ["a", "b"], "z" if number else "y", model, grid, folds=2)
    assert len(scores) == len(next(iter(grid.values())))
    if number:
        assert out.agg(F.corr("prediction", "z")).first()[0] > 0.9
    else:
        assert out.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.9
    if "regParam" in grid:
        assert best == {"regParam": 0.001}
