"""Ties and halves that must not hang on rounding or on the order of rows."""

import math
from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions.special import t_p
from cohortlake.operators import metrics as E
from cohortlake.operators import stats as S
from cohortlake.plans import annotations, registry  # noqa: F401

from .oracle import compare


#: Numbers whose sum of doubles is another in the other order.
ORDERED = [0.95, 0.52, 0.51, 0.77, 0.97, 0.69]


def test_tile_grid_rounds_halves_to_even(spark, tmp_path):
    # Below zero a half rounded away from it is another width (63 for 64), and so one tile less.
    rows = [(i, 10, x) for i, x in enumerate((-676.5, -628.5, -0.5, 23.5, 24.5, 699.5))]
    spark.createDataFrame(rows, "c_custkey bigint, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = connect_one(tmp_path, "customer")
    assert compare(registry.QUERIES["a24_tile_grid"](spark, str(tmp_path)), con, registry.SQL["a24_tile_grid"]) is None


def connect_one(tmp_path, table):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    return con


def test_classes_of_equal_mean_all_stay(spark):
    # Two classes of few cells with the same scores in another order; sums of doubles differ there.
    scores = ORDERED
    assert reduce(add, scores) != reduce(add, reversed(scores))
    rows = [(1, i, 1, s) for i, s in enumerate(scores)] + [(1, 10 + i, 2, s) for i, s in enumerate(reversed(scores))] + [(1, 100 + i, 3, 0.55) for i in range(200)]
    got = E.resolve_classes(spark.createDataFrame(rows, "image int, cell int, cls int, score double").coalesce(1), "image", ["cell"], 0.12)
    assert {r.cls for r in got.collect()} == {1, 2, 3}


def test_cases_of_equal_mean_are_ties(spark):
    scores = ORDERED
    assert reduce(add, scores) != reduce(add, reversed(scores))
    rows = [("g", 1, 1.0, s) for s in scores] + [("g", 2, 2.0, s) for s in reversed(scores)] + [("g", 3, 3.0, 0.1)]
    got = S.level_correlations(spark.createDataFrame(rows, "g string, case int, t double, s double").coalesce(1), ["g"], "case", "t", "s")
    r = got.where("level = 'case_mean' and subset = 'all'").first()
    # Ranks 1, 2, 3 against 2.5, 2.5, 1.
    assert r.spearman == pytest.approx(-1.5 / math.sqrt(2 * 1.5), abs=1e-12)


def test_t_p_of_many_degrees_of_freedom(spark):
    """Against Simpson's rule over the density, its constant by the asymptotic series of the gamma ratio."""

    def exact(t, v, n=4000):
        k = math.exp(0.5 * math.log(v / 2) - 1 / (4 * v) + 1 / (24 * v**3)) / math.sqrt(v * math.pi)
        f = lambda x: k * math.exp(-(v + 1) / 2 * math.log1p(x * x / v))
        hstep = t / n
        return 1 - 2 * hstep / 3 * (f(0) + f(t) + 4 * sum(f((2 * i + 1) * hstep) for i in range(n // 2)) + 2 * sum(f(2 * i * hstep) for i in range(1, n // 2)))

    cases = [(t, v) for v in (20_001, 77_140, 1_000_000) for t in (0.01, 0.6, 1.5, 2.4)]
    got = spark.createDataFrame(cases, "t double, v bigint").select("t", "v", t_p("t", "v").alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(exact(r.t, r.v), abs=2e-10)


def test_fraction_takes_few_terms_for_few_degrees_of_freedom(spark):
    from cohortlake.functions import special

    seen = []
    plain = special._fraction
    try:
        special._fraction = lambda a, b, x, terms: seen.append(terms) or plain(a, b, x, terms)
        rows = spark.createDataFrame([(1.5, 3)], "t double, v bigint")
        got = [r.p for r in rows.select(special.t_p("t", "v").alias("p")).collect()]
    finally:
        special._fraction = plain
    th = math.atan(1.5 / math.sqrt(3))
    assert got[0] == pytest.approx(1 - 2 / math.pi * (th + math.sin(th) * math.cos(th)), abs=1e-12)
    assert all(not isinstance(t, int) for t in seen)


@pytest.mark.parametrize("group", [["g"], []])
def test_c_index_over_ranges_against_all_pairs(spark, group):
    """Ranges that cut a risk in two, and the rows that the job writes."""
    import random

    rng = random.Random(5)
    rows = [("ab"[rng.randrange(2)], float(rng.choice((1, 40 * rng.random()))), float(rng.randrange(1, 90)), rng.randrange(2), float(rng.randrange(1, 4))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, risk double, duration double, event int, w double")
    written = []
    plain, prefix_materialize = E.materialize, E.prefix.__globals__["materialize"]
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        E.materialize = E.prefix.__globals__["materialize"] = lambda d: written.append(plain(d)) or written[-1]
        got = {(r.g if group else None): (r.pairs, r.c_index) for r in E.c_index(df, group, weight=E.F.col("w")).collect()}
    finally:
        E.materialize, E.prefix.__globals__["materialize"] = plain, prefix_materialize
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for g in "ab" if group else [None]:
        own = [r for r in rows if g in (None, r[0])]
        pairs = [(x, y) for x in own for y in own if x[3] == 1 and (y[2] > x[2] or (y[2] == x[2] and y[3] == 0))]
        won = sum(x[4] * y[4] * (1.0 if x[1] > y[1] else 0.5 if x[1] == y[1] else 0.0) for x, y in pairs)
        total = sum(x[4] * y[4] for x, y in pairs)
        assert got[g] == (pytest.approx(total), pytest.approx(won / total))
    assert sum(d.count() for d in written) < 4 * len(rows)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("size", [10, 2**18])
def test_bootstrap_of_concordance_against_all_pairs(spark, monkeypatch, hot, size):
    """Replicates as in all pairs of their rows, also where one risk and time, over several ranges, has most rows."""
    monkeypatch.setattr(E, "RANGE", size, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(size, 10_000)))
    rng = np.random.default_rng(7)
    n, b = 600, 4
    risk, time, event = rng.integers(0, 12, n) / 4, rng.integers(1, 9, n), rng.integers(0, 2, n)
    if hot:
        risk[:400], time[:400] = 1.25, 5
    g = ["ab"[i] for i in rng.integers(0, 2, n)]
    df = spark.createDataFrame(list(zip(range(n), g, risk.tolist(), time.tolist(), event.tolist())), "id long, g string, risk double, duration long, event int")
    ranges, real = [], E.materialize
    monkeypatch.setattr(E, "materialize", lambda d: ranges.append(real(d)) or ranges[-1])
    drawn = np.zeros((b, n))
    for r in S.replicates(df.select("id"), "id", b, 3).collect():
        drawn[r.b, r.id] = r.w
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.g: (r["mean"], r.lo, r.hi) for r in S.bootstrap_cindex(df, ["g"], "id", b, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert size > 10 or ranges[0].select("_part").distinct().count() >= n / 20
    meets = (event[:, None] == 1) & ((time[None] > time[:, None]) | (time[None] == time[:, None]) & (event[None] == 0))
    score = (risk[:, None] > risk[None]) + 0.5 * (risk[:, None] == risk[None])
    for x in "ab":
        own = meets & np.outer(np.array(g) == x, np.array(g) == x)
        c = [(np.outer(w, w) * own * score).sum() / (np.outer(w, w) * own).sum() for w in drawn]
        assert got[x] == pytest.approx((np.mean(c), np.quantile(c, 0.025), np.quantile(c, 0.975)))


def test_replicates_are_not_shuffled(spark):
    n = 20_000
    df = spark.range(n).select("id", F.lit("a").alias("g"), F.rand(1).alias("risk"), (F.col("id") % 90).alias("duration"), (F.col("id") % 2).alias("event"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert len(S.bootstrap_cindex(df, ["g"], "id", 20, 1).collect()) == 1
    assert 0 < written() - before < 100 * n
