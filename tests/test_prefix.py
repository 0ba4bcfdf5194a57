"""Prefix sums: against plain Python, with ranges that follow the data."""

import datetime
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import prims


@pytest.fixture()
def cut_fine(spark):
    """Eight ranges that nothing joins again."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute(rows, descending=False):
    out = {}
    some = sorted(rows, key=lambda r: (repr(r[0]), r[1]))
    for g, own in groupby(some, key=lambda r: r[0]):
        at = {}
        for _, v, n in own:
            at[v] = at.get(v, 0) + n
        run = 0
        for v in sorted(at, reverse=descending):
            run += at[v]
            out[g, v] = (at[v], run)
    return out


@pytest.mark.parametrize("kind", ["double", "long", "string", "date"])
def test_against_plain_sums(spark, cut_fine, kind):
    rng = random.Random(kind)
    make = {"double": lambda: rng.choice([rng.uniform(0.998, 1), -1e9 * rng.random(), 0.0]), "long": lambda: rng.randrange(50), "string": lambda: f"v{rng.randrange(90)}", "date": lambda: datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(200))}[kind]
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), make(), rng.randrange(5)) for _ in range(3000)] + [(f"g{i}", make(), 1) for i in range(300)]
    df = spark.createDataFrame(rows, f"g string, v {kind}, n long")
    for descending in (False, True):
        got = {(r.g, r.v): (r.s, r.s_upto) for r in prims.prefix(df, ["g"], "v", {"s": F.col("n")}, descending).collect()}
        assert got == brute(rows, descending)


def test_without_groups_and_empty(spark, cut_fine):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("n"))
    got = {r.v: r.s_upto for r in prims.prefix(df, [], "v", {"s": F.col("n"), "x": F.col("n") * 0.5}).collect()}
    run = 0
    for i in range(1000):
        run += i % 3
        assert got[float(i)] == run
    assert prims.prefix(df.limit(0), [], "v", {"s": F.col("n")}).count() == 0


def test_no_range_holds_over_twice_its_share(spark, cut_fine):
    """Epoch seconds of one day in one group, beside a few far values: cut at their own quantiles."""
    n = 40_000
    df = spark.range(n).select(F.lit("one").alias("g"), F.when(F.col("id") < 20, F.col("id") * 1e15).otherwise(1.7e9 + F.col("id")).alias("v"))
    out = prims.prefix(df, ["g"], "v", {"s": F.lit(1)})
    assert out.where("v > 1.7e9 + 30000 and v < 1.8e9").agg(F.max("s_upto")).collect()[0][0] > 30000
    written = [f for f in out.inputFiles()]
    sizes = [spark.read.parquet(f).count() for f in written]
    assert sum(sizes) == n and len(sizes) == 8 and max(sizes) <= 2 * n / 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
