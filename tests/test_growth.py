"""What one task reads, sends or holds follows its share of the rows."""

import glob
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import annotations as A
from cohortlake.operators import graph as G
from cohortlake.sources import annotation_files as S


def bytes_read(spark, run) -> int:
    total = lambda: sum(x.getBytesRead() for x in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = total()
    run()
    return total() - before


def test_a_collection_is_read_once_and_its_texts_are_exact(spark, tmp_path):
    odd = '{"a": 1.00, "b": 0.12345678901234567890, "c": "x\\u001e\\n"}'
    one = '{"key":"%d","type":"Feature",\n "geometry":{"type":"Point","coordinates":[%d.50,1]},"properties":' + odd + "}"
    with open(f"{tmp_path}/c.json", "w") as f:
        f.write('{"type":"FeatureCollection","features":[' + ",\n".join(one % (i, i) for i in range(2000)) + "]}\n")
    rows = []
    read = bytes_read(spark, lambda: rows.extend(S.read_geojson(spark, f"{tmp_path}/c.json").collect()))
    assert read < 3 * os.path.getsize(f"{tmp_path}/c.json")
    assert len(rows) == 2000 and {r.properties for r in rows} == {odd} and sorted(r.cx for r in rows) == [i + 0.5 for i in range(2000)]


def test_collections_follow_the_rows(spark, tmp_path):
    point = F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y")))
    df = spark.range(1000).select(F.lit("same").alias("key"), F.lit("Point").alias("geom_type"), point.alias("coords"), F.lit("{}").alias("properties"))
    S.write_geojson(df, f"{tmp_path}/many", features=50)
    files = glob.glob(f"{tmp_path}/many/*/*.txt")
    sizes = [len(json.load(open(f))["features"]) for f in files]
    assert len(files) == 20 and sum(sizes) == 1000 and max(sizes) <= 100
    assert sorted(r.cx for r in S.read_geojson(spark, f"{tmp_path}/many/*").collect()) == list(map(float, range(1000)))
    S.write_geojson(df.limit(0), f"{tmp_path}/none")
    assert not glob.glob(f"{tmp_path}/none/*/*.txt")


def test_blocks_grow_with_the_table_and_not_in_number(spark):
    """A row is sent once for each block of the other side."""
    few, many = (G.numbered(spark.range(n), "id", "_a")[1] for n in (20_000, 500_000))
    assert few == many and G.numbered(spark.range(3_000_000), "id", "_a")[1] * G.LARGEST < 3_200_000


@pytest.mark.parametrize("tile", [(7, 5), (3, 100)])
@pytest.mark.parametrize("same", [False, True])
def test_tiles_of_a_block_keep_the_best_and_the_first_of_equals(monkeypatch, tile, same):
    monkeypatch.setattr(G, "TILE", tile, raising=False)
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(60, 3)), 1)
    v[20:45] = v[3]  # equal similarities over many tiles
    q, r = rng.permutation(60)[:30], rng.permutation(60)
    s = np.round(v @ v.T, 9)
    got = G.block_best(pd.DataFrame({"q": q, "v": list(v[q])}), pd.DataFrame({"r": r, "v": list(v[r])}), 4, same)
    got = {i: [(x.r, x.similarity) for x in g.sort_values(["similarity", "r"], ascending=[False, True]).itertuples()] for i, g in got.groupby("q")}
    for i in q:
        others = sorted((j for j in range(60) if same or j != i), key=lambda j: (-s[i, j], j))[:4]
        assert [j for j, _ in got[i]] == others and [x for _, x in got[i]] == [s[i, j] for j in others]


def test_kernel_sums_of_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(G.numbered, "__defaults__", (9,))
    monkeypatch.setattr(G, "TILE", (4, 3), raising=False)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(i, i % 3 // 2, v.tolist()) for i, v in enumerate(x)], "id long, side int, v array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    k = (np.exp(-d / 2) + np.exp(-d / 8)) / 2
    one = np.arange(50) % 3 == 2
    want = k[~one][:, ~one].mean() + k[one][:, one].mean() - 2 * k[one][:, ~one].mean()
    assert abs(G.mmd(df, "id", "side", "v", [1.0, 2.0]).collect()[0].mmd2 - want) < 1e-12


def test_the_median_distance_is_that_of_all_pairs(spark):
    """More rows a side than any sample of before, most of them far from the middle."""
    df = spark.range(9001).select("id", (F.col("id") % 2).alias("side"), F.array(F.pow(F.col("id") % 97, F.lit(3)).cast("float"), (F.col("id") % 89).cast("float")).alias("v"))
    v = np.array([r.v for r in df.orderBy("id").collect()])
    want = np.median(np.sqrt(((v[0::2, None] - v[None, 1::2]) ** 2).sum(2)))
    assert G.median_distance(df, "id", "side", "v") == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("bins", [4, 65_536])
def test_the_median_distance_in_rounds(spark, monkeypatch, bins):
    monkeypatch.setattr(G.numbered, "__defaults__", (9,))
    monkeypatch.setattr(G, "TILE", (4, 3))
    monkeypatch.setattr(G, "BINS", bins, raising=False)
    rng = np.random.default_rng(3)
    equal = np.ones((40, 2))
    halves = np.repeat([[0.0, 0.0], [9.0, 0.0]], 10, axis=0)  # half of the distances 0, half 9: the median is between
    for x in (rng.normal(size=(41, 3)), rng.normal(size=(40, 2)), equal, np.concatenate([equal, rng.normal(size=(7, 2))]), halves):
        side = rng.permutation(len(x)) % 2 if x is not halves else np.arange(20) % 2
        df = spark.createDataFrame([(i, int(s), v.tolist()) for i, (s, v) in enumerate(zip(side, x))], "id long, side int, v array<double>")
        d = np.sqrt(((x[side == 0][:, None] - x[side == 1][None]) ** 2).sum(2))
        assert abs(G.median_distance(df, "id", "side", "v") - np.median(d)) < 1e-7
    assert G.median_distance(df.where("side = 0"), "id", "side", "v") == 1.0
    assert G.median_distance(df.withColumn("v", F.array(F.lit(0.0))), "id", "side", "v") == 0.0


def test_near_pairs_each_once(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(-6, 6, size=(300, 2)), 1)
    x[:40] = np.round(x[:40])  # on the edges of cells, and in one place
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(7, 50.0, 50.0), (7, 50.0, 51.0), (None, 0.0, 0.0)], "key long, cx double, cy double")
    got = sorted(tuple(sorted((r.key, r.n_key))) for r in A.near_pairs(df, 1.5).collect())
    assert got == [(i, j) for i in range(300) for j in range(i + 1, 300) if (x[i, 0] - x[j, 0]) ** 2 + (x[i, 1] - x[j, 1]) ** 2 <= 1.5**2]


def test_edges_are_not_sent_back_to_their_points(spark):
    """One join makes an edge with all that its weight needs."""
    df = spark.range(50).select(F.col("id").alias("key"), F.col("id").cast("double").alias("cx"), F.lit(0.0).alias("cy"), F.array(F.col("id") * 1.0).alias("features"))
    plan = G.radius_edges(df, 2.0, 0.3, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
