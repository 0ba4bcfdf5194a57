"""Hand-computed values, invariants and awkward inputs."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import prims
from cohortlake.operators import annotations as A
from cohortlake.operators import cohort as B
from cohortlake.operators import features as D
from cohortlake.operators import graph as G
from cohortlake.operators import metrics as E
from cohortlake.operators import stats as S
from cohortlake.sources import annotation_files as files

SURV = "g string, risk double, duration double, event int"


def one(df):
    return df.collect()[0]


def test_c_index_by_hand(spark):
    rows = [("a", 3.0, 1.0, 1), ("a", 2.0, 2.0, 0), ("a", 2.0, 2.0, 1), ("a", 1.0, 3.0, 0), ("a", 2.0, 4.0, 1)]
    # From the event at 1: four pairs, all right.  At 2: with the censored tie at 2 (tied risk), at 3 (right), at 4 (tied).
    r = one(E.c_index(spark.createDataFrame(rows, SURV), ["g"]))
    assert r.pairs == 7 and r.c_index == pytest.approx((4 + 1 + 0.5 + 0.5) / 7)


def test_c_index_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    rows = [("ab"[rng.randrange(2)], float(rng.randrange(9)), float(rng.randrange(1, 12)), rng.randrange(2)) for _ in range(200)]
    got = {r.g: (r.pairs, r.c_index) for r in E.c_index(spark.createDataFrame(rows, SURV), ["g"]).collect()}
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        pairs = [(x, y) for x in own for y in own if x[3] == 1 and (y[2] > x[2] or (y[2] == x[2] and y[3] == 0))]
        won = sum(1.0 if x[1] > y[1] else 0.5 if x[1] == y[1] else 0.0 for x, y in pairs)
        assert got[g] == (len(pairs), pytest.approx(won / len(pairs)))


def test_undefined_metrics_are_null(spark):
    all_censored = spark.createDataFrame([("a", 1.0, 1.0, 0), ("a", 2.0, 2.0, 0)], SURV)
    assert one(E.c_index(all_censored, ["g"])).c_index is None
    single = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.2)], "g string, truth int, score double")
    assert one(E.auroc(single, ["g"])).auroc is None
    assert E.auroc(single.limit(0), ["g"]).count() == 0
    flat = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0)], "g string, x double, y double")
    assert one(S.correlations(flat, ["g"], "x", "y")).spearman is None


def test_all_scores_tied(spark):
    df = spark.createDataFrame([("a", i % 2, 0.5) for i in range(10)], "g string, truth int, score double")
    assert one(E.auroc(df, ["g"])).auroc == 0.5
    assert one(E.auprc(df, ["g"])).auprc == 0.5


def test_kaplan_meier_reaches_zero(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, 1), ("a", 0.0, 2.0, 1)], SURV)
    assert [r.survival for r in E.km(df, ["g"]).orderBy("t").collect()] == [pytest.approx(0.5), 0.0]


def test_weighted_cox_loss_with_ties(spark):
    df = spark.createDataFrame([("a", 0.2, 3.0, 1, 1.0), ("a", -0.1, 2.0, 1, 2.0), ("a", 0.4, 2.0, 1, 1.0), ("a", 0.0, 1.0, 0, 5.0), ("a", 9.0, 1.0, 1, 0.0)], SURV + ", w double")
    r3, r2 = math.exp(0.2), math.exp(0.2) + 2 * math.exp(-0.1) + math.exp(0.4)
    want = (math.log(r3) - 0.2 + 3 * math.log(r2) - (2 * -0.1 + 0.4)) / 4
    got = one(D.cox_sums(df, ["g"], F.col("risk"), weight=F.col("w")))
    assert got.loss == pytest.approx(want)
    moved = one(D.cox_sums(df, ["g"], F.col("risk") + 5, weight=F.col("w")))
    assert moved.loss == pytest.approx(want)


def test_cox_fit_finds_the_sign(spark):
    rows = [(float(i % 2), float(i % 7), 10.0 - 6 * (i % 2) + (i % 5), 1) for i in range(60)]
    beta = D.cox_fit(spark.createDataFrame(rows, "x double, z double, duration double, event int"), ["x", "z"], rounds=40)
    assert beta[0] > 1 and abs(beta[1]) < 0.5


def test_chi2_tail(spark):
    r = one(spark.range(1).select(E.chi2_p(F.lit(3.841459)).alias("p"), E.chi2_p(F.lit(0.0)).alias("one")))
    assert r.p == pytest.approx(0.05, abs=1e-5) and r.one == pytest.approx(1, abs=1e-6)


def test_neighbours_on_cell_borders(spark):
    c = F.array(F.struct(F.col("x"), F.lit(0.0).alias("y")))
    df = A.with_bounds(spark.createDataFrame([(1, 0.0), (2, 2.0), (3, 4.0), (4, 6.5)], "key long, x double").withColumn("coords", c))
    got = {tuple(r) for r in A.neighbours(df, df, 2.0).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, 4)}


def test_files_round_trip(spark, tmp_path):
    df = A.from_table(spark.createDataFrame([(7, 1.5, 2.5, "a")], "id long, x double, y double, c string"), "id", "x", "y", ["c"])
    files.write_features(df, f"{tmp_path}/f")
    back = one(files.read_features_ndjson(spark, f"{tmp_path}/f"))
    assert (back.key, back.cx, back.cy) == ("7", 1.5, 2.5) and '"c":"a"' in back.properties
    (tmp_path / "g.json").write_text('{"features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, 9]}, "properties": {"k": 1}}]}')
    g = one(files.read_geojson(spark, f"{tmp_path}/g.json", (2.0, 2.0), (1.0, 1.0)))
    assert (g.cx, g.cy) == (8.0, 16.0)
    (tmp_path / "p.csv").write_text("x,y,class\n1,2,\n3,4,5\n")
    assert sorted(tuple(r) for r in files.read_locations(spark, f"{tmp_path}/p.csv").collect()) == [(1.0, 2.0, 0), (3.0, 4.0, 5)]


def test_components_and_spanning_forest(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 9.0), (5, 6, 1.0)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "id long")
    assert {tuple(r) for r in G.components(e.select("src", "dst"), nodes).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)}
    assert {(r.src, r.dst) for r in G.msf(e).collect()} == {(1, 2), (2, 3), (5, 6)}


def test_triangles_take_all_common_neighbours(spark):
    k4 = spark.createDataFrame([(a, b) for a in range(4) for b in range(a)], "src long, dst long")
    assert G.triangles(k4).count() == 4


def test_zero_vector(spark):
    assert one(spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(prims.l2("v").alias("u"))).u == [0.0, 0.0]


def test_bh_missing_and_ties(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.04), (4, None)], "k long, p double")
    got = {r.k: r.q for r in S.bh(df, "p").collect()}
    assert got[1] == pytest.approx(0.03) and got[2] == got[3] == pytest.approx(0.04) and got[4] is None


def test_folds_test_each_key_once(spark):
    from cohortlake.operators import outcomes as C

    f = C.kfold(spark.range(500).withColumnRenamed("id", "k"), "k", 5, 0.1)
    assert f.where("role = 'test'").groupBy("k").count().where("count <> 1").count() == 0
    assert f.where("role = 'test'").select("k").distinct().count() == 500


def test_no_cross_joins_in_spatial_plans(spark, sf):
    from cohortlake.plans import annotations, cohort, graph, metrics, registry  # noqa: F401

    for name in ("a22_neighbours", "a22_box_neighbours", "b11_paired_files", "e11_c_index", "g07_triangles"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_majority_tie_and_empty(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a")], "g string, v string")
    assert one(B.majority(df, "g", "v")).v == "a"
    assert B.majority(df.limit(0), "g", "v").count() == 0


def test_t_interval_quantiles(spark):
    """Known two-sided 95 % values of the t distribution."""
    known = {1: (12.7062, 1e-3), 2: (4.3027, 1e-3), 3: (3.1824, 2e-2), 4: (2.7764, 2e-3), 9: (2.2622, 1e-4), 30: (2.0423, 1e-4)}
    df = spark.createDataFrame([(k,) for k in known], "k long")
    for r in df.select("k", S.t_quantile(F.col("k"), 1.959963984540054).alias("t")).collect():
        assert abs(r.t - known[r.k][0]) < known[r.k][1], r


def test_prefix_over_signs_ties_and_spreads(spark):
    """Sums up to a value, against plain sorting, for numbers of any size and sign, both ways round."""
    values = [0.0, -0.0, 1.0, 1.0, 2.0, 1.999999999, 2.000000001, 1e-9, -1e-9, 1e12, -1e12, -3.5, 7.25, 1023.0, 1024.0, 1025.0] + [i / 7 - 30 for i in range(400)]
    df = spark.createDataFrame([("g" if i % 3 else None, v, i) for i, v in enumerate(values)], "g string, v double, i int")
    for down in (False, True):
        got = {(r.g, r.v): r.n_upto for r in prims.prefix(df, ["g"], "v", {"n": F.lit(1)}, descending=down).collect()}
        for g in ("g", None):
            mine = [v for i, v in enumerate(values) if (i % 3 > 0) == (g == "g")]
            assert all(got[g, v] == sum((x >= v) if down else (x <= v) for x in mine) for v in mine)


def test_voxel_components_match_flood_fill(spark):
    import random

    rng = random.Random(1)
    cells = {(rng.randrange(14), rng.randrange(14)) for _ in range(60)}
    left, sizes = set(cells), []
    while left:
        todo, seen = [left.pop()], 1
        while todo:
            x, y = todo.pop()
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            seen += len(near)
            todo += near
        sizes.append(seen)
    v = spark.createDataFrame([(1, x, y) for x, y in cells], "scan int, x long, y long")
    assert sorted(r["size"] for r in G.voxel_components(v, 1, 2).collect()) == sorted(s for s in sizes if s > 1)


def test_polygon_and_odd_features(spark, tmp_path):
    from cohortlake.sources import annotation_files as files

    lines = ['{"key":"a\\"b","type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,3],[0,3],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]},"properties":{"k":1}}', '{"key":"l","geometry":{"type":"LineString","coordinates":[[0,0],[3,4]]}}', '{"key":"x","geometry":{"type":"Blob","coordinates":[1]}}', '{"key":"p","geometry":{"type":"Point","coordinates":[5,6]}}']
    (tmp_path / "f.json").write_text("\n".join(lines))
    rows = files.read_features_ndjson(spark, str(tmp_path / "f.json"))
    got = {r.key: r for r in rows.collect()}
    assert got['a"b'].area == 11.5 and len(got['a"b'].coords) == 4 and got["l"].max_y == 4 and got["x"].coords is None and got["p"].cx == 5
    files.write_features(rows.where("coords is not null"), str(tmp_path / "out"))
    again = {r.key: r for r in files.read_features_ndjson(spark, str(tmp_path / "out")).collect()}
    assert {k: (r.area, r.coords) for k, r in again.items()} == {k: (r.area, r.coords) for k, r in got.items() if k != "x"}


def test_knn_blocks_match_plain_numpy(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(40, 4)), 1)
    v[7] = v[3]
    monkeypatch.setattr(G.numbered, "__defaults__", (9,))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1), 1e-8)[:, None]
    s = np.round(u @ u.T, 9)
    got = {(r.id, r.place): r.neighbour for r in G.knn(df, df, "id", "v", 3).collect()}
    for i in range(40):
        want = sorted((j for j in range(40) if j != i), key=lambda j: (-s[i, j], j))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == want


BOXES = "key long, min_x double, min_y double, max_x double, max_y double"


def test_box_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(11)
    made = []
    for i in range(300):
        x, y, w, h_ = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0, 0.3, 1, 4, 16, 70]) * rng.random(), rng.choice([0, 1, 4, 16]) * rng.choice([1, rng.random()])
        made.append((i, x, y, x + w, y + h_))
    made += [(900, 0.0, 0.0, 4.0, 4.0), (901, 4.0, 4.0, 8.0, 8.0), (902, 4.0, 0.0, 4.0, 0.0), (903, -4.0, -4.0, 0.0, 0.0), (904, None, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(made, BOXES)
    for d in (0.0, 1.0, 9.0):
        got = A.box_pairs(df, df, d).select("key", "n_key").collect()
        want = {(a[0], b[0]) for a in made for b in made if None not in a + b and a[1] <= b[3] + d and a[3] >= b[1] - d and a[2] <= b[4] + d and a[4] >= b[2] - d}
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert A.box_pairs(df.limit(0), df).count() == 0 and A.box_pairs(df, df.limit(0)).count() == 0


def test_a_box_is_filed_in_four_cells_a_level(spark):
    """One box over everything among many small ones: rows follow the boxes, not the area."""
    small = [(i, float(i), float(i % 50), i + 0.5, i % 50 + 0.5) for i in range(2000)]
    df = spark.createDataFrame(small + [(5000, -1e6, -1e6, 1e6, 1e6)], BOXES).withColumn("_home", F.when(F.col("key") == 5000, 11).otherwise(0))
    rows = A.filed(df, [0, 11], True)
    assert rows.count() <= 4 * (2 * 2000 + 1) and rows.where("key = 5000").count() <= 4
    pairs = A.box_pairs(df.where("key = 5000"), df)
    assert pairs.count() == 2001
