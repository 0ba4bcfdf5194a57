"""Geometries of several parts: round trips, areas, even-odd tests; the stored layout's pruning."""

import glob
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import annotations as A
from cohortlake.sources import annotation_files as S
from cohortlake.sources import annotation_store as ST

SQUARE = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
HOLE = [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0], [2.0, 2.0]]
FAR = [[20.0, 0.0], [23.0, 0.0], [20.0, 4.0], [20.0, 0.0]]
GEOMETRIES = {
    "point": ("Point", [1.5, 2.5], 0.0),
    "points": ("MultiPoint", [[1.0, 2.0], [3.0, 4.0]], 0.0),
    "line": ("LineString", [[0.0, 0.0], [1.0, 1.0], [5.0, 0.0]], 0.0),
    "lines": ("MultiLineString", [[[0.0, 0.0], [1.0, 1.0]], [[7.0, 8.0], [9.0, 9.0], [9.0, 1.0]]], 0.0),
    "polygon": ("Polygon", [SQUARE, HOLE], 96.0),
    "polygons": ("MultiPolygon", [[SQUARE, HOLE], [FAR]], 102.0),
    "open": ("Polygon", [SQUARE[:-1]], 100.0),
}


def write(path, rows):
    with open(path, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def feature(key, kind, coordinates):
    return {"key": key, "type": "Feature", "geometry": {"type": kind, "coordinates": coordinates}, "properties": {"n": 1}}


def test_every_type_of_geometry_comes_back(spark, tmp_path):
    write(f"{tmp_path}/a.json", [feature(k, kind, c) for k, (kind, c, _) in GEOMETRIES.items()])
    df = S.read_features_ndjson(spark, f"{tmp_path}/a.json", bad="fail")
    rows = {r.key: r for r in df.collect()}
    assert {k: r.area for k, r in rows.items()} == {k: a for k, (_, _, a) in GEOMETRIES.items()}
    assert (rows["polygons"].min_x, rows["polygons"].max_x, rows["lines"].max_y) == (0.0, 23.0, 9.0)
    out = {f["key"]: f["geometry"] for f in (json.loads(r.value) for r in S.feature_json(df).collect())}
    for k, (kind, c, _) in GEOMETRIES.items():
        assert out[k] == {"type": kind, "coordinates": [SQUARE] if k == "open" else c}
    twice = S.rescaled(df, 2.0, (1.0, 0.0)).where("key = 'polygons'").collect()[0]
    assert (twice.area, twice.min_x, twice.max_x) == (408.0, -2.0, 44.0)
    text = json.dumps({"type": "FeatureCollection", "features": [feature(k, kind, c) for k, (kind, c, _) in GEOMETRIES.items()]}, indent=1)
    (tmp_path / "c.json").write_text(text)
    again = {r.key: r for r in S.read_geojson(spark, f"{tmp_path}/c.json", (0.5, 0.5)).collect()}
    assert again["polygons"].area == 25.5 and len(again["polygons"].parts) == 2


def test_bad_geometries(spark, tmp_path):
    rows = [feature("ok", "Point", [0.0, 0.0]), feature("odd", "Circle", [1.0]), feature("torn", "Polygon", "x"), {"key": "none", "type": "Feature", "geometry": None, "properties": None}, feature("empty", "MultiPolygon", [])]
    write(f"{tmp_path}/b.json", rows)
    kept = {r.key: r for r in S.read_features_ndjson(spark, f"{tmp_path}/b.json").collect()}
    assert set(kept) == {"ok", "odd", "torn", "none", "empty"}
    assert all(kept[k].min_x is None and kept[k].area is None for k in ("odd", "torn", "none", "empty")) and kept["odd"].geom_type == "Circle"
    assert {r.key for r in S.read_features_ndjson(spark, f"{tmp_path}/b.json", bad="drop").collect()} == {"ok", "empty"}
    with pytest.raises(Exception, match="geometry can't be read"):
        S.read_features_ndjson(spark, f"{tmp_path}/b.json", bad="fail").collect()
    out = [json.loads(r.value) for r in S.feature_json(S.read_features_ndjson(spark, f"{tmp_path}/b.json")).collect()]
    assert [f["geometry"] for f in out if f["key"] in ("odd", "none")] == [None, None]


def test_missing_keys_stay_the_same(spark, tmp_path):
    rows = [{**feature(None, "Point", [float(i), 0.0])} for i in range(3)]
    write(f"{tmp_path}/k.json", rows)
    df = S.read_features_ndjson(spark, f"{tmp_path}/k.json")
    first = sorted(r.key for r in df.collect())
    assert len(set(first)) == 3 and first == sorted(r.key for r in df.collect())


def test_even_odd_over_all_rings(spark, tmp_path):
    write(f"{tmp_path}/a.json", [feature(k, kind, c) for k, (kind, c, _) in GEOMETRIES.items()])
    shapes = S.read_features_ndjson(spark, f"{tmp_path}/a.json")
    at = [(1.0, 1.0), (3.0, 3.0), (20.5, 0.5), (22.9, 3.9), (50.0, 50.0), (0.0, 0.0), (10.0, 5.0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)], "key long, cx double, cy double")
    got = {(r.key, r.n_key) for r in A.points_in(points, shapes).collect()}
    assert got == {(0, "polygon"), (0, "polygons"), (0, "open"), (1, "open"), (2, "polygons"), (5, "polygon"), (5, "polygons"), (5, "open")}


def test_region_queries_skip_row_groups(spark, tmp_path):
    n = 60_000
    r = spark.range(n).select(F.col("id").alias("key"), (F.rand(1) * 1000).alias("cx"), (F.rand(2) * 1000).alias("cy"), F.lit("{}").alias("properties"))
    df = r.withColumns({"min_x": F.col("cx") - 1, "max_x": F.col("cx") + 1, "min_y": F.col("cy") - 1, "max_y": F.col("cy") + 1})
    path = f"{tmp_path}/store"
    ST.write_store(df, path, row_group=1 << 16, files=4)
    store = ST.read_store(spark, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    hit = A.query(store, (100, 100, 200, 200))
    plan = hit._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    for name in ("LessThanOrEqual(min_x,200.0)", "GreaterThanOrEqual(max_x,100.0)", "LessThanOrEqual(min_y,200.0)", "GreaterThanOrEqual(max_y,100.0)"):
        assert name in pushed, pushed
    rows = hit.collect()
    assert {r.key for r in rows} == {r.key for r in A.query(df, (100, 100, 200, 200)).collect()}
    leaf = hit._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert len(rows) <= leaf.metrics().apply("numOutputRows").value() < n / 3
    groups = kept = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(c).name for c in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            s = {c: meta.row_group(g).column(names.index(c)).statistics for c in A.BOUNDS}
            groups += 1
            kept += s["min_x"].min <= 200 and s["max_x"].max >= 100 and s["min_y"].min <= 200 and s["max_y"].max >= 100
    assert groups >= 20 and kept <= groups / 4


def test_a_store_without_rows_or_centres(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None), (2, 3.0, 4.0)], "key long, cx double, cy double")
    for k, some in enumerate((df, df.limit(0), df.where("key = 1"))):
        ST.write_store(some, f"{tmp_path}/s{k}")
        assert ST.read_store(spark, f"{tmp_path}/s{k}").count() == some.count()
