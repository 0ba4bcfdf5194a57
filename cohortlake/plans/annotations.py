"""Queries over events as points (user_id, value) and lineitem rows as boxes."""

import uuid

from pyspark.sql import functions as F

from cohortlake.functions.prims import shared_dir, table
from cohortlake.operators import annotations as A
from cohortlake.sources import annotation_files as S
from cohortlake.sources import annotation_store as ST

from .registry import query

BOX = (20, 10.0, 90, 60.0)


def points(spark, d):
    e = table(spark, d, "events")
    p = F.array(F.struct(F.col("user_id").cast("double").alias("x"), F.col("value").alias("y")))
    return A.with_bounds(e.select(F.col("event_id").alias("key"), F.lit("Point").alias("geom_type"), p.alias("coords"), F.col("props").alias("properties"), "event_type"))


def boxes(spark, d):
    """Cells of lineitem: corner (l_partkey, l_suppkey), width l_quantity, height l_linenumber."""
    i = table(spark, d, "lineitem")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    b = A.with_box(i, "l_partkey", "l_suppkey", F.col("l_partkey") + F.col("l_quantity"), F.col("l_suppkey") + F.col("l_linenumber"))
    return b.select(key.alias("key"), "l_orderkey", "l_returnflag", F.col("l_discount").alias("score"), "coords", "min_x", "max_x", "min_y", "max_y", "cx", "cy", "area")


PTS = "(SELECT event_id AS key, user_id::DOUBLE AS x, value AS y, props, event_type, json_extract_string(props, '$.k')::INT AS k FROM events)"
BXS = """(SELECT l_orderkey * 8 + l_linenumber AS key, l_orderkey, l_returnflag, l_discount AS score, l_partkey::DOUBLE AS min_x, l_suppkey::DOUBLE AS min_y,
 l_partkey + l_quantity AS max_x, (l_suppkey + l_linenumber)::DOUBLE AS max_y FROM lineitem)"""


@query("flagship_region_by_type", f"SELECT event_type, count(*) AS n, round(avg(y), 4) AS mean_y FROM {PTS} WHERE x BETWEEN 2 AND 90 AND y BETWEEN 10 AND 60 AND k % 3 = 0 AND k + 1 > 10 GROUP BY 1")
def flagship(spark, d):
    hit = A.query(points(spark, d), (2, 10.0, 90, 60.0), where=(F.pmod(A.prop("k", "int"), F.lit(3)) == 0) & (A.prop("k", "int") + 1 > 10))
    return hit.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("cy"), 4).alias("mean_y"))


@query("a01_ndjson_round_trip", f"SELECT key::VARCHAR AS key, round(x, 4) AS cx, round(y, 4) AS cy, k FROM {PTS}")
def a01(spark, d):
    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    S.write_features(points(spark, d).withColumn("key", F.col("key").cast("string")), path)
    back = S.read_features_ndjson(spark, path)
    return back.select("key", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), A.prop("k", "int").alias("k"))


@query("a01_polygon_round_trip", f"SELECT key::VARCHAR AS key, 'Polygon' AS geom_type, 4::BIGINT AS corners, round(min_x, 4) AS min_x, round(max_y, 4) AS max_y, round((max_x - min_x) * (max_y - min_y), 3) AS area, l_returnflag || '\"' AS flag FROM {BXS}")
def a01p(spark, d):
    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    b = boxes(spark, d).withColumn("key", F.col("key").cast("string")).withColumn("geom_type", F.lit("Polygon"))
    S.write_features(b.withColumn("properties", F.to_json(F.struct(F.concat("l_returnflag", F.lit('"')).alias("flag")))), path)
    back = S.read_features_ndjson(spark, path)
    return back.select("key", "geom_type", F.size("coords").cast("long").alias("corners"), F.round("min_x", 4).alias("min_x"), F.round("max_y", 4).alias("max_y"), F.round("area", 3).alias("area"), A.prop("flag").alias("flag"))


@query("a02_geojson_collection", f"SELECT key::VARCHAR AS key, round((x - 3) * 0.5, 6) AS cx, round((y - 2) * 0.25, 6) AS cy FROM {PTS} WHERE event_type = 'error'")
def a02g(spark, d):
    path = f"{shared_dir(spark)}/collections-{uuid.uuid4().hex}"
    S.write_geojson(points(spark, d).where("event_type = 'error'").withColumn("key", F.col("key").cast("string")), path)
    back = S.read_geojson(spark, f"{path}/*", (0.5, 0.25), (3.0, 2.0))
    return back.select("key", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def holed(spark, d):
    """Two parts a customer: a square with a hole, and a strip; the nation gives the place."""
    c = table(spark, d, "customer")
    x, y, n = F.col("c_custkey").cast("double"), (F.col("c_nationkey") * 4).cast("double"), F.col("c_custkey") % 5 + 1.0
    ring = lambda a, b, w, h_: A.box_coords(x + a, y + b, x + a + w, y + b + h_)
    zero = F.lit(0.0)
    square, hole, strip = ring(zero, zero, F.lit(8.0), F.lit(8.0)), ring(F.lit(2.0), F.lit(2.0), F.lit(2.0), F.lit(3.0)), ring(F.lit(20.0), zero, n, F.lit(2.0))
    rows = c.select(F.col("c_custkey").cast("string").alias("key"), F.lit("MultiPolygon").alias("geom_type"), F.array(F.array(square, hole), F.array(strip)).alias("parts"), F.to_json(F.struct("c_mktsegment")).alias("properties"))
    return A.with_geometry(rows)


HLD = "(SELECT c_custkey, c_custkey::DOUBLE AS x, c_nationkey * 4.0::DOUBLE AS y, c_custkey % 5 + 1.0 AS n, c_mktsegment FROM customer)"


@query("a01_multi_part_round_trip", f"SELECT c_custkey::VARCHAR AS key, 'MultiPolygon' AS geom_type, 2::BIGINT AS parts, 3::BIGINT AS rings, x AS min_x, (x + 20 + n)::DOUBLE AS max_x, (y + 8)::DOUBLE AS max_y, (64 - 6 + 2 * n)::DOUBLE AS area, c_mktsegment AS segment FROM {HLD}")
def a01m(spark, d):
    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    S.write_features(holed(spark, d), path)
    back = S.read_features_ndjson(spark, path, bad="fail")
    return back.select("key", "geom_type", F.size("parts").cast("long").alias("parts"), F.size(F.flatten("parts")).cast("long").alias("rings"), "min_x", "max_x", "max_y", "area", A.prop("c_mktsegment").alias("segment"))


@query("a02_rescaled_polygons_with_holes", f"SELECT c_custkey::VARCHAR AS key, round((x - 3) * 0.5, 6) AS min_x, round((y + 8 - 2) * 0.5, 6) AS max_y, round((64 - 6 + 2 * n) * 0.25, 6)::DOUBLE AS area FROM {HLD}")
def a02h(spark, d):
    return S.rescaled(holed(spark, d), 0.5, (3.0, 2.0)).select("key", F.round("min_x", 6).alias("min_x"), F.round("max_y", 6).alias("max_y"), F.round("area", 6).alias("area"))


@query("a21_points_in_polygons_with_holes", f"""SELECT h.c_custkey::VARCHAR AS key, count(*) AS points FROM {HLD} h JOIN {{pts}} p ON
 p.x >= h.x AND p.x < h.x + 8 AND p.y >= h.y AND p.y < h.y + 8 AND NOT (p.x >= h.x + 2 AND p.x < h.x + 4 AND p.y >= h.y + 2 AND p.y < h.y + 5)
 OR p.x >= h.x + 20 AND p.x < h.x + 20 + n AND p.y >= h.y AND p.y < h.y + 2 GROUP BY 1""".format(pts=PTS))
def a21h(spark, d):
    return A.points_in(points(spark, d), holed(spark, d)).groupBy(F.col("n_key").alias("key")).agg(F.count("*").alias("points"))


@query("a02_rescaled_points", f"SELECT key, round((x - 3) * 0.5, 6) AS cx, round((y - 2) * 0.5, 6) AS cy FROM {PTS}")
def a02(spark, d):
    return S.rescaled(points(spark, d), 0.5, (3.0, 2.0)).select("key", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("a03_feature_rows", f"""SELECT key, 'Point' AS kind, round(x, 4) AS x, k::BIGINT AS k FROM {PTS}""")
def a03(spark, d):
    text = S.feature_json(points(spark, d).withColumn("key", F.col("key").cast("string")))
    back = F.from_json("value", "key string, geometry struct<type:string,coordinates:array<double>>, properties struct<k:long>")
    return text.select(back.alias("f")).select(F.col("f.key").cast("long").alias("key"), F.col("f.geometry.type").alias("kind"), F.round(F.col("f.geometry.coordinates")[0], 4).alias("x"), F.col("f.properties.k").alias("k"))


@query("a04_table_round_trip", "SELECT c_custkey::VARCHAR AS key, c_nationkey::DOUBLE AS cx, round(c_acctbal, 2) AS cy, c_mktsegment, c_nationkey::BIGINT AS c_nationkey FROM customer")
def a04(spark, d):
    a = A.from_table(table(spark, d, "customer"), "c_custkey", "c_nationkey", "c_acctbal", ["c_mktsegment", "c_nationkey"])
    return A.to_table(a, {"c_mktsegment": "string", "c_nationkey": "long"}).select("key", "cx", F.round("cy", 2).alias("cy"), "c_mktsegment", "c_nationkey")


@query("a05_locations_with_default_class", f"SELECT key, coalesce(CASE WHEN k % 2 = 0 THEN k END, 0)::INT AS class FROM {PTS}")
def a05(spark, d):
    k = A.prop("k", "int")
    return points(spark, d).select("key", F.coalesce(F.when(k % 2 == 0, k), F.lit(0)).alias("class"))


@query("a06_named_types", f"SELECT key, CASE k % 4 WHEN 0 THEN 'tumour' WHEN 1 THEN 'stroma' WHEN 2 THEN 'immune' ELSE 'other' END AS type, round(x * 2, 4) AS cx FROM {PTS}")
def a06(spark, d):
    typed = A.label_types(points(spark, d).withColumn("type", A.prop("k", "int") % 4), {0: "tumour", 1: "stroma", 2: "immune"}, default="other")
    return A.transform_coords(typed, 2, 0, 0, 2, 0, 0).select("key", "type", F.round("cx", 4).alias("cx"))


@query("a07_property_access", f"SELECT key, k FROM {PTS}")
def a07(spark, d):
    return points(spark, d).select("key", A.prop("k", "int").alias("k"))


@query("a08_property_filter", f"SELECT key FROM {PTS} WHERE abs(50 - k) < 20 AND k ** 2 > 1000 AND floor(k / 7) = 5 OR -k < -97 OR (k * 2 - 1) % 10 = 3")
def a08(spark, d):
    k = A.prop("k", "int")
    return points(spark, d).where(((F.abs(50 - k) < 20) & (k**2 > 1000) & (A.floor_div(k, F.lit(7)) == 5)) | (-k < -97) | (F.pmod(k * 2 - 1, F.lit(10)) == 3)).select("key")


@query("a09_key_and_null_tests", f"SELECT count(*) FILTER (k IS NOT NULL) AS has_k, count(*) FILTER (json_extract_string(props, '$.z') IS NULL) AS no_z, sum(coalesce(json_extract_string(props, '$.z')::INT, 7))::BIGINT AS z FROM {PTS}")
def a09(spark, d):
    one = F.when(A.has_key("k"), 1)
    return points(spark, d).agg(F.count(one).alias("has_k"), F.count(F.when(~A.has_key("z"), 1)).alias("no_z"), F.sum(A.get("z", 7, "int")).alias("z"))


@query("a10_list_sum_and_contains", f"SELECT key, (2 * k + 6)::DOUBLE AS total, k IN (1, 2, 3, 5) OR k + 5 = 5 AS has_five FROM {PTS}")
def a10(spark, d):
    k = A.prop("k", "int")
    made = points(spark, d).withColumn("properties", F.to_json(F.struct(F.array(k, k, F.lit(6)).alias("v"), F.array(k, F.when(k.isin(1, 2, 3), 5).otherwise(-1), k + 5).alias("w"))))
    return made.select("key", A.list_sum("v").alias("total"), A.list_contains("w", 5).alias("has_five"))


@query("a11_property_regexp", f"SELECT key FROM {PTS} WHERE regexp_matches(json_extract_string(props, '$.k'), '^[1-3]7?$')")
def a11(spark, d):
    return points(spark, d).where(A.regexp("^[1-3]7?$", "k")).select("key")


@query("a12_unique_property_values", f"SELECT DISTINCT 'k' AS path, k::VARCHAR AS value FROM {PTS} WHERE x < 40")
def a12(spark, d):
    return A.pquery(points(spark, d), ["k"], F.col("cx") < 40)


@query("a13_by_area", f"SELECT key, round((max_x - min_x) * (max_y - min_y), 4) AS area FROM {BXS} WHERE (max_x - min_x) * (max_y - min_y) > 150 ORDER BY 2 DESC, 1")
def a13(spark, d):
    return boxes(spark, d).where("area > 150").orderBy(F.desc("area"), "key").select("key", F.round("area", 4).alias("area"))


@query("a14_append_reports_double_keys", "SELECT c_custkey AS key, 2::BIGINT AS n FROM customer WHERE c_custkey % 10 = 0")
def a14(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return A.append(c, c.where("key % 10 = 0"))[1]


@query("a15_patch", """SELECT coalesce(s.k, c.k) AS key, round(coalesce(c.x, s.x), 2) AS x, coalesce(c.seg, s.seg) AS seg, s.nation, c.flag FROM
 (SELECT c_custkey AS k, c_acctbal AS x, c_mktsegment AS seg, c_nationkey::VARCHAR AS nation FROM customer) s FULL JOIN
 (SELECT c_custkey + 500 AS k, -c_acctbal AS x, CASE WHEN c_custkey % 2 = 0 THEN 'PATCHED' END AS seg, 'new' AS flag FROM customer WHERE c_custkey % 3 = 0) c USING (k)""")
def a15(spark, d):
    c = table(spark, d, "customer")
    store = c.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"), F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("props"))
    new = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("seg"), F.lit("PATCHED"), F.lit("flag"), F.lit("new"))).otherwise(F.create_map(F.lit("flag"), F.lit("new")))
    changes = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 500).alias("key"), (-F.col("c_acctbal")).alias("x"), F.lit(0.0).alias("y"), new.alias("props"))
    return A.patch(store, changes).select("key", F.round("x", 2).alias("x"), F.try_element_at("props", F.lit("seg")).alias("seg"), F.try_element_at("props", F.lit("nation")).alias("nation"), F.try_element_at("props", F.lit("flag")).alias("flag"))


@query("a16_remove", "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def a16(spark, d):
    gone = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"))
    return A.remove(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), gone)


@query("a17_set_default", "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'default' FROM customer WHERE c_custkey % 2 <> 0")
def a17(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return A.set_default(c.where("key % 2 = 0"), c.withColumn("name", F.lit("default")))


@query("a18_affine", f"SELECT key, round(-max_y + 1, 4) AS min_x, round(min_x * 2, 4) AS min_y, round(2 * (max_x - min_x) * (max_y - min_y), 3) AS area FROM {BXS}")
def a18(spark, d):
    return A.transform_coords(boxes(spark, d), 0, -1, 2, 0, 1, 0).select("key", F.round("min_x", 4).alias("min_x"), F.round("min_y", 4).alias("min_y"), F.round("area", 3).alias("area"))


@query("a19_bounds_query", f"SELECT key, min_x, min_y, max_x, max_y FROM {BXS} WHERE min_x <= 300 AND max_x >= 100 AND min_y <= 60 AND max_y >= 20 AND score > 0.05")
def a19(spark, d):
    return A.bquery(boxes(spark, d), (100, 20, 300, 60), F.col("score") > 0.05)


@query("a20_keys_in_region", f"SELECT key FROM {PTS} WHERE x BETWEEN 20 AND 90 AND y BETWEEN 10 AND 60")
def a20(spark, d):
    return A.query(points(spark, d), BOX).select("key")


@query("a21_centres_within", f"SELECT key FROM {PTS} WHERE (x - 55) ** 2 + (y - 35) ** 2 <= 400")
def a21(spark, d):
    return A.query(points(spark, d), BOX, "centers_within_k", 20).select("key")


@query("a21_points_in_polygon", f"""WITH e(x1, y1, x2, y2) AS (VALUES (10.5, 5.5, 90.5, 20.5), (90.5, 20.5, 60.5, 80.5), (60.5, 80.5, 40.5, 30.5), (40.5, 30.5, 10.5, 5.5))
 SELECT key FROM {PTS} p JOIN e ON (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)) GROUP BY key HAVING count(*) % 2 = 1""")
def a21p(spark, d):
    return A.query(points(spark, d), [(10.5, 5.5), (90.5, 20.5), (60.5, 80.5), (40.5, 30.5)], "within").select("key")


def stored(spark, df):
    """The layout written for this query, read again."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    ST.write_store(df, path)
    return ST.read_store(spark, path)


@query("a19_stored_bounds", f"SELECT key, min_x, min_y, max_x, max_y FROM {BXS} WHERE min_x <= 300 AND max_x >= 100 AND min_y <= 60 AND max_y >= 20 AND score > 0.05")
def a19s(spark, d):
    return A.bquery(stored(spark, boxes(spark, d)), (100, 20, 300, 60), F.col("score") > 0.05)


@query("a20_stored_keys", f"SELECT key FROM {PTS} WHERE x BETWEEN 20 AND 90 AND y BETWEEN 10 AND 60")
def a20s(spark, d):
    return A.query(stored(spark, points(spark, d)), BOX).select("key")


@query("a21_stored_polygon", f"""WITH e(x1, y1, x2, y2) AS (VALUES (10.5, 5.5, 90.5, 20.5), (90.5, 20.5, 60.5, 80.5), (60.5, 80.5, 40.5, 30.5), (40.5, 30.5, 10.5, 5.5))
 SELECT key FROM {PTS} p JOIN e ON (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)) GROUP BY key HAVING count(*) % 2 = 1""")
def a21s(spark, d):
    return A.query(stored(spark, points(spark, d)), [(10.5, 5.5), (90.5, 20.5), (60.5, 80.5), (40.5, 30.5)], "within").select("key")


@query("a22_neighbours", f"SELECT a.key, count(*) AS neighbours FROM {PTS} a JOIN {PTS} b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4 WHERE a.event_type = 'error' AND b.event_type = 'purchase' GROUP BY 1")
def a22(spark, d):
    return A.nquery(points(spark, d), F.col("event_type") == "error", F.col("event_type") == "purchase", 2.0)


@query("a22_box_neighbours", f"""SELECT a.key, count(DISTINCT b.key) AS neighbours FROM {BXS} a JOIN {BXS} b ON a.min_x <= b.max_x + 2 AND a.max_x >= b.min_x - 2 AND a.min_y <= b.max_y + 2 AND a.max_y >= b.min_y - 2
 WHERE a.l_orderkey % 100 = 0 GROUP BY 1""")
def a22b(spark, d):
    return A.nquery(boxes(spark, d), F.col("l_orderkey") % 100 == 0, F.lit(True), 2.0, "box")


@query("a22_boxes_of_all_sizes", f"""WITH b AS (SELECT o_orderkey AS key, o_custkey::DOUBLE AS min_x, (o_orderkey % 997)::DOUBLE AS min_y, o_custkey + 4.0 ** (o_orderkey % 7) / 8 AS max_x, o_orderkey % 997 + 4.0 ** (o_orderkey % 6) / 8 AS max_y FROM orders)
 SELECT a.key, count(*) AS neighbours FROM b AS a JOIN b ON a.min_x <= b.max_x AND a.max_x >= b.min_x AND a.min_y <= b.max_y AND a.max_y >= b.min_y WHERE a.key % 100 = 0 GROUP BY 1""")
def a22s(spark, d):
    o, k, four = table(spark, d, "orders"), F.col("o_orderkey"), F.lit(4.0)
    x, y = F.col("o_custkey").cast("double"), (k % 997).cast("double")
    b = o.select(k.alias("key"), x.alias("min_x"), y.alias("min_y"), (x + F.pow(four, k % 7) / 8).alias("max_x"), (y + F.pow(four, k % 6) / 8).alias("max_y"))
    return A.box_pairs(b.where("key % 100 = 0"), b).groupBy("key").agg(F.count("*").alias("neighbours"))


@query("a23_tile_counts", f"SELECT floor(min_x / 64)::BIGINT AS tx, floor(min_y / 64)::BIGINT AS ty, l_returnflag, count(*) AS n FROM {BXS} WHERE floor(max_x / 64) = floor(min_x / 64) AND floor(max_y / 64) = floor(min_y / 64) GROUP BY 1, 2, 3")
def a23(spark, d):
    return A.tile_counts(boxes(spark, d), 64, "l_returnflag")


IMAGES = "(SELECT c_custkey AS image, (c_acctbal::BIGINT % 700 + 700) % 700 + 40 AS width, 50 + c_nationkey * 20 AS height FROM customer)"


@query("a24_tile_grid", f"SELECT image, x::BIGINT AS x, y::BIGINT AS y FROM {IMAGES}, generate_series(0, width - 1, 48) t(x), generate_series(0, height - 1, 48) u(y) WHERE x + 64 <= width AND y + 64 <= height")
def a24(spark, d):
    c = table(spark, d, "customer")
    images = c.select(F.col("c_custkey").alias("image"), (F.pmod(F.bround("c_acctbal").cast("long"), F.lit(700)) + 40).alias("width"), (F.col("c_nationkey") * 20 + 50).alias("height"))
    return A.tile_grid(images, 64, 48).select("image", F.col("x").cast("long"), F.col("y").cast("long"))


@query("a25_covered_tiles", """WITH m AS (SELECT DISTINCT l_partkey AS x, l_suppkey AS y FROM lineitem WHERE l_returnflag = 'R'),
 t AS (SELECT x // 4 AS tx, y // 4 AS ty, count(*) AS cells FROM m GROUP BY 1, 2) SELECT tx, ty, cells FROM t WHERE cells / 16.0 > 0.3""")
def a25(spark, d):
    i = table(spark, d, "lineitem")
    tiles = i.select((F.floor(F.col("l_partkey") / 4)).alias("tx"), F.floor(F.col("l_suppkey") / 4).alias("ty")).distinct()
    return A.filter_tiles(tiles, i.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")), 4, 0.3)


@query("a25_box_coverage", """WITH m AS (SELECT DISTINCT l_partkey AS x, l_suppkey AS y FROM lineitem WHERE l_returnflag = 'R'),
 p AS (SELECT c_custkey AS key, c_custkey * 2.5 - 1 AS x0, (c_nationkey * 4)::DOUBLE AS y0, c_custkey * 2.5 + 9 AS x1, c_nationkey * 4 + 6.5 AS y1 FROM customer)
 SELECT key, round(sum(CASE WHEN x IS NULL THEN 0 ELSE (least(x1, x + 1) - greatest(x0, x)) * (least(y1, y + 1) - greatest(y0, y)) END) / 65, 6)::DOUBLE AS covered FROM p LEFT JOIN m ON x <= x1 AND x + 1 >= x0 AND y <= y1 AND y + 1 >= y0 GROUP BY 1""")
def a25b(spark, d):
    m = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")).distinct()
    mask = m.select(F.struct("x", "y").alias("key"), F.col("x").cast("double").alias("min_x"), F.col("y").cast("double").alias("min_y"), (F.col("x") + 1.0).alias("max_x"), (F.col("y") + 1.0).alias("max_y"))
    c = table(spark, d, "customer")
    x, y = F.col("c_custkey") * 2.5 - 1, (F.col("c_nationkey") * 4).cast("double")
    tiles = c.select(F.col("c_custkey").alias("key"), x.alias("min_x"), y.alias("min_y"), (x + 10).alias("max_x"), (y + 6.5).alias("max_y"))
    return A.box_coverage(tiles, mask).select("key", F.round("covered", 6).alias("covered"))


@query("a26_merged_tiles", """WITH m AS (SELECT l_orderkey, l_suppkey % 3 AS cls, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY 1, 2)
 SELECT l_orderkey, first(cls ORDER BY score DESC, cls)::BIGINT AS cls, max(score) AS score FROM m GROUP BY 1""")
def a26(spark, d):
    pred = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("cls"), F.col("l_discount").alias("score"))
    mean = pred.groupBy("l_orderkey", "cls").agg(F.round(F.avg("score"), 6).alias("score"))
    return A.merge_tiles(mean, ["l_orderkey"])


@query("a27_seams", f"""SELECT key FROM {BXS} WHERE min_x >= floor(min_x / 128) * 128 + 4 AND max_x <= floor(min_x / 128) * 128 + 124 AND min_y >= floor(min_y / 128) * 128 + 4 AND max_y <= floor(min_y / 128) * 128 + 124""")
def a27(spark, d):
    b = boxes(spark, d).withColumn("tx", F.floor(F.col("min_x") / 128)).withColumn("ty", F.floor(F.col("min_y") / 128))
    return A.dedupe_seams(b, 128, 4).select("key")


@query("a28_node_labels", """WITH s AS (SELECT l_partkey % 200 AS node, l_linenumber AS cls, round(avg(l_quantity), 6) AS score FROM lineitem GROUP BY 1, 2)
 SELECT node, first(cls ORDER BY score DESC, cls)::BIGINT AS label, max(score) AS score FROM s GROUP BY 1""")
def a28(spark, d):
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    members = i.select((F.col("l_partkey") % 200).alias("node"), F.monotonically_increasing_id().alias("_"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").drop("_")
    scores = i.groupBy((F.col("l_partkey") % 200).alias("node"), F.col("l_linenumber").cast("long").alias("cls")).agg(F.round(F.avg("l_quantity"), 6).alias("score"))
    return A.label_nodes(members.select("node").distinct(), scores, ["node"])
