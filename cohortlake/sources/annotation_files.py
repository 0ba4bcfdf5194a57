"""Readers and writers of annotation files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.annotations import PARTS, moved, with_geometry

#: Coordinates are taken as text: how deep they nest depends on the type.
GEOMETRY = "struct<type:string,coordinates:string>"
FEATURE = f"key string, type string, geometry {GEOMETRY}, properties string"
#: Levels of lists around a coordinate pair.
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def opened(ring: Column) -> Column:
    """A ring without its closing point."""
    n = F.size(ring)
    return F.when((n > 1) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1)), F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(ring)


def parts_of(kind: Column, text: Column, scale=(1.0, 1.0), origin=(0.0, 0.0)) -> Column:
    """GeoJSON coordinates as parts of rings of points; null for other types and coordinates that can't be read."""
    point = lambda p: F.struct(((p[0] - origin[0]) * scale[0]).alias("x"), ((p[1] - origin[1]) * scale[1]).alias("y"))
    line = lambda r: F.transform(r, point)
    rings = lambda part: F.transform(part, lambda r: line(opened(r)))
    read = lambda k: F.from_json(text, "array<" * DEPTH[k] + "array<double>" + ">" * DEPTH[k])
    made = {
        "Point": lambda c: F.array(F.array(F.array(point(c)))),
        "MultiPoint": lambda c: F.transform(c, lambda p: F.array(F.array(point(p)))),
        "LineString": lambda c: F.array(F.array(line(c))),
        "MultiLineString": lambda c: F.transform(c, lambda r: F.array(line(r))),
        "Polygon": lambda c: F.array(rings(c)),
        "MultiPolygon": lambda c: F.transform(c, rings),
    }
    out = F.lit(None).cast(PARTS)
    for k, parts in made.items():
        # As the variable of a function the text is parsed once, however often its value is taken.
        once = F.transform(F.array(read(k)), lambda c: F.when(c.isNotNull(), parts(c)))  # noqa: B023
        out = F.when(kind == k, F.get(once, F.lit(0))).otherwise(out)
    return out


def features(rows: DataFrame, bad: str, scale=(1.0, 1.0), origin=(0.0, 0.0)) -> DataFrame:
    """(key, geometry, properties) as annotations.

    A missing key is the hash of the feature's content: the same on every read, and the same for
    features that are the same.  ``bad``: geometries of other types, or that can't be read, are kept
    with null parts and bounds (``null``), left out (``drop``), or end the job (``fail``).
    """
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    key = F.coalesce("key", F.sha2(F.concat_ws("\n", F.coalesce(kind, F.lit("")), F.coalesce(text, F.lit("")), F.coalesce("properties", F.lit(""))), 256))
    out = rows.select(key.alias("key"), kind.alias("geom_type"), parts_of(kind, text, scale, origin).alias("parts"), "properties")
    if bad == "fail":
        said = F.raise_error(F.concat(F.lit("geometry can't be read, key "), F.col("key"))).cast(PARTS)
        out = out.withColumn("parts", F.coalesce("parts", said))
    elif bad == "drop":
        out = out.where("parts is not null")
    return with_geometry(out)


def read_features_ndjson(spark: SparkSession, path: str, bad: str = "null") -> DataFrame:
    """One feature a line, of any of the six simple types of geometry."""
    return features(spark.read.schema(FEATURE).json(path), bad)


def read_geojson(spark: SparkSession, path: str, scale=(1.0, 1.0), origin=(0.0, 0.0), bad: str = "null") -> DataFrame:
    """Feature collections, one a file or a text sequence of them; moved by -origin, then scaled.

    A file is one record: its separator is a control character, which JSON can't hold unescaped.
    ``multiLine`` would seek in the file again for each value that is taken as text.
    """
    collection = f"features array<struct<key:string,type:string,geometry:{GEOMETRY},properties:string>>"
    rows = spark.read.schema(collection).json(path, lineSep="\x1e")
    return features(rows.select(F.explode("features").alias("f")).select("f.key", "f.geometry", "f.properties"), bad, scale, origin)


def coordinates(df: DataFrame) -> Column:
    """GeoJSON coordinates of each row, as text, from ``parts`` or else from ``coords``; null without any."""
    pair = lambda p: F.array(p["x"], p["y"])
    line = lambda r: F.transform(r, pair)
    closed = lambda r: line(F.concat(r, F.slice(r, 1, 1)))
    kind = kind_of(df)
    if "parts" not in df.columns:
        c = F.col("coords")
        return F.when(kind == "Polygon", F.to_json(F.array(closed(c)))).when(kind.isin("LineString", "MultiPoint"), F.to_json(line(c))).otherwise(F.to_json(pair(F.get(c, F.lit(0)))))
    parts = F.col("parts")
    first = F.get(parts, F.lit(0))
    made = {
        "Point": pair(F.get(F.get(first, F.lit(0)), F.lit(0))),
        "MultiPoint": F.transform(parts, lambda p: pair(p[0][0])),
        "LineString": line(F.get(first, F.lit(0))),
        "MultiLineString": F.transform(parts, lambda p: line(p[0])),
        "Polygon": F.transform(first, closed),
        "MultiPolygon": F.transform(parts, lambda p: F.transform(p, closed)),
    }
    out = F.lit(None).cast("string")
    for k, c in made.items():
        out = F.when(kind == k, F.to_json(c)).otherwise(out)
    return F.when(parts.isNotNull(), out)


def kind_of(df: DataFrame) -> Column:
    return F.coalesce("geom_type", F.lit("Point")) if "geom_type" in df.columns else F.lit("Point")


def feature_json(df: DataFrame) -> DataFrame:
    """One GeoJSON feature a row, as text: the geometry of ``geom_type`` (a point where there is none), null without coordinates."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.cast("string").alias("k"))), r'^\{"k":(.*)\}$', 1)
    geometry = F.concat(F.lit('{"type":'), quoted(kind_of(df)), F.lit(',"coordinates":'), coordinates(df), F.lit("}"))
    parts = [F.lit('{"key":'), quoted(F.col("key")), F.lit(',"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), F.coalesce("properties", F.lit("{}")), F.lit("}")]
    return df.select(F.concat(*parts).alias("value"))


def write_features(df: DataFrame, path: str) -> None:
    feature_json(df).write.text(path)


def write_geojson(df: DataFrame, path: str, features: int = 10_000) -> None:
    """Feature collections under ``path``, each a file of about that many features in a folder of its own.

    Their number follows the rows, so no file, and no task that writes or reads one, grows with the table.
    """
    files = max(1, -(-df.count() // features))
    text = feature_json(df).repartition(files).withColumn("file", F.spark_partition_id())
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}"))
    text.groupBy("file").agg(whole.alias("value")).write.partitionBy("file").text(path)


def read_locations(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """x, y and an optional class (0 where absent)."""
    rows = spark.read.schema("x double, y double, class int")
    rows = rows.csv(path, header=True) if kind == "csv" else rows.json(path)
    return rows.withColumn("class", F.coalesce("class", F.lit(0)))


def rescaled(df: DataFrame, scale: float, origin=(0.0, 0.0)) -> DataFrame:
    """Coordinates moved by -origin, then scaled."""
    move = lambda p: F.struct(((p["x"] - origin[0]) * scale).alias("x"), ((p["y"] - origin[1]) * scale).alias("y"))
    return moved(df, move)
