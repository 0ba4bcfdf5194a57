"""Coordinates of features are parsed once a row."""

from pyspark.sql import functions as F

from cohortlake.sources import annotation_files as S


def test_coordinates_are_parsed_once(spark):
    texts = S.parts_of(F.col("kind"), F.col("text"))
    rows = spark.createDataFrame([("Polygon", "[[[0,0],[1,0],[1,1],[0,0]]]"), ("Polygon", "no"), ("Point", "[1"), ("LineString", None), ("Circle", "[1,2]")], "kind string, text string").select(texts.alias("p"))
    assert [r.p is None for r in rows.collect()] == [False, True, True, True, True]
    assert rows._jdf.queryExecution().analyzed().toString().count("from_json(") == 6
