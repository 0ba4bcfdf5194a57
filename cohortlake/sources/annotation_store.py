"""A stored annotation layout that region queries read only a part of.

Rows are ordered along a Morton curve through their centres and written as Parquet with their
bounds as columns.  Neighbours in space lie in the same file and row group, so the bounds of a
region query, which reach the scan as they are, skip most row groups by their statistics.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a coordinate on the curve.
BITS = 16
ROW_GROUP = 4 << 20


def spread(c: Column) -> Column:
    """The low 16 bits, each followed by a zero bit."""
    for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def curve(x, y, box: tuple[float, float, float, float]) -> Column:
    """Place of a point of ``box`` on the Morton curve; points without coordinates come first."""
    top = (1 << BITS) - 1
    at = lambda c, low, high: F.least(F.greatest(F.floor((F.col(c) - low) / max(high - low, 1e-12) * top), F.lit(0)), F.lit(top)).cast("long")
    return F.coalesce(spread(at(x, box[0], box[2])).bitwiseOR(F.shiftleft(spread(at(y, box[1], box[3])), 1)), F.lit(-1))


def write_store(df: DataFrame, path: str, row_group: int = ROW_GROUP, files: int | None = None) -> None:
    """Annotations in curve order; ``files``: how many at least (by default as Spark sees fit)."""
    box = df.agg(F.min("cx"), F.min("cy"), F.max("cx"), F.max("cy")).collect()[0]
    box = tuple(box) if None not in tuple(box) else (0.0, 0.0, 1.0, 1.0)
    by = df.withColumn("_curve", curve("cx", "cy", box))
    by = by.repartitionByRange(files, "_curve") if files else by.repartitionByRange("_curve")
    by.sortWithinPartitions("_curve").drop("_curve").write.option("parquet.block.size", row_group).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
