"""Outcome tables and folds."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.prims import first_by, h


def survival_table(df: DataFrame, subject: str, event: Column, time: Column, *order: Column) -> DataFrame:
    """(subject, event 0/1, duration > 0): the first row of a subject, without nulls."""
    rows = df.select(F.col(subject).alias("subject"), F.when(event, 1).otherwise(0).alias("event"), time.alias("duration"), *order)
    one = first_by(rows, ["subject"], *(F.col(c) for c in rows.columns[3:]))
    return one.select("subject", "event", "duration").where("duration is not null and duration > 0")


def duration(death: Column, follow_up: Column, zero_is_missing: bool = False) -> Column:
    return F.when(death != 0, death).otherwise(follow_up) if zero_is_missing else F.coalesce(death, follow_up)


def min_class(df: DataFrame, c: str, n: int) -> DataFrame:
    """Rows of classes with at least n of them."""
    return df.join(df.groupBy(c).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(c), c, "left_semi")


def factorize(df: DataFrame, c: str, order: str) -> DataFrame:
    """Class numbers by first appearance in a stated order."""
    seen = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias("_first"))
    return df.join(seen.withColumn("code", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("_first")) - 1).drop("_first"), c)


def class_info(df: DataFrame, c: str, name: str) -> DataFrame:
    """(class, names, one_to_one)."""
    return df.groupBy(c).agg(F.count_distinct(name).alias("names"), F.min(name).alias("name")).withColumn("one_to_one", F.col("names") == 1)


def pool(df: DataFrame, key: str, columns: list[str], how: str = "mean", scale: float = 1.0) -> DataFrame:
    f = {"mean": F.avg, "max": F.max, "min": F.min}[how]
    return df.groupBy(key).agg(*((f(c) * scale).alias(c) for c in columns))


def prefix_columns(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns))


def min_nonnull(long: DataFrame, feature: str, value: str, n: int) -> DataFrame:
    """Rows of features with at least n values."""
    ok = long.groupBy(feature).agg(F.count(value).alias("_n")).where(F.col("_n") >= n).select(feature)
    return long.join(ok, feature, "left_semi")


def merge_outcomes(tables: list[DataFrame], key: str, subjects: DataFrame) -> DataFrame:
    """All tasks side by side, for the subjects asked for."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), tables).join(subjects, key, "left_semi")


def class_balance(df: DataFrame, c: str, n: int) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n")).withColumn("kept", F.col("n") >= n)


def kfold(df: DataFrame, key: str, k: int, valid: float, seed: int = 1) -> DataFrame:
    """(fold, role, key): a key is tested in one fold; a hashed share of the rest validates.

    Keys are dealt by rank of their hash inside 1000 hash buckets, so no window holds them all.
    """
    keys = df.select(key).distinct().withColumn("_h", h(key, seed))
    w = Window.partitionBy(F.col("_h") % 1000).orderBy("_h", key)
    dealt = keys.withColumn("_own", (F.row_number().over(w) + F.col("_h") % 1000) % k)
    each = dealt.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    second = h(F.col("_h") + F.col("fold"), seed + 1) % 1000 < int(valid * 1000)
    return each.select("fold", F.when(F.col("_own") == F.col("fold"), "test").when(second, "valid").otherwise("train").alias("role"), key)


def attach(folds: DataFrame, outcomes: DataFrame, key: str, keep_unlabelled: bool = False) -> DataFrame:
    return folds.join(outcomes, key, "left" if keep_unlabelled else "inner")


def oof(preds: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """(key, fold, prediction) from the fold that tests a key, with how often it is there."""
    test = folds.where("role = 'test'").select("fold", key)
    one = preds.join(test, ["fold", key])
    return one.groupBy(key).agg(F.min("fold").alias("fold"), F.min("prediction").alias("prediction"), F.count("*").alias("times"))


def common_subjects(preds: DataFrame, key: str, model: str, models: int) -> DataFrame:
    """Keys that every model has."""
    return preds.groupBy(key).agg(F.count_distinct(model).alias("n")).where(F.col("n") == models).select(key)
