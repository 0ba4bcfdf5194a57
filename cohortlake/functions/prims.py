"""Portable hash, prefix sums over distinct values, grid keys and element-wise vector aggregates."""

import re
import tempfile
import uuid
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

M = 2147483647


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def h(x, seed: int = 1) -> Column:
    """Integer hash in 0..M-1 that other SQL engines compute alike; x is an integer column."""
    u = (F.pmod(col(x).cast("long"), F.lit(M)) * 48271 + seed * 40503 + 11) % M
    v = (u * u + 12345) % M
    return (v * 69621 + u) % M


def h_sql(x: str, seed: int = 1) -> str:
    u = f"(((({x})::BIGINT % {M}) * 48271 + {seed * 40503 + 11}) % {M})"
    v = f"(({u} * {u} + 12345) % {M})"
    return f"(({v} * 69621 + {u}) % {M})"


def key_number(c) -> Column:
    """A string key as an integer for ``h``."""
    return F.conv(F.substring(F.md5(col(c)), 1, 8), 16, 10).cast("long")


def key_number_sql(c: str) -> str:
    return f"('0x' || substr(md5({c}), 1, 8))::BIGINT"


def prefix(df: DataFrame, group: list[str], value: str, sums: dict[str, Column], descending: bool = False, least: bool = False) -> DataFrame:
    """One row a distinct value: the sums there, and ``<name>_upto``, those up to and with it; minima if ``least``.

    Rows are reduced to distinct values first.  These are dealt out by ranges of (group, value), cut
    at the data's own quantiles, whatever their type or spread, so each task takes its share of them,
    though one group or a narrow band of values may hold most.  Sums run on inside each range as it is
    written; a group that goes over several ranges is shifted by its sums in the ranges before.  At
    most two groups reach out of a range, so of those shifts there are fewer than twice the ranges.

    The ranges are written to the shared folder, so that they are cut once.
    """
    how, join = (F.min, F.least) if least else (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))
    one = df.groupBy(*group, value).agg(*(how(c).alias(n) for n, c in sums.items()))
    order = [*map(F.col, group), F.col(value).desc() if descending else F.col(value).asc()]
    spread = one.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*spread.schema.fields, *(T.StructField(f"_in_{n}", spread.schema[n].dataType) for n in sums)])
    rows = materialize(spread.mapInArrow(running(group, list(sums), least), schema))
    parts = rows.groupBy(*group, "_part").agg(*(how(n).alias(n) for n in sums))
    own = Window.partitionBy(*(group or [F.lit(0)]))
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(*group, "_part", F.count("*").over(own).alias("_ranges"), *(how(n).over(before).alias(f"_before_{n}") for n in sums)).where("_ranges > 1")
    same = reduce(and_, (F.col(f"_x.{g}").eqNullSafe(F.col(f"_y.{g}")) for g in [*group, "_part"]))
    both = rows.alias("_x").join(F.broadcast(shifts).alias("_y"), same, "left")
    upto = lambda n: join(F.col(f"_x._in_{n}"), F.col(f"_y._before_{n}")).alias(f"{n}_upto")
    return both.select(*(F.col(f"_x.{c}") for c in [*group, value, *sums]), *map(upto, sums))


def running(group: list[str], sums: list[str], least: bool = False):
    """Appends running sums (or minima) to sorted batches, anew for each group; a group may go over batches."""

    def run(batches):
        none = np.inf if least else 0
        last, held = None, {n: none for n in sums}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for g in group:
                at = batch.column(g).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= at[1:] != at[:-1]
            key = lambda i: repr([batch.column(g)[i].as_py() for g in group])  # noqa: B023, E731
            new[0] = last is None or key(0) != last
            last, first = key(n - 1), np.flatnonzero(new)
            out = []
            for name in sums:
                x = batch.column(name).fill_null(none).to_numpy(zero_copy_only=False)
                if least:
                    x = np.concatenate([np.minimum.accumulate(p) for p in np.split(x, first) if len(p)])
                    total = x if new[0] else np.where(np.cumsum(new) > 0, x, np.minimum(x, held[name]))
                    held[name] = total[-1]
                    out.append(pa.array(total, type=batch.column(name).type))
                    continue
                total = np.cumsum(x)
                # What the total was where the group of each row began; the first may go on from the batch before.
                start = np.where(first > 0, total[first - 1], 0) if len(first) else total[:0]
                which = np.cumsum(new) - 1
                total = total - np.where(which >= 0, start[np.maximum(which, 0)], 0) if len(first) else total
                total = total + np.where(which < 0, held[name], 0)
                held[name] = total[-1]
                out.append(pa.array(total, type=batch.column(name).type))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(f"_in_{name}" for name in sums)])

    return run


def mid_ranks(df: DataFrame, group: list[str], value: str, name: str = "rank") -> DataFrame:
    """df with the mid-rank of ``value`` in its group (ties share the mean of their ranks)."""
    p = prefix(df.where(F.col(value).isNotNull()), group, value, {"_n": F.lit(1)})
    p = p.select(*group, value, (F.col("_n_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(p, [*group, value])


def elements(df: DataFrame, keys: list[str], vector: str, how: dict[str, str]) -> DataFrame:
    """Element-wise aggregates of a vector column: (keys, pos, one column for each aggregate)."""
    made = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_pop, "std_sample": F.stddev_samp}
    return df.select(*keys, F.posexplode(vector).alias("pos", "_v")).groupBy(*keys, "pos").agg(*(made[f](F.col("_v").cast("double")).alias(n) for n, f in how.items()))


def gather(df: DataFrame, keys: list[str], value: str, name: str = "vector") -> DataFrame:
    """(keys, pos, value) rows back to one array a key, in order of pos."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def exact_mean(c) -> Column:
    """Mean as an aggregate that does not hang on the order of the rows: equal means are equal doubles.

    Values are summed as decimals of 15 digits after the point; with any that is none (infinite,
    over 1e17) the plain mean is taken.
    """
    d = col(c).cast("double").try_cast("decimal(32,15)")
    return F.when(F.count(d) == F.count(col(c)), F.avg(d).cast("double")).otherwise(F.avg(col(c).cast("double")))


def corr(a, b) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant."""
    a, b = F.when(col(b).isNotNull(), col(a)), F.when(col(a).isNotNull(), col(b))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def l2(v) -> Column:
    """Vector scaled to length 1 (floor 1e-8)."""
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-8))
    return F.transform(col(v), lambda x: x.cast("double") / n)


def hash_rank(df: DataFrame, group: list[str], hashed: str, *tie: str, name: str = "rank", buckets: int = 4096) -> DataFrame:
    """df with each row's rank by a column of ``h`` in its group, from 1.

    Ranks are taken inside ranges of the hash and shifted by the counts of the ranges before,
    so a group that holds most rows is still dealt to many tasks.
    """
    b = F.floor(F.col(hashed) * buckets / M).cast("int")
    rows = df.withColumn("_b", b)
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n")).select(*group, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(hashed, *tie))
    return rows.withColumn("_inner", inner).join(before, [*group, "_b"]).withColumn(name, F.col("_before") + F.col("_inner")).drop("_b", "_inner", "_before")


def cell(c, size: float) -> Column:
    return F.floor(col(c) / F.lit(float(size))).cast("long")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark) -> str:
    """The folder that driver and executors share.

    Where none is named, a session of one machine gets a temporary one; a cluster is an error.
    """
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    at = sc.getConf().get("spark.checkpoint.dir") or (set_.get() if set_.isDefined() else None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cohortlake-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Written to the shared folder and reread: cuts the plan between rounds.

    A table that ``forget`` doesn't delete before goes when the driver ends.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
