"""Mixing sources to target weights, native Spark.

Each source's documents form one word stream, packed into blocks of ``block`` words.
Output shards of ``shard`` slots draw their sources multinomially (by a keyed hash of the
slot number, so reruns agree); a closing shard levels each source to its quota.  Slots of
a source are numbered 0, 1, ... and sent through an affine permutation of its block
numbers, a new one for every pass over the source; blocks are then joined by number.

Documents are numbered and written once, with their size, so that words are counted once and
a number of 64 bits, not a hash, names a row from then on.  Streams and slots are numbered by
running sums inside buckets, shifted by the sums of the buckets before: no source is in one task.

Nulls and empties: a null source is a source of its own, last in order; a text without
words has size 0 and takes 0; null or repeated doc_ids are rows of their own.  Input columns
named like the added ones give way to them.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table, without, word_count, words

NEW = ("size", "source_size", "target", "taken")
#: Multipliers of the permutations: primes; the first that divides no block count is used.
PRIMES = [1000003, 1299709, 1500007, 1750009, 2000003, 2250013, 2500009, 2750159]


def targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> adds ``target``: water-filling of share * total under cap * size.

    The table has one row a source, so the one ordered window over it is as small as that.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("w", w).withColumn("top", cap * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(upto), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
    # The level is right at the first source that it doesn't fill to the top.
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("top"), F.struct(F.col("top") / F.col("w"), F.col("level").alias("level")))).over(every)
    return rows.withColumn("target", F.coalesce(F.least(F.col("top"), level["level"] * F.col("w")), F.col("top"))).select("source", "source_size", "w", "target")


def pick(seed: str, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def permuted(index: Column, epoch: Column, n: Column, source: Column, seed: str) -> Column:
    """Affine permutation of 0..n-1; n stays under 2**41, so products fit 63 bits."""
    fit = F.filter(F.array(*(F.lit(p) for p in PRIMES)), lambda p: n % p != 0)
    a = F.element_at(fit, (F.pmod(pick(seed + "a", source, epoch), F.size(fit)) + 1).cast("int")).cast("long")
    return F.pmod(index * a + F.pmod(pick(seed + "c", source, epoch), n), n)


def running(df: DataFrame, key: str, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` over the rows of its key before it: by bucket, then in order inside the bucket."""
    whole = df.groupBy(key, bucket).agg(F.sum(value).alias("_all"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col(key).alias("_key"), F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(whole, (F.col(key) == F.col("_key")) & (F.col(bucket) == F.col("_bucket"))).withColumn(name, F.col("_from") + F.col("_inner")).drop("_key", "_bucket", "_from", "_inner")


def numbered(docs: DataFrame) -> DataFrame:
    """(id, row, size, sid, hash), written: every document as a struct, with a number and its count of words."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    sid = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    return materialize(docs.select(F.monotonically_increasing_id().alias("id"), row.alias("row"), word_count(F.col("text")).alias("size"), sid.alias("sid"), F.xxhash64("doc_id", "text").alias("hash")), "numbered")


def plan(rows: DataFrame, block: int, shard: int, weights, share: float, cap: float, seed: str, buckets: int):
    """-> (id, sid, size, start in the source's stream), slots (sid, shard, slot, epoch, block), sources."""
    spark = rows.sparkSession
    slim = rows.select("id", "sid", "size", "hash", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"))
    slim = slim.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "hash"), F.lit(buckets)))
    # Rows alike in all of these are interchangeable, so reruns agree whatever the numbers are.
    placed = running(slim, "sid", "bucket", ["doc_id", "hash", "id"], "size", "start").select("id", "sid", "size", "start")
    sizes = slim.groupBy("source", "sid").agg(F.sum("size").alias("source_size"))
    quota = targets(sizes.drop("sid"), weights, share, cap)
    quota = quota.withColumn("sid", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("blocks", F.ceil(F.col("source_size") / block))
    quota = materialize(quota.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")), "quota")
    # One row for all sources: the slots' cumulative shares, to draw from by one number.
    line = quota.groupBy().agg(F.sum("slots").alias("all"), F.array_sort(F.collect_list(F.struct("sid", "slots"))).alias("parts"))
    line = line.withColumn("ends", F.transform("parts", lambda p, i: F.struct(F.aggregate(F.slice("parts", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x["slots"]).alias("end"), p["sid"].alias("sid"))))
    line = materialize(line.select(F.coalesce("all", F.lit(0)).cast("long").alias("all"), "ends"), "line")
    n = -(-line.first()["all"] // shard)
    shards = spark.range(0, max(1, n), 1, max(1, min(n, 4 * partitions(spark)))).withColumnRenamed("id", "shard").crossJoin(F.broadcast(line))
    draws = shards.select("shard", "all", "ends", F.explode(F.sequence(F.lit(0), F.lit(shard - 1))).alias("k")).where(F.col("shard") * shard + F.col("k") < F.col("all"))
    draws = draws.select("shard", F.element_at(F.filter("ends", lambda e: e["end"] > F.pmod(pick(seed, F.col("shard"), F.col("k")), F.col("all"))), 1)["sid"].alias("sid"))
    counts = materialize(draws.groupBy("sid", "shard").agg(F.count("*").alias("n")), "draws")
    counts = running(counts.withColumn("part", F.floor(F.col("shard") / 1024)), "sid", "part", ["shard"], "n", "first").drop("part")
    drawn = counts.join(quota.select("sid", "slots", "blocks"), "sid").select("sid", "shard", "blocks", "first", F.least("slots", F.col("first") + F.col("n")).alias("until"))
    short = quota.join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").select("sid", F.lit(-1).cast("long").alias("shard"), "blocks", F.coalesce("got", F.lit(0)).alias("first"), F.col("slots").alias("until"))
    # The closing shard can be long for one source: cut into stretches before it is unfolded.
    short = short.where(F.col("first") < F.col("until")).select("sid", "shard", "blocks", F.explode(F.sequence("first", F.col("until") - 1, F.lit(shard).cast("long"))).alias("first"), "until")
    short = short.withColumn("until", F.least("until", F.col("first") + shard))
    runs = drawn.where(F.col("first") < F.col("until")).unionByName(short)
    slots = runs.select("sid", "shard", "blocks", F.explode(F.sequence("first", F.col("until") - 1)).alias("slot"))
    slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")))
    slots = slots.withColumn("block", permuted(F.col("slot") % F.col("blocks"), F.col("epoch"), F.col("blocks"), F.col("sid"), seed))
    return placed, slots, quota


def in_blocks(placed: DataFrame, block: int) -> DataFrame:
    """(.., block, lo, hi): the stretches of the source's stream in which a document meets a block."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    met = placed.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    return met.withColumns({"lo": F.greatest("start", F.col("block") * block), "hi": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)})


def mix(docs: DataFrame, block: int = 64, shard: int = 4096, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", buckets: int = 1024) -> DataFrame:
    """One row a document: the given columns, size, source_size, target, taken (words the mix takes).

    The plan is made on rows without texts; whole rows are shuffled once, to meet their figures.
    """
    docs = without(docs, *NEW)
    rows = numbered(docs)
    placed, slots, quota = plan(rows, block, shard, list(weights), share, cap, seed, buckets)
    uses = slots.groupBy("sid", "block").agg(F.count("*").alias("uses"))
    taken = in_blocks(placed, block).join(uses, ["sid", "block"]).groupBy("id").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("uses")).alias("taken"))
    figures = quota.select("sid", "source_size", "target")
    out = rows.select("id", "row", "size", "sid").join(taken, "id", "left").join(figures, "sid")
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_blocks(docs: DataFrame, block: int = 64, shard: int = 4096, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", buckets: int = 1024) -> DataFrame:
    """The mix itself: (shard, source, slot, block, words), a row a slot, each of at most ``block`` words."""
    rows = numbered(docs)
    placed, slots, quota = plan(rows, block, shard, list(weights), share, cap, seed, buckets)
    text = rows.select("id", words(F.col("row.text")).alias("ws"))
    piece = in_blocks(placed.join(text, "id"), block)
    piece = piece.select("sid", "block", "start", F.slice("ws", (F.col("lo") - F.col("start") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("ws"))
    packed = piece.groupBy("sid", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "ws"))), lambda x: x["ws"])).alias("words"))
    return slots.join(packed, ["sid", "block"]).join(quota.select("sid", "source"), "sid").select("shard", "source", "slot", "block", "words")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
