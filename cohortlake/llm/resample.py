"""Target-distribution importance resampling: array-scored weights, exact cutoff by medians of medians.

Features (runs of consecutive words) are hashed into buckets.  The counts of all documents and of
all target texts give one gain a bucket, an array of fixed size, and a document's weight is the mean
gain of its features.  A Gumbel number drawn from its doc_id makes the highest scores a sample
without replacement in proportion to the weights.

The highest are found by weighted median-of-medians selection: each partition of the key table
tells the median and the number of its keys that are still open, the median of these medians,
weighted by those numbers, becomes the pivot, and at least a quarter of the open keys falls to one
side of it.  A round reads the keys once and sends one row a partition; the next one asks for both
sides of the pivot at once.  It ends at the key of the stated place.  Winners are then sorted by range.

Nulls and empties: a null text counts as empty, a text without words has no features and weight 0;
a null doc_id draws as the empty string and comes after all others in ties.  Rows that share doc_id
and score stand or fall together, but their ranks end at the stated place.  Input columns named like
the added ones give way to them, others pass through.
"""

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, forget, materialize, table, without

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ADDED = ("n_words", "n_features", "weight", "score")
LAST = (1 << 63) - 1


def tokens(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def bucketed(words: str, longest: int, buckets: int) -> Column:
    """The bucket of every run of 1 to ``longest`` words in an array column, repeats counted."""
    bucket = lambda f: F.crc32(f.cast("binary")) % buckets

    def runs(k: int) -> Column:
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: bucket(F.array_join(F.slice(words, i + 1, F.lit(k)), " ")))

    return F.concat(F.transform(words, bucket), *(runs(k) for k in range(2, longest + 1)))


def counted(texts: DataFrame, name: str, longest: int, buckets: int) -> DataFrame:
    rows = texts.select(tokens(F.col("text")).alias("w")).select(F.explode(bucketed("w", longest, buckets)).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> list[int]:
    """floor(1000 * log ratio of smoothed shares) of each bucket: ``buckets`` numbers, whatever the input."""
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counted(docs, "s", longest, buckets), "bucket", "left").join(counted(target, "t", longest, buckets), "bucket", "left").fillna(0)
    every = Window.partitionBy(F.lit(0))
    s, t, S, T = F.col("s").cast("double"), F.col("t").cast("double"), F.sum("s").over(every), F.sum("t").over(every)
    ratio = (t + 1) * (S + buckets) / ((s + 1) * (T + buckets))
    return [gain for _, gain in sorted(map(tuple, both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long")).collect()))]


def scored(docs: DataFrame, gain: list[int], seed: int = 2024, longest: int = 1) -> DataFrame:
    """``docs`` with n_words, n_features, weight and score."""
    docs = without(docs, *ADDED)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), named), 256), 1, 8), 16, 10).cast("double")
    table_ = F.from_json(F.lit(json.dumps(gain)), "array<bigint>")
    rows = docs.select(row.alias("row"), h.alias("h"), tokens(F.col("text")).alias("w"))
    rows = rows.select("row", "h", F.size("w").cast("long").alias("n_words"), F.transform(bucketed("w", longest, len(gain)), lambda b: F.get(table_, b.cast("int"))).alias("g"))
    rows = rows.select("row", "h", "n_words", F.size("g").cast("long").alias("n_features"), F.aggregate("g", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum"))
    weight = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(0).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((F.col("h") + 0.5) / 4294967296.0))).cast("long")
    rows = rows.select("row", "n_words", "n_features", weight.alias("weight"), (weight + gumbel).alias("score"))
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns), *ADDED)


# --- selection ------------------------------------------------------------------------


def weighted_median(keys: list[tuple], sizes: list[int]) -> tuple:
    """The least key with half of the sizes at or under it."""
    half, run = sum(sizes) / 2, 0
    for key, size in sorted(zip(keys, sizes)):
        run += size
        if run >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, percent: int) -> tuple[tuple[int, int] | None, int, int]:
    """((score, tie) of the last winner, number of winners, rounds) among the rows (score, tie) of ``keys``.

    Keys are ordered by falling score, then by rising tie, here as (-score, tie).
    """
    low = high = pivot = place = None
    passed = rounds = 0
    while True:
        open_ = keys
        if low:
            open_ = open_.where(F.col("score") <= -low[0])
        if high:
            open_ = open_.where(F.col("score") >= -high[0])

        def ask(batches: Iterator[pd.DataFrame], low=low, high=high, pivot=pivot) -> Iterator[pd.DataFrame]:
            held = [b for b in batches if len(b)]
            if not held:
                return
            a, b = -np.concatenate([x["score"].to_numpy() for x in held]), np.concatenate([x["tie"].to_numpy() for x in held])
            over = lambda k: (a > k[0]) | ((a == k[0]) & (b > k[1]))
            under = lambda k: (a < k[0]) | ((a == k[0]) & (b < k[1]))
            live = np.ones(len(a), bool)
            if low:
                live &= over(low)
            if high:
                live &= under(high)
            a, b = a[live], b[live]
            sides = {"above": np.ones(len(a), bool)} if pivot is None else {"below": under(pivot), "above": over(pivot)}
            out = {"equal": len(a) - sum(int(s.sum()) for s in sides.values())}
            for side in ("below", "above"):
                at = np.flatnonzero(sides.get(side, np.zeros(0, bool)))
                out[f"n_{side}"], out[f"a_{side}"], out[f"b_{side}"] = len(at), 0, 0
                if len(at):
                    mid = at[np.lexsort((b[at], a[at]))[(len(at) - 1) // 2]]
                    out[f"a_{side}"], out[f"b_{side}"] = int(a[mid]), int(b[mid])
            yield pd.DataFrame([out])

        told = open_.select("score", "tie").mapInPandas(ask, "equal long, n_below long, a_below long, b_below long, n_above long, a_above long, b_above long").collect()
        rounds += 1
        below, equal = sum(r.n_below for r in told), sum(r.equal for r in told)
        if place is None:
            place = percent * sum(r.n_above for r in told) // 100
            if place < 1:
                return None, 0, rounds
            side = "above"
        elif passed + below >= place:
            high, side = pivot, "below"
        elif passed + below + equal >= place:
            return (-pivot[0], pivot[1]), place, rounds
        else:
            low, side, passed = pivot, "above", passed + below + equal
        some = [r for r in told if r[f"n_{side}"]]
        pivot = weighted_median([(r[f"a_{side}"], r[f"b_{side}"]) for r in some], [r[f"n_{side}"] for r in some])


def tie() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(LAST))


def won(cut: tuple[int, int] | None, min_words: int) -> Column:
    if cut is None:
        return F.lit(False)
    return (F.col("n_words") >= min_words) & ((F.col("score") > cut[0]) | ((F.col("score") == cut[0]) & (tie() <= cut[1])))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """The drawn documents, with n_words, n_features, weight and score: the nearest to ``target`` likelier."""
    rows = scored(docs, gains(docs, target, longest, buckets), seed, longest)
    keys = materialize(rows.where(F.col("n_words") >= min_words).select("score", tie().alias("tie")), "keys")
    cut, _, _ = cutoff(keys, percent)
    forget(keys)
    return rows.where(won(cut, min_words))


def ranked(rows: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of all documents with their rank, null where not drawn.

    Winners are written sorted by range with their place in their part; the parts' sizes, one row
    a part, say where each part begins.
    """
    keys = materialize(rows.select("doc_id", *ADDED, tie().alias("tie")).sortWithinPartitions("score"), "keys")
    cut, place, _ = cutoff(keys.where(F.col("n_words") >= min_words), percent)
    rest = keys.where(~won(cut, min_words)).withColumn("rank", F.lit(None).cast("long"))
    drawn = keys.where(won(cut, min_words)).repartitionByRange(F.col("score").desc(), "tie").sortWithinPartitions(F.col("score").desc(), "tie")
    drawn = materialize(drawn.withColumn("at", F.monotonically_increasing_id()), "drawn")
    part, inner = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1) + 1
    parts = drawn.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("before") + F.col("inner")
    drawn = drawn.select("doc_id", *ADDED, part.alias("part"), inner.alias("inner")).join(F.broadcast(parts.select("part", before.alias("before"))), "part")
    drawn = drawn.select("doc_id", *ADDED, F.when(rank <= place, rank).alias("rank"))
    return rest.select(*drawn.columns).unionByName(drawn)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return ranked(scored(docs, gains(docs, target))).select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum's table is made by its rule; distinct words are few, so each is summed once.
OP13_SQL = r"""
WITH tab AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL),
bw AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM b) GROUP BY ALL),
hashed AS (SELECT x, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(x))), lambda k: ('0x' || substr(hex(encode(x)), (2 * k + 1)::INT, 2))::BIGINT)), lambda a, y: xor(a >> 8, tab[xor(a & 255, y) + 1]))) % 10000 AS bucket
           FROM (SELECT DISTINCT x FROM (SELECT x FROM dw UNION ALL SELECT x FROM bw)), tab),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (x) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN hashed USING (x) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(n * gain)::BIGINT AS total, sum(n)::BIGINT AS n FROM dw JOIN hashed USING (x) JOIN g USING (bucket) GROUP BY doc_id),
k AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight, ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, n_features, weight::BIGINT AS weight, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM k),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM r LEFT JOIN o USING (doc_id)
"""
