"""MinHash near-dedup with tensored banding, and exact confirmation.

Two collections of ``half`` small hashes, each of ``rows`` minhashes, are combined pair by
pair into table keys: hash i of the one with hashes i, i + 1, ... i + spans - 1 of the other.
36 keys of four minhashes each come from 48 minhash functions in place of 144.  Of pairs at
similarity 0.8, 5 in 100,000 share no key (simulated; at 0.85 one in a million), and 1.3 in
100,000 agree in fewer than ``need`` of the 48 minhashes, the least that a pair is looked at for.

Texts with equal shingle sets are one class.  Then, in rounds, all confirmed on full sets:

1. In every key the class whose keys are shared most (of a group of copies, that nearest to
   its middle) is the centre, and the others are held against it.
2. What is left are keys whose classes still lie in several components.  In keys of up to
   ``FEW`` classes these are compared with each other.  In larger ones (near copies that stay
   under the share) every class is held against its key's centre: d(a) are the shingles that
   one of the two has and the other has not.  With q = (100 - share) / (100 + share), two classes
   are to be linked if and only if their sets differ in at most q * (n(a) + n(b)) shingles, that
   is, if d(a) and d(b) share at least t = (|d(a)| + |d(b)| - q * (n(a) + n(b))) / 2.  That is
   over 0 when one of the two is not linked with the centre.  So in any order of the shingles
   the first |d| - t + m of both have m in common (m up to t), and only classes that meet so
   often in these are compared.  Shingles that differ in one class alone come first, frequent ones last: near
   copies that each went their own way don't meet.

Nulls and empties: texts without words have no shingles, belong to their own class and are
linked with nothing; a null doc_id is kept, as a document of its own with a null component;
rows that repeat a doc_id each get a row, linked by their own text alone.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.graph import components

from . import sketch
from .common import Hasher, forget, fresh, materialize, mix64, table, word_spans


class Shingler:
    """Distinct shingle hashes of a text: k words, ASCII letters in lower case."""

    def __init__(self, k: int):
        self.k, self.hasher = k, Hasher(11)

    def __call__(self, raw: bytes | None) -> np.ndarray:
        ws, joined, start, end = word_spans((raw or b"").lower())
        if not ws:
            return np.zeros(0, np.uint64)
        k = min(self.k, len(ws))
        p = self.hasher.prefix(np.frombuffer(joined, np.uint8))
        return np.unique(self.hasher.spans(p, start[: len(start) - k + 1], end[k - 1 :]))


class MinHash:
    def __init__(self, n: int):
        rng = np.random.default_rng(17)
        self.a = rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(1, 1 << 63, n, dtype=np.uint64)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """n minhashes of 32 bits."""
        out = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(s), 4096):
            part = s[at : at + 4096]
            h = ((part[None, :] * self.a[:, None] + self.b[:, None]) >> np.uint64(32)).astype(np.uint32)
            out = np.minimum(out, h.min(1))
        return out


def text_key() -> Column:
    """Tells the texts of a repeated doc_id apart."""
    return F.xxhash64("text")


def each(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, one made at a time: its texts are never all copied out of it."""
    return zip(*((x.as_py() for x in c) for c in b.columns))


def batch(rows: list[tuple], types: dict) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ((),) * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values())], names=list(types))


def signatures(docs: DataFrame, k: int, half: int, rows: int) -> DataFrame:
    """(doc_id, h, n, s1, s2, sig): set size, 128-bit hash of the set, minhashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, mins = Shingler(k), MinHash(2 * half * rows)
        signed = lambda x: x - (x >> 63 << 64)
        for b in batches:
            out = []
            for d, h, t in each(b):
                s = cut(t)
                with np.errstate(over="ignore"):
                    one = int((s * np.uint64(0xC2B2AE3D27D4EB4F) ^ (s >> np.uint64(29))).sum(dtype=np.uint64)) if len(s) else 0
                    two = int((s ^ (s * np.uint64(0x165667B19E3779F9) >> np.uint64(17))).sum(dtype=np.uint64)) if len(s) else 0
                out.append((d, h, len(s), signed(one), signed(two), mins(s).astype("<u4").tobytes()))
            yield batch(out, made)

    made = {"doc_id": "int64", "h": "int64", "n": "int64", "s1": "int64", "s2": "int64", "sig": "binary"}
    return docs.select("doc_id", text_key().alias("h"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, h long, n long, s1 long, s2 long, sig binary")


def table_keys(classes: DataFrame, half: int, rows: int, spans: int) -> DataFrame:
    """(c, key): one row for each of the half * spans keys of a class."""
    w = 4 * rows
    hashes = [F.substring("sig", i * w + 1, w) for i in range(2 * half)]
    keys = [F.xxhash64(F.lit(i * spans + d), hashes[i], hashes[half + (i + d) % half]) for i in range(half) for d in range(spans)]
    return classes.select("c", F.explode(F.array(*keys)).alias("key"))


def similar_sizes(a: str, b: str, share: int) -> Column:
    """Sizes that allow share / 100 at all."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * share)


def agreeing(pairs: DataFrame, slim: DataFrame, share: int, need: int) -> DataFrame:
    """Pairs (a, b) of similar sizes with at least ``need`` equal minhashes, and their number."""

    @F.pandas_udf("int")
    def equal(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        p, q = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), -1) for s in (x, y))
        return pd.Series((p == q).sum(1).astype("int32"))

    left, right = (slim.select(F.col("c").alias(r), F.col("n").alias(f"n{r}"), F.col("sig").alias(f"s{r}")) for r in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").where(similar_sizes("na", "nb", share))
    return both.withColumn("agree", equal("sa", "sb")).where(F.col("agree") >= need).select("a", "b", "agree")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, share: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough.

    ``a`` is the side with many partners: rows come sorted by it, and its set is made once a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, last, mine = Shingler(k), None, None
        for g in batches:
            out = []
            for a, b, ta, tb in each(g):
                if a != last:
                    last, mine = a, cut(ta)
                s = cut(tb)
                both = len(np.intersect1d(mine, s, assume_unique=True))
                if 100 * both >= share * (len(mine) + len(s) - both):
                    out.append((a, b))
            yield batch(out, {"a": "int64", "b": "int64"})

    return with_texts(pairs, texts).mapInArrow(run, "a long, b long")


def beside(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, core, outside, lacking): how many shingles of b the centre a has, b's others, and the
    centre's that b lacks (both as 32-bit hashes).

    Two shingles with one hash only make two classes seem to share more.
    """
    short = lambda s: (s >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, last, mine = Shingler(k), None, None
        for g in batches:
            out = []
            for a, b, ta, tb in each(g):
                if a != last:
                    last, mine = a, cut(ta)
                s = cut(tb)
                rest = np.setdiff1d(s, mine, assume_unique=True)
                out.append((a, b, len(s) - len(rest), short(rest), short(np.setdiff1d(mine, s, assume_unique=True))))
            yield batch(out, {"a": "int64", "b": "int64", "core": "int64", "outside": pa.list_(pa.int32()), "lacking": pa.list_(pa.int32())})

    return with_texts(pairs, texts).mapInArrow(run, "a long, b long, core long, outside array<int>, lacking array<int>")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, ta, tb), sorted by a inside a task; texts as UTF-8 bytes."""
    raw = F.col("text").cast("binary")
    met = pairs.select("a", "b").join(texts.select(F.col("c").alias("b"), raw.alias("tb")), "b")
    return met.join(texts.select(F.col("c").alias("a"), raw.alias("ta")), "a").select("a", "b", "ta", "tb").sortWithinPartitions("a")


#: Keys of up to this many classes are settled by comparing all of these.
FEW = 16


def meeting(rows: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of rows that meet in ``on``, of different components: columns a_.. and b_.., a_c < b_c."""
    cols = [c for c in rows.columns if c not in on]
    left, right = (rows.select(*on, *(F.col(c).alias(f"{x}_{c}") for c in cols)) for x in "ab")
    return left.join(right, on).where((F.col("a_c") < F.col("b_c")) & (F.col("a_part") != F.col("b_part")))


def named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a_c").alias("a"), F.col("b_c").alias("b")).distinct()


#: Shingles that differ in so many classes of a centre are looked at after the others, step by step.
OFTEN = (32, 256, 2048)
#: Classes have to meet in so many of them before they are compared, or in as many as they need.
MEET = 3


def held(seen: DataFrame, part: DataFrame, share: int) -> DataFrame:
    """Rows (a, c, n, part, far, d, far_first, near_first, differ) of ``beside`` that can be linked across components.

    ``far``: in another component than the centre.  One of two classes is, and of ``differ`` the
    first ``far_first`` can be the first that is shared with a far class, ``near_first`` that a
    far class shares with one of the centre's component.
    """
    own = seen.join(part.withColumnRenamed("c", "b"), "b").join(part.select(F.col("c").alias("a"), F.col("part").alias("pa")), "a")
    d, n, far = F.size("outside") + F.size("lacking"), F.col("n"), F.col("part") != F.col("pa")
    own = own.select("a", F.col("b").alias("c"), "n", "part", far.alias("far"), d.cast("long").alias("d"), F.concat("outside", "lacking").alias("differ"))
    # Two classes share up to all of d: past(a) <= room(b), and the other way round.
    past, room = F.col("d") * (100 + share) - n * (100 - share), F.col("d") * (100 + share) + n * (100 - share)
    ends = [f(F.when(F.col("far") == is_far, x)).alias(f"{name}_{at}") for at, is_far in (("far", True), ("near", False)) for f, x, name in ((F.min, past, "past"), (F.max, room, "room"))]
    met = own.join(own.groupBy("a").agg(*ends), "a")

    def first(at: str) -> Column:
        shared = F.greatest(F.lit(1), F.ceil((past + F.col(f"past_{at}")) / (2 * (100 + share))), F.col("d") - F.floor(n * (100 - share) / share))
        can = (past <= F.col(f"room_{at}")) & (room >= F.col(f"past_{at}"))
        return F.when(can, F.least("d", F.col("d") - shared + MEET)).otherwise(0).cast("long")

    met = met.withColumn("far_first", first("far")).withColumn("near_first", F.when(F.col("far"), first("near")).otherwise(0).cast("long"))
    return met.where("far_first > 0 or near_first > 0").select("a", "c", "n", "part", "far", "d", "far_first", "near_first", "differ")


def differing(rows: DataFrame) -> DataFrame:
    """(s, at, a, c, n, part, far, d, far_first, near_first): the first shingles that differ, without those of one class alone.

    ``s`` names a shingle and its centre.  The order is the same for all classes of a centre:
    first what differs in one class (as far as a sketch of all tells), last what does in many.
    """
    total = rows.agg(F.sum("d")).first()[0] or 0
    width, depth = int(min(26, max(sketch.CHUNK, np.ceil(np.log2(max(2, 8 * total)))))), 2

    def named(g: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Row number and (a, s) as one hash, of each shingle in the batch."""
        lists = g.column("differ")
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        with np.errstate(over="ignore"):
            a = mix64(g.column("a").to_numpy(zero_copy_only=False).view(np.uint64))
            return row, mix64(a[row] ^ lists.flatten().to_numpy().view(np.uint32).astype(np.uint64))

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sketch.Partial(width, depth)
        for g in batches:
            for x in part.add(named(g)[1]):
                yield pa.RecordBatch.from_pandas(x.astype({"part": "int32"}), preserve_index=False)
        for x in part.flush():
            yield pa.RecordBatch.from_pandas(x.astype({"part": "int32"}), preserve_index=False)

    counts = materialize(rows.select("a", "differ").mapInArrow(partials, sketch.SCHEMA), "counts")
    passed = [sketch.merged(counts, width, depth, often) for often in OFTEN]
    forget(counts)
    kept = ["a", "c", "n", "part", "far", "d", "far_first", "near_first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [sketch.Filter(passed[0].value, width, depth), *(sketch.Filter(x.value, width, depth, "hot") for x in passed)]
        for g in batches:
            row, s = named(g)
            tier = sum(kind(s).astype(np.int8) for kind in kinds)
            order = np.lexsort((s, tier, row))
            row, s, tier = row[order], s[order], tier[order]
            at = np.arange(len(row)) - np.searchsorted(row, row) + 1
            last = np.maximum(*(g.column(x).to_numpy(zero_copy_only=False) for x in ("far_first", "near_first")))
            use = np.flatnonzero((tier > 0) & (at <= last[row]))
            found = g.select(kept).take(pa.array(row[use]))
            yield pa.RecordBatch.from_arrays([pa.array(s[use].view(np.int64)), pa.array(at[use]), *found.columns], names=["s", "at", *kept])

    return rows.mapInArrow(run, "s long, at long, a long, c long, n long, part long, far boolean, d long, far_first long, near_first long")


def differing_pairs(first: DataFrame, share: int) -> DataFrame:
    """(a, b, far, pa, pb, more): classes of different components that meet among the first of what differs from a centre.

    ``far`` is the one of them that searched, ``more`` how many more of these they share than they need.
    """
    row = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("c", "n", "part", "d", "at")]
    near = first.where("far and at <= near_first").select("s", F.lit(False).alias("far"), F.col("a").alias("centre"), *row("a"))
    far = first.where("far and at <= far_first").select("s", "far", F.col("a").alias("centre"), *row("a"))
    met = near.union(far).join(first.where("at <= far_first").select("s", "far", *row("b")), ["s", "far"])
    over = (F.col("a_d") + F.col("b_d")) * (100 + share) - (F.col("a_n") + F.col("b_n")) * (100 - share)
    met = met.withColumn("shared", F.ceil(over / (2 * (100 + share))))
    met = met.where((F.col("a_part") != F.col("b_part")) & (~F.col("far") | (F.col("a_c") < F.col("b_c"))) & similar_sizes("a_n", "b_n", share))
    met = met.withColumn("least", F.least(F.greatest("shared", F.lit(1)), F.lit(MEET)))
    met = met.where((F.col("a_at") <= F.col("a_d") - F.col("shared") + F.col("least")) & (F.col("b_at") <= F.col("b_d") - F.col("shared") + F.col("least")))
    ends = [F.least("a_c", "b_c").alias("a"), F.greatest("a_c", "b_c").alias("b"), F.col("a_c").alias("far"), F.col("a_part").alias("pa"), F.col("b_part").alias("pb")]
    met = met.groupBy("centre", *ends).agg(F.count("*").alias("both"), F.max("shared").alias("shared"), F.max("least").alias("least")).where("both >= least")
    return met.withColumn("more", F.col("both") - F.col("shared")).groupBy("a", "b").agg(F.max_by(F.struct("far", "pa", "pb", "more"), "more").alias("x")).select("a", "b", "x.*")


def linked(docs: DataFrame, k: int, share: int, half: int, rows: int, spans: int, need: int):
    """-> (rows of the documents, classes with their component's number, scratch tables)."""
    some = docs.where("doc_id is not null").select("doc_id", "text")
    sigs = materialize(signatures(some, k, half, rows), "signatures")
    groups = sigs.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "h")).alias("low"), F.first("sig").alias("sig"))
    classes = materialize(groups.select(F.monotonically_increasing_id().alias("c"), "s1", "s2", "n", "low.doc_id", "low.h", "sig"), "classes")
    slim = classes.select("c", "n", "sig")
    keys = table_keys(classes, half, rows, spans)
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = keys.join(sizes, "key").groupBy("c").agg(F.sum("size").alias("met"), F.collect_list(F.struct("key", "size")).alias("keys"))
    shared = materialize(shared, "shared")
    # Texts of the classes that share a key with another; all later rounds read these alone.
    wanted = shared.select("c").join(classes.select("c", "doc_id", "h"), "c")
    texts = materialize(some.withColumn("h", text_key()).dropDuplicates(["doc_id", "h"]).join(wanted, ["doc_id", "h"]).select("c", "text"), "texts")

    of_key = shared.select("c", "met", F.explode("keys").alias("k")).select("c", "met", "k.key")
    centre = of_key.groupBy("key").agg(F.max(F.struct("met", (-F.col("c")).alias("m"))).alias("a")).select("key", (-F.col("a.m")).alias("a"))
    star = materialize(agreeing(of_key.join(centre, "key").where(F.col("c") != F.col("a")).select("a", F.col("c").alias("b")).distinct(), slim, share, need), "star")
    links = materialize(confirm(star, texts, k, share), "links")
    part = materialize(parts(links, slim), "parts")

    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = shared.select("c", "keys").join(part, "c").select("c", "n", "part", F.explode("keys").alias("k")).select("c", "n", "part", "k.key", "k.size")
    ends = now.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.max("size").alias("size")).where("lo <> hi")
    # A key of two classes was settled when these were compared, or were too unlike to be.
    left = materialize(now.drop("size").join(ends.where("size > 2").select("key", "size"), "key"), "left")
    few = named(meeting(left.where(F.col("size") <= FEW).drop("size"), ["key"]).where(similar_sizes("a_n", "b_n", share)))
    many = left.where(F.col("size") > FEW).drop("size").join(centre.withColumnRenamed("a", "centre"), "key")
    seen = materialize(beside(many.where("c <> centre").select(F.col("centre").alias("a"), F.col("c").alias("b")).distinct(), texts, k), "seen")
    # Their sets are compared already: links that too few equal minhashes had hidden.
    near = seen.withColumn("size", F.size("outside") + F.size("lacking") + F.col("core")).where(F.col("core") * 100 >= F.col("size") * share)
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(tried, ["a", "b"], "left_anti")
    rows_ = materialize(held(seen, part, share), "held")
    first = materialize(differing(rows_), "first")
    met = materialize(differing_pairs(first, share).join(tried, ["a", "b"], "left_anti"), "met")
    # First the best pair of each class: most of the others then lie in one component.
    best = met.groupBy("far").agg(F.max_by(F.struct("a", "b"), F.struct("more", "a", "b")).alias("x")).select("x.*")
    some_ = materialize(agreeing(few.join(tried, ["a", "b"], "left_anti"), slim, share, need), "few")
    one = materialize(confirm(some_.select("a", "b").union(best).distinct(), texts, k, share).union(near), "one")
    new = materialize(moved(one, part), "moved")
    root = lambda p: F.coalesce(f"{p}_", p)
    rest = met.join(new.toDF("pa", "pa_"), "pa", "left").join(new.toDF("pb", "pb_"), "pb", "left").where(root("pa") != root("pb"))
    rest = materialize(rest.select("a", "b").join(best, ["a", "b"], "left_anti"), "rest")
    two = materialize(confirm(rest, texts, k, share), "two")
    more = one.union(two)
    done = part if more.isEmpty() else materialize(parts(links.union(more), slim), "parts")
    forget(shared, texts, star, left, seen, rows_, first, met, some_, new, rest)
    return sigs, classes, done


def moved(links: DataFrame, part: DataFrame) -> DataFrame:
    """(part, new): components that the links join, and the least of theirs."""
    at = lambda x, p: part.select(F.col("c").alias(x), F.col("part").alias(p))
    met = links.join(at("a", "src"), "a").join(at("b", "dst"), "b").where("src <> dst").select("src", "dst").distinct()
    return components(met).select(F.col("id").alias("part"), F.col("component").alias("new"))


def parts(links: DataFrame, slim: DataFrame) -> DataFrame:
    """(c, n, part) of every class."""
    of = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("c"), F.col("component").alias("part"))
    return slim.select("c", "n").join(of, "c", "left").select("c", "n", F.coalesce("part", "c").alias("part"))


def judged(docs: DataFrame, k: int = 5, share: int = 80, half: int = 12, rows: int = 2, spans: int = 3, need: int = 26) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, kept) for every document with a doc_id; h is its ``text_key``."""
    sigs, classes, part = linked(docs, k, share, half, rows, spans, need)
    of = classes.select("c", "s1", "s2", F.col("n").alias("n_"), "doc_id").join(part.select("c", "part"), "c")
    least = of.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    of = of.join(least, "part").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), "n_", "component_id")
    one = sigs.join(of, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n") == F.col("n_")), "left")
    out = one.select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    empty = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return judged(docs, **how).drop("h").union(empty)


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One document of each group; same columns.  Documents without a doc_id stay."""
    name, d, h = fresh(docs, "key", "doc", "of")
    kept = judged(docs.select("doc_id", "text"), **how).where("kept").select(F.col("doc_id").alias(d), F.col("h").alias(h))
    met = docs.where("doc_id is not null").withColumn(name, text_key())
    return met.join(kept, (F.col("doc_id") == F.col(d)) & (F.col(name) == F.col(h)), "left_semi").drop(name).union(docs.where("doc_id is null"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
