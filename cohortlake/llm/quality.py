"""Quality classifier: Naive Bayes support vectors on hashed byte n-grams.

Indicators of a text's byte 2-grams and 4-grams are scaled by the log-count ratios of the two
classes, counted over all labelled training rows; a linear hinge-loss model is then fitted to
them by dual coordinate descent on a bounded sample (``sample`` rows a class, those with the
least hash of doc_id, of which as many go to the driver as have ``room`` indicators between
them), and its margins are calibrated on held-out halves of that sample.

Nulls and empties: a null text counts as empty and gets the score of no indicators; a null
doc_id has no label and is scored; rows with null labels are no training rows; repeated label
rows count once (the larger label); documents that repeat a doc_id all train under its label.
With one class only, the score is that class's; without training rows it is the one of
class 0.  Input columns named like the added ones give way to them; the filter keeps all.
"""

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, table, without

PAIRS, HASHED = 1 << 16, 1 << 18
DIMS = PAIRS + HASHED
CHUNK = 1 << 13


class Indicators:
    """Distinct feature numbers of one text, in time linear in its length."""

    def __init__(self):
        self.stamp = np.zeros(DIMS, np.int64)

    def __call__(self, text) -> np.ndarray:
        d = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        if len(d) < 2:
            return np.zeros(0, np.int64)
        two = (d[:-1] << 8) | d[1:]
        four = (((two[:-2] << 16) | two[2:]) * np.uint32(2654435761)) >> np.uint32(14) if len(d) >= 4 else two[:0]
        ids = np.concatenate([two, four + np.uint32(PAIRS)]).astype(np.int64)
        at = np.arange(len(ids))
        self.stamp[ids] = at
        return ids[self.stamp[ids] == at]


def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labelled rows -> counts of this task by class and stretch of features, and the sample's rows."""
    find, counts, rows = Indicators(), np.zeros((2, DIMS), np.int64), np.zeros(2, np.int64)
    for b in batches:
        kept = []
        for text, y, s, h in zip(b.text, b.y, b.chosen, b.hash):
            ids = find(text)
            counts[y][ids] += 1
            rows[y] += 1
            if s:
                kept.append(("row", h, int(y), ids.astype(np.int32).tobytes()))
        if kept:
            yield pd.DataFrame(kept, columns=["kind", "part", "y", "data"])
    out = [("size", 0, y, rows[y : y + 1].tobytes()) for y in (0, 1)]
    for y in (0, 1):
        for k in range(0, DIMS, CHUNK):
            if counts[y, k : k + CHUNK].any():
                out.append(("count", k, y, counts[y, k : k + CHUNK].astype(np.int64).tobytes()))
    yield pd.DataFrame(out, columns=["kind", "part", "y", "data"])


def add_up(key, group: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, np.int64) for x in group.data], axis=0)
    return pd.DataFrame([(*key, total.tobytes())], columns=["kind", "part", "y", "data"])


def dual_descent(rows: list[np.ndarray], ys: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Squared-hinge linear model by dual coordinate descent; the last weight is the bias."""
    w, alpha = np.zeros(len(ratio) + 1), np.zeros(len(rows))
    xs = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    norms = np.array([x @ x for x in xs]) + 1.0 + 0.5 / cost
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = ys[i] * (w[rows[i]] @ xs[i] + w[-1]) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - g / norms[i], 0.0)
            if (step := new - alpha[i]) != 0:
                w[rows[i]] += step * ys[i] * xs[i]
                w[-1] += step * ys[i]
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def margins(rows, w, ratio) -> np.ndarray:
    return np.array([w[r] @ ratio[r] / np.sqrt(max(1, len(r))) + w[-1] for r in rows])


def sigmoid_fit(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted one-variable logistic fit by Newton steps, with a small pull of the slope to 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        e, v = weight * (p - y), weight * p * (1 - p) + 1e-9
        g = np.array([e @ m + 0.01 * (a - 1), e.sum() + 0.01 * b])
        h = np.array([[v @ (m * m) + 0.01, v @ m], [v @ m, v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train_rows(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % folds != held)
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def sampled(train: DataFrame, sample: int) -> DataFrame:
    """(doc_id, y): ``sample`` rows a class, least hash of doc_id first; small enough to broadcast."""
    pick = lambda y: train.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return pick(0).union(pick(1)).select("doc_id", "y")


def labelled(docs: DataFrame, train: DataFrame) -> DataFrame:
    """The documents of the training rows; a merge join whatever the tables' sizes, as labels grow with the corpus."""
    return docs.where("doc_id is not null").select("doc_id", "text").join(train.hint("merge"), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, sample: int = 1500, smooth: float = 1.0, room: int = 1 << 25) -> dict:
    """-> weights of all features, bias, slope and offset of the calibration."""
    train = train_rows(labels, label, folds, held)
    chosen = sampled(train, sample).select("doc_id", F.lit(True).alias("chosen"))
    train = train.join(F.broadcast(chosen), "doc_id", "left").fillna(False, ["chosen"])
    texts = labelled(docs, train).select("text", "y", "chosen", F.xxhash64("doc_id", "text").alias("hash"))
    seen = materialize(texts.mapInPandas(gather, "kind string, part long, y int, data binary"), "ngrams")
    counts, total = np.zeros((2, DIMS)), np.zeros(2)
    for r in seen.where("kind <> 'row'").groupBy("kind", "part", "y").applyInPandas(add_up, seen.schema).collect():
        data = np.frombuffer(r.data, np.int64)
        if r.kind == "size":
            total[r.y] = data[0]
        else:
            counts[r.y, r.part : r.part + len(data)] = data
    # A row's indicators are known by their number first, so that very long texts don't fill the driver.
    picked = seen.where("kind = 'row'").dropDuplicates(["y", "part"])
    slim = picked.select("part", "y", (F.length("data") / 4).cast("long").alias("n"))
    sizes = reduce(DataFrame.union, (slim.where(F.col("y") == y).orderBy("part").limit(sample) for y in (0, 1)))
    fits = sizes.withColumn("upto", F.sum("n").over(Window.partitionBy("y").orderBy("part", "n").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= room // 2)
    most = {r.y: r.part for r in fits.groupBy("y").agg(F.max("part").alias("part")).collect()}
    within = [(F.col("y") == y) & (F.col("part") <= part) for y, part in most.items()]
    rows = picked.where(reduce(or_, within, F.lit(False))).select("y", "data").collect()
    rows = sorted(rows, key=lambda r: (r.y, bytes(r.data)))
    if not total.all() or len(most) < 2:
        return {"w": np.zeros(DIMS, np.float32), "bias": float(total[1] > 0) * 2 - 1.0, "slope": 3.0, "offset": 0.0}
    p, q = counts[1] + smooth, counts[0] + smooth
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    xs, ys = [np.frombuffer(r.data, np.int32) for r in rows], np.array([2.0 * r.y - 1 for r in rows])
    half, m = np.arange(len(xs)) % 2, np.zeros(len(xs))
    for k in (0, 1):
        own, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
        m[other] = margins([xs[i] for i in other], dual_descent([xs[i] for i in own], ys[own], ratio), ratio)
    weight = np.where(ys > 0, total[1] / max(1, (ys > 0).sum()), total[0] / max(1, (ys < 0).sum()))
    slope, offset = sigmoid_fit(m, (ys + 1) / 2, weight / weight.mean())
    w = dual_descent(xs, ys, ratio)
    return {"w": (w[:-1] * ratio).astype(np.float32), "bias": float(w[-1]), "slope": slope, "offset": offset}


def scorer(docs: DataFrame, model: dict):
    """The score of column ``text``, 0 to 1."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights, whatever the corpus

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, find = known.value, Indicators()
        for texts in batches:
            out = np.empty(len(texts))
            for i, t in enumerate(texts):
                ids = find(t)
                out[i] = m["w"][ids].sum(dtype=np.float64) / np.sqrt(max(1, len(ids))) + m["bias"]
            yield pd.Series(1 / (1 + np.exp(-np.clip(m["slope"] * out + m["offset"], -30, 30))))

    return scored("text")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``."""
    return without(docs, "score", "predicted").withColumn("score", scorer(docs, model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Documents that the model doesn't reject; same columns."""
    (name,) = fresh(docs, "score")
    return docs.withColumn(name, scorer(docs, fit(docs, labels, **how))).where(F.col(name) >= 0.5).drop(name)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
