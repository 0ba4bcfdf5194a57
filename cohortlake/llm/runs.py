"""Periodic run detection: seed-and-extend along diagonals, one document at a time.

A run is a stretch of words with smallest period q and length at least ``max(floor, times * q)``
that no neighbouring word extends.  Words q apart are identical all along it, so its *diagonal*
at lag q holds at least ``max(floor, times * q) - q`` words in a row: the guaranteed overlap.
Lags are taken in bands.  For each band the k-grams of the band's least guaranteed overlap are
indexed, every position is paired with the next one of the same k-gram, and a pair whose lag lies
in the band is extended both ways, unless the furthest-covered table of its lag has passed it.

Pairs of neighbouring occurrences are enough, so there are at most n in a band: were there an
occurrence between two that are q apart, the k-gram would have two periods whose sum its length
covers (a band ends at two thirds of k for that), hence a common divisor as period, and q would not
be the smallest.  For the same reason a lag so found is the smallest period of its stretch.
k-grams are named exactly, by pairs of the names of shorter ones; grams that occur once in the
document are dropped, with all longer ones over them.

Nulls and empties: a null text has no runs and stays null, an empty one or one without words
becomes empty; repeated rows each get their own result; a document of any length is handled whole.
Input columns named like the added ones give way to them, others pass through.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without, words

FLOOR, TIMES = 24, 3


def bands(n: int, floor: int = FLOOR, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """(lowest lag, highest lag, k): all lags that a run of at most n words can have."""
    if times < 3:
        raise ValueError("a run repeats its period three times or more")
    low = 1
    while max(floor, times * low) <= n:
        turn = max(low, floor // times)
        k = min(max(floor, times * q) - q for q in (low, turn, turn + 1) if q >= low)
        high = 2 * k // 3
        yield low, high, k
        low = high + 1


def paired(name: np.ndarray, by: int) -> np.ndarray:
    """Names of the grams made of a named gram and the one ``by`` further on; -1 for those that occur once."""
    out = np.full(max(0, len(name) - by), -1, np.int64)
    at = np.flatnonzero((name[: len(out)] >= 0) & (name[by:] >= 0))
    if len(at):
        key = name[at] * (name.max() + 1) + name[at + by]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        out[at] = np.where(count[inverse] > 1, inverse, -1)
    return out


def alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of a and b agree."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        end = min(n, done + step)
        differ = a[done:end] != b[done:end]
        if differ.any():
            return done + int(differ.argmax())
        done, step = end, 2 * step
    return n


def find_runs(ids: np.ndarray, floor: int = FLOOR, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of word numbers, by start, then period."""
    found, name, size = [], ids, 1
    for low, high, k in bands(len(ids), floor, times):
        while 2 * size <= k:
            name, size = paired(name, size), 2 * size
        grams = paired(name, k - size) if k > size else name
        at = np.flatnonzero(grams >= 0)
        if not len(at):
            if not (name >= 0).any():
                break  # nothing of this size comes twice, so nothing longer does
            continue
        at = at[np.argsort(grams[at], kind="stable")]
        lag = np.diff(at)
        seed = (np.diff(grams[at]) == 0) & (lag >= low) & (lag <= high)
        pos, lag = at[:-1][seed], lag[seed]
        order = np.lexsort((pos, lag))
        pos, lag = pos[order], lag[order]
        first = np.ones(len(pos), bool)  # of seeds one word apart on a diagonal only the first extends
        first[1:] = (np.diff(lag) != 0) | (np.diff(pos) != 1)
        covered = {}
        for i, d in zip(pos[first].tolist(), lag[first].tolist()):
            if i < covered.get(d, 0):
                continue
            start = i - alike(ids[:i][::-1], ids[: i + d][::-1])
            end = i + alike(ids[i:], ids[i + d :])
            covered[d] = end
            if end - start + d >= max(floor, times * d):
                found.append((start, end - start + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def collapse(text: str, floor: int = FLOOR, times: int = TIMES) -> tuple[list[tuple[int, int, int]], str]:
    """The runs of a text and its words without the repeats, joined by one space."""
    ws = text.encode().split()
    seen = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in ws), np.int64, len(ws))
    runs = find_runs(ids, floor, times)
    if runs:
        ws = [w for w, keep in zip(ws, kept_words(len(ws), runs).tolist()) if keep]
    return runs, b" ".join(ws).decode()


def collapse_runs(docs: DataFrame, floor: int = FLOOR, times: int = TIMES) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period by start, then period) and the ``collapsed`` text."""

    @F.pandas_udf("struct<start:array<long>,length:array<long>,period:array<long>,collapsed:string>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            rows = []
            for t in s:
                runs, kept = collapse(t or "", floor, times)
                rows.append((*([r[k] for r in runs] for k in range(3)), None if t is None else kept))
            yield pd.DataFrame(rows, columns=["start", "length", "period", "collapsed"])

    list(bands(0, floor, times))
    docs = without(docs, "runs", "collapsed")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), found("text").alias("found"))
    return held.select(*(F.col(f"row.`{c}`") for c in docs.columns), F.arrays_zip("found.start", "found.length", "found.period").alias("runs"), F.col("found.collapsed").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared as whole numbers; ties: the first in order."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the contract's repeats put into one document in ten."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.col("g") % F.nullif("n", F.lit(0))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = lambda x, i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("w", again), " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = collapse_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return docs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )
