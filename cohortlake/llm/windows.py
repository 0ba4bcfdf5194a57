"""Substring dedup on word windows: count-min prefilter, then exact grouping.

Pass 1 merges the partitions' sketches of all windows of ``n`` words (``sketch``).  Pass 2
groups, exactly, only the windows that the sketch estimates repeated: equal windows (80-bit
hashes of their words) are told the least doc_id that holds one, and the words that a later
document's window covers are removed.

Nulls and empties: a null text has no words; a null doc_id matches nothing and keeps all its
words; rows that repeat a doc_id count as one document and lose the same word positions.
Input columns named like the added ones give way to them.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .common import Hasher, fresh, partitions, planes, table, unplanes, without, word_spans


def window_hashes(hasher: Hasher, raw: bytes, n: int) -> np.ndarray:
    """A hash of every window of n words, in order."""
    _, joined, start, end = word_spans(raw)
    if len(start) < n:
        return np.zeros(0, np.uint64)
    p = hasher.prefix(np.frombuffer(joined, np.uint8))
    s, e = start[: len(start) - n + 1], end[n - 1 :]
    return hasher.spans(p, s, e)


class Windows:
    def __init__(self, n: int):
        self.n, self.one, self.two = n, Hasher(1), Hasher(2)

    def first(self, text) -> np.ndarray:
        return window_hashes(self.one, (text or "").encode(), self.n)

    def second(self, text) -> np.ndarray:
        return (window_hashes(self.two, (text or "").encode(), self.n) >> np.uint64(48)).astype("<u2")


def partials(docs: DataFrame, n: int, width: int, depth: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, part = Windows(n), sketch.Partial(width, depth)
        for b in batches:
            for t in b.text:
                yield from part.add(own.first(t))
        yield from part.flush()

    return docs.select("text").mapInPandas(run, sketch.SCHEMA)


def settle(h, g, d, p):
    """Of one task's windows: (those still open, those that a smaller doc_id in this task has)."""
    order = np.lexsort((d, g, h))
    h, g, d, p = h[order], g[order], d[order], p[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    known = d > least
    return (h[~known], g[~known], d[~known], p[~known]), (d[known], p[known])


def pack_open(h, g, d, p) -> bytes:
    """Windows sorted by hash: gaps of the hashes, and the rest, by byte planes."""
    gaps = np.diff(h, prepend=np.uint64(0))
    body = planes(gaps) + planes(g) + planes(d.astype("<i8")) + planes(p.astype("<i4"))
    return zlib.compress(body, 1)


def unpack_open(packed: bytes):
    raw = zlib.decompress(packed)
    n = len(raw) // 22
    cuts = np.cumsum([0, 8 * n, 2 * n, 8 * n, 4 * n])
    h, g, d, p = (unplanes(raw[a:z], k) for a, z, k in zip(cuts, cuts[1:], ("<u8", "<u2", "<i8", "<i4")))
    return np.cumsum(h, dtype=np.uint64), g, d, p


def known_rows(d: np.ndarray, p: np.ndarray) -> list[tuple[int, bytes]]:
    """Settled positions, one row a document: as many rows as there are positions at most."""
    if not len(d):
        return []
    order = np.lexsort((p, d))
    d, p = d[order], p[order].astype("<i4")
    cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    return [(int(d[a]), p[a:z].tobytes()) for a, z in zip(cut, np.r_[cut[1:], len(d)])]


def estimated(docs: DataFrame, n: int, passed, width: int, depth: int, ranges: int, unit: int = 500_000) -> DataFrame:
    """Windows that the sketch lets pass, packed by ranges of their hash, and settled positions.

    Of the windows that a task has read several times, only its least doc_id is sent on; the
    rest are settled on the spot.  A window in a third of all documents is one entry a unit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, keep = Windows(n), sketch.Filter(passed.value, width, depth)
        out, size = [], 0
        for b in batches:
            for d, t in zip(b.doc_id, b.text):
                h = own.first(t)
                at = np.flatnonzero(keep(h))
                if len(at):
                    out.append((h[at], own.second(t)[at], np.full(len(at), d, np.int64), at.astype(np.int32)))
                    size += len(at)
                if size > unit:
                    yield frame(out)
                    out, size = [], 0
        if out:
            yield frame(out)

    def frame(parts):
        (h, g, d, p), known = settle(*(np.concatenate(x) for x in zip(*parts)))
        part = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        rows = [(int(part[a]), None, pack_open(h[a:z], g[a:z], d[a:z], p[a:z])) for a, z in zip(cut, np.r_[cut[1:], len(part)])]
        # Settled rows go through the same shuffle, dealt out by their document.
        rows += [(-1 - d % ranges, d, at) for d, at in known_rows(*known)]
        return pd.DataFrame(rows, columns=["part", "doc_id", "packed"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "part int, doc_id long, packed binary")


def repeated_positions(docs: DataFrame, n: int, width: int, depth: int, each: int = 1_000_000) -> DataFrame:
    """(doc_id, known): starts of windows that also start in a document with a smaller doc_id.

    The number of ranges follows the windows that pass: one holds about ``each`` of them, at any input size.
    """
    some = docs.where("doc_id is not null")
    passed = sketch.merged(partials(some, n, width, depth), width, depth)
    rows = estimated(some, n, passed, width, depth, sketch.ranges(passed.value, depth, each, 2 * partitions(docs.sparkSession)))

    def group(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """All windows of a range of hashes, grouped exactly; settled positions pass.  A row a position."""
        if key[0] < 0:
            at = [np.frombuffer(x, "<i4") for x in pdf.packed]
            return pd.DataFrame({"doc_id": np.repeat(pdf.doc_id.to_numpy(np.int64), [len(x) for x in at]), "start": np.concatenate(at)})
        _, (d, p) = settle(*(np.concatenate(x) for x in zip(*map(unpack_open, pdf.packed))))
        order = np.lexsort((p, d))
        return pd.DataFrame({"doc_id": d[order], "start": p[order]})

    return rows.groupBy("part").applyInPandas(group, "doc_id long, start int").groupBy("doc_id").agg(F.collect_list("start").alias("known"))


def removed(at, n: int, words: int) -> np.ndarray:
    cover = np.zeros(words + 1, np.int64)
    at = at[at + n <= words]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    return np.cumsum(cover[:-1]) > 0


def dedup(docs: DataFrame, n: int = 13, width: int | None = None, depth: int = 2) -> DataFrame:
    """``docs`` with n_words, n_removed and ``kept``, the words that stay, joined by a space.

    The sketch's width follows the bytes of the texts unless it is given: about one window to
    seven bytes, and two buckets for each.
    """
    width = sketch.fitting(docs, 0.3, 28) if width is None else width
    at = repeated_positions(docs.select("doc_id", "text"), n, width, depth)
    doc, known, done = fresh(docs, "doc", "known", "done")
    at = at.withColumnsRenamed({"doc_id": doc, "known": known})

    @F.pandas_udf("struct<n_words:long,n_removed:long,kept:string>")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, known in parts:
            rows = []
            for t, k in zip(texts, known):
                ws = (t or "").encode().split()
                starts = np.asarray(k, np.int64) if k is not None else np.zeros(0, np.int64)
                gone = removed(starts, n, len(ws))
                rows.append((len(ws), int(gone.sum()), b" ".join(w for w, g in zip(ws, gone.tolist()) if not g).decode()))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    out = docs.join(at, F.col("doc_id") == F.col(doc), "left").withColumn(done, cut("text", known)).drop(doc, known)
    new = ("n_words", "n_removed", "kept")
    return without(out, *new).withColumns({c: F.col(f"{done}.{c}") for c in new}).drop(done)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
