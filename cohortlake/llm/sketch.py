"""A merged count sketch of hashes: which hashes can have been seen twice.

Each partition sends, for each of ``depth`` rows, the distinct buckets that it has hit, with
how often it hit each; partitions' sketches are merged bucket by bucket.  A bucket
whose merged count reaches two is kept as one bit.  Counts are never too low, so a hash whose
buckets aren't all set occurs once.  The width follows the input (``fitting``) up to a bound:
the merged bits that executors get take ``depth * 2**width / 8`` bytes.  Where the bound is far
too narrow for a corpus the filter passes more, and nothing is lost.
"""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 20  # bits of the bucket number inside a chunk
SCHEMA = "part int, ids binary, times binary"


def buckets(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """Bucket numbers of 64-bit hashes in a row of the sketch."""
    if row:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * row)
    return (h >> np.uint64(64 - width)).astype(np.int64)


def fitting(docs: DataFrame, per_byte: float, most: int, room: float = 1.0) -> int:
    """Bits of the bucket number for all hashes of the texts, ``per_byte`` for each of their bytes, but ``most``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(most, max(CHUNK, np.ceil(np.log2(max(2.0, room * per_byte * float(size)))))))


class Partial:
    """This task's sketch: sorted distinct buckets, and which of them more than once."""

    def __init__(self, width: int, depth: int, limit: int = 2_000_000):
        self.width, self.depth, self.limit, self.held, self.n = width, depth, limit, [], 0

    def add(self, h: np.ndarray):
        self.held.append(h)
        self.n += len(h)
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        h, self.held, self.n = np.concatenate(self.held), [], 0
        rows = []
        for r in range(self.depth):
            b = np.sort(buckets(h, r, self.width))
            new = np.r_[True, b[1:] != b[:-1]]
            ids = b[new]
            times = np.minimum(65535, np.diff(np.r_[np.flatnonzero(new), len(b)])).astype("<u2")
            cut = np.flatnonzero(np.r_[True, (ids[1:] >> CHUNK) != (ids[:-1] >> CHUNK)])
            for a, z in zip(cut, np.r_[cut[1:], len(ids)]):
                chunk = int(ids[a] >> CHUNK)
                gaps = np.diff(ids[a:z] & ((1 << CHUNK) - 1), prepend=0).astype(np.uint32)
                # Low bytes and high bytes apart: the high ones are mostly zero.
                planes = gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                rows.append((r << 16 | chunk, zlib.compress(planes, 1), zlib.compress(times[a:z].tobytes(), 1)))
        yield pd.DataFrame(rows, columns=["part", "ids", "times"])


def merged(partials: DataFrame, width: int, depth: int, hot: int = 0):
    """-> a broadcast of {part: (bits of counts from 2, bits of counts from ``hot``)}; width and depth bound its size."""

    def merge(key, group: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(1 << CHUNK, np.int64)
        for ids, times in zip(group.ids, group.times):
            planes = np.frombuffer(zlib.decompress(ids), np.uint8).reshape(4, -1)
            b = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))
            count[b] += np.frombuffer(zlib.decompress(times), "<u2")
        pack = lambda x: zlib.compress(np.packbits(x).tobytes(), 1)
        return pd.DataFrame([(key[0], pack(count >= 2), pack(count >= hot) if hot and count.max() >= hot else None, count[count >= 2].sum())], columns=["part", "bits", "hot", "seen"])

    got = partials.groupBy("part").applyInPandas(merge, "part int, bits binary, hot binary, seen long").collect()
    return partials.sparkSession.sparkContext.broadcast({r.part: {"bits": bytes(r.bits), "hot": bytes(r.hot or b""), "seen": r.seen} for r in got})


def passing(parts: dict, depth: int) -> int:
    """How many hashes the merged sketch can let pass, repeats counted (a task's counts end at 65,535 a bucket)."""
    return min(sum(x["seen"] for part, x in parts.items() if part >> 16 == r) for r in range(depth)) if parts else 0


def ranges(parts: dict, depth: int, each: int, least: int) -> int:
    """Into how many ranges to deal what passes, so that one holds about ``each`` hashes."""
    return max(least, -(-passing(parts, depth) // each))


class Filter:
    """Tells which hashes the merged sketch lets pass."""

    def __init__(self, parts: dict, width: int, depth: int, kind: str = "bits"):
        self.width, self.depth = width, depth
        parts = {k: x[kind] for k, x in parts.items() if x[kind]}
        if kind == "hot" and not parts:
            self.depth = 0
            self.none = True
            return
        self.none = False
        self.bits = np.zeros((depth, max(1, (1 << width) >> 3)), np.uint8)
        size = (1 << CHUNK) >> 3
        for part, packed in parts.items():
            r, c = part >> 16, part & 0xFFFF
            data = np.frombuffer(zlib.decompress(packed), np.uint8)
            self.bits[r, c * size : c * size + len(data)] = data[: max(1, (1 << self.width) >> 3)]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.none:
            return np.zeros(len(h), bool)
        out = np.ones(len(h), bool)
        for r in range(self.depth):
            b = buckets(h, r, self.width)
            out &= (self.bits[r][b >> 3] >> (7 - (b & 7)).astype(np.uint8) & 1) > 0
        return out
