"""Shared pieces: tables, shared folder, word expressions, byte hashing."""

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space bytes of the word contract, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is named, a session of one machine gets a temporary one; a cluster is an error.
    """
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    named = sc.getConf().get("spark.checkpoint.dir") or (jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cohortlake-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write to the shared folder and reread: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its columns of these names: added columns replace them."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in names}))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def words(c):
    """Words of a text column, without regular expressions per word."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def word_count(c):
    """Number of words; null and empty texts have none."""
    return F.size(words(c)).cast("long")


# --- polynomial hashing of byte strings, 64 bit with wrap-around -----------------------

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of byte intervals in O(1) each, after one pass over the bytes."""

    def __init__(self, seed: int = 1, room: int = 1 << 16):
        self.table = byte_table(seed)
        self.room = 0
        self.grow(room)

    def grow(self, n: int) -> None:
        if n > self.room:
            self.room = max(n, 2 * self.room)
            self.pow, self.inv = powers(_MULT, self.room), powers(_INV, self.room)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.pow[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start, end) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.inv[start])


def word_spans(raw: bytes):
    """Words joined by one space, with each word's start and end in the joined bytes."""
    ws = raw.split()
    n = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(n + 1) - 1
    return ws, b" ".join(ws), ends - n, ends


def planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers, place by place: equal high bytes lie together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
