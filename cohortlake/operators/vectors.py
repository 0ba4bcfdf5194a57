"""A vector index for approximate nearest neighbours: cells around centres, probed nearest first.

The centres are fitted on a bounded sample of the rows (``SAMPLE``, by least hash of the key), every
row is filed under its nearest centre, and the index is written once.  A search compares each query
with the rows of its nearest cells only, and ranks those by exact cosine.  How many cells that takes
is read off the data: the fewest at which held-out rows of the sample find the wanted share of their
true neighbours there.  Vectors without structure need many cells, clustered ones few.

A cell of many rows, or one that many queries probe, is dealt out in blocks of ``BLOCK`` rows, so no
task gets more than two blocks, and a row is sent on once for each block of queries in its own cell.

Rows without a vector are left out; a zero vector has similarity 0 with all; repeated keys are rows
of their own.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.prims import l2, materialize

from .graph import BLOCK, block_best, placed

#: Rows that centres and the number of probed cells are fitted on, at most.
SAMPLE = 20_000


@dataclass
class VectorIndex:
    """rows: (r, v, cell); sizes: rows of each cell; probes: cells that a search visits."""

    rows: DataFrame
    centres: np.ndarray
    sizes: list[int]
    probes: int


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


def fit_centres(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means; an empty cell keeps its centre."""
    c = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        full = np.bincount(at, minlength=cells) > 0
        c[full] = unit(total[full])
    return c


def probes_for(held: np.ndarray, rest: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells at which the held-out rows find ``recall`` of their k nearest among ``rest``."""
    near = np.argsort(-(held @ rest.T), axis=1)[:, :k]
    order = np.argsort(-(held @ centres.T), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
    cell = (rest @ centres.T).argmax(1)
    found = np.sort(np.take_along_axis(rank, cell[near], axis=1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1


def nearest_cells(centres: np.ndarray, probes: int):
    """The cells of a vector, nearest first."""

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        s = np.stack(v)[:, : centres.shape[1]] @ centres.T  # an empty index has a centre of no width
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return cells


def build_index(ref: DataFrame, key: str, vector: str, k: int = 10, recall: float = 0.95, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Fits, files and writes an index over all rows with a vector."""
    rows = ref.where(F.col(vector).isNotNull()).select(F.col(key).alias("r"), l2(vector).alias("v"))
    n = rows.count()
    got = rows.orderBy(F.xxhash64("r"), "r").limit(sample).collect()
    if not got:
        return VectorIndex(materialize(rows.withColumn("cell", F.lit(0))), np.zeros((1, 0)), [0], 1)
    x = np.array([g.v for g in got])
    held, rest = (x[: min(500, len(x) // 4)], x[min(500, len(x) // 4) :]) if len(x) >= 8 else (x, x)
    cells = max(1, min(int(np.sqrt(n)), len(rest) // 16)) if cells is None else min(cells, len(rest))
    centres = fit_centres(rest, cells)
    probes = probes_for(held, rest, centres, k, recall)
    filed = materialize(rows.withColumn("cell", nearest_cells(centres, 1)("v")[0]))
    # One number a cell, of which there are SAMPLE / 16 at most.
    count = {r["cell"]: r["count"] for r in filed.groupBy("cell").count().collect()}
    return VectorIndex(filed, centres, [count.get(c, 0) for c in range(cells)], probes)


def blocks(sizes: list[int]) -> Column:
    """Blocks of the cell in column ``cell``."""
    return F.get(F.lit([max(1, -(-n // BLOCK)) for n in sizes]), F.col("cell"))


def search(index: VectorIndex, query: DataFrame, key: str, vector: str, k: int, same: bool = False) -> DataFrame:
    """Approximate cosine top k: (key, neighbour, similarity, place), similarities exact, ties by neighbour.

    ``same``: a row may be its own neighbour.
    """
    q = query.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), l2(vector).alias("v"))
    q = materialize(q.withColumn("cell", F.explode(nearest_cells(index.centres, index.probes)("v"))))
    visits = {r["cell"]: r["count"] for r in q.groupBy("cell").count().collect()}
    asked = [visits.get(c, 0) for c in range(len(index.sizes))]
    part, every = lambda c, n: F.pmod(F.xxhash64(c), n), lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine, theirs = blocks(asked), blocks(index.sizes)
    left = q.withColumn("_a", part("q", mine).cast("int")).withColumn("_b", every(theirs))
    live = F.get(F.lit([n > 0 for n in asked]), F.col("cell"))
    right = index.rows.where(live).withColumn("_b", part("r", theirs).cast("int")).withColumn("_a", every(mine))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return block_best(a, b, k, same)

    kind = query.schema[key].dataType.simpleString()
    best = left.groupBy("cell", "_a", "_b").cogroup(right.groupBy("cell", "_a", "_b")).applyInPandas(run, f"q {kind}, r {kind}, similarity double")
    return placed(best, key, k)


def recall_of(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """One row: the queries of ``exact``, and the share of its neighbours that ``found`` has too."""
    hit = exact.join(found.select(key, "neighbour", F.lit(1).alias("_hit")), [key, "neighbour"], "left")
    return hit.agg(F.countDistinct(key).alias("queries"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
