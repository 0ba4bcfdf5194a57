"""The vector index: recall, hot cells, awkward rows."""

import numpy as np
import pytest

from cohortlake.operators import graph as G
from cohortlake.operators import vectors as V


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_all_embeddings(spark, sf, scale):
    e = spark.read.parquet(f"{sf}/../{scale}/embeddings.parquet")
    index = V.build_index(e, "vec_id", "embedding", 10)
    assert index.rows.count() == e.count() == sum(index.sizes)
    found = V.search(index, e, "vec_id", "embedding", 10)
    got = V.recall_of(found, G.knn(e, e, "vec_id", "embedding", 10), "vec_id").collect()[0]
    assert got.queries == e.count() and got.recall >= 0.9


def test_clustered_rows_take_few_cells_and_similarities_are_exact(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 24))
    df = frame(spark, x)
    index = V.build_index(df, "id", "v", 10)
    assert index.probes <= len(index.centres) // 8
    asked = df.where("id % 100 = 0")
    found = V.search(index, asked, "id", "v", 10)
    exact = G.knn(asked, df, "id", "v", 10)
    assert V.recall_of(found, exact, "id").collect()[0].recall >= 0.9
    both = found.join(exact.withColumnRenamed("similarity", "s"), ["id", "neighbour"])
    assert both.where("similarity <> s").count() == 0


def test_a_cell_with_most_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.tile([1.0, 0, 0, 0], (400, 1)) + 1e-3 * rng.normal(size=(400, 4)), rng.normal(size=(200, 4))])
    df = frame(spark, x)
    index = V.build_index(df, "id", "v", 5, recall=1.0)
    assert max(index.sizes) > 50
    found = V.search(index, df, "id", "v", 5)
    assert V.recall_of(found, G.knn(df, df, "id", "v", 5), "id").collect()[0].recall >= 0.98
    assert found.groupBy("id").count().where("count <> 5").count() == 0


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (4, [0.0, 1.0]), (None, [1.0, 1.0])], "id long, v array<double>")
    index = V.build_index(df, "id", "v", 2)
    rows = V.search(index, df.where("id is not null"), "id", "v", 2).collect()
    assert index.rows.count() == 5 and {r.id for r in rows} == {1, 2, 4}
    assert [(r.neighbour, r.similarity) for r in rows if r.id == 1][0] == (4, 1.0)
    empty = df.limit(0)
    assert V.search(V.build_index(empty, "id", "v"), df, "id", "v", 2).count() == 0
    assert V.search(index, empty, "id", "v", 2).count() == 0
