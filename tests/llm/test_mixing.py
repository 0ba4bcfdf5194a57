import pytest

from cohortlake.llm import mixing

from .cases import DOCS, documents, saved


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * sizes[s]]
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)


def check(rows, near):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check(rows, 200)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    texts = [None, "", "a b c", "a b c", "x " * 30000, " lead and trail \t", "one", None, "q w e"]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id = 2"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 10
    check(rows, 200)
    assert [r["size"] for r in rows if r.doc_id == 5] == [3]
    assert mixing.op8_mix(spark, saved(spark, tmp_path, texts)).count() == 9
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_blocks_hold_the_words_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    blocks = mixing.mixed_blocks(docs, block=32)
    assert blocks.selectExpr("sum(size(words))").first()[0] == mixing.mix(docs, block=32).selectExpr("sum(taken)").first()[0]
    assert blocks.selectExpr("max(size(words))").first()[0] <= 32


def test_every_block_once_per_epoch(spark):
    assert all(p > 1 and all(p % d for d in range(2, int(p**0.5) + 1)) for p in mixing.PRIMES)
    for n in (1, 37, 370, 3700):
        rows = spark.range(20 * n).selectExpr(f"id % {n} AS i", f"id div {n} AS epoch", f"CAST({n} AS long) AS n", "'ssrc' AS sid")
        block = mixing.permuted(rows.i, rows.epoch, rows.n, rows.sid, "mix")
        got = rows.select("epoch", block.alias("block")).distinct().groupBy("epoch").count()
        assert [r["count"] for r in got.collect()] == [n] * 20


def test_taken_is_what_the_blocks_hold(spark):
    """Each document's words are its own, so the words of the drawn blocks tell how often each was taken."""
    docs = documents(spark, [" ".join(f"d{i}" for _ in range(3 + i % 40)) for i in range(120)])
    got = {r.doc_id: r.taken for r in mixing.mix(docs, block=16, shard=32, buckets=7).collect()}
    words = mixing.mixed_blocks(docs, block=16, shard=32, buckets=7).selectExpr("explode(words) AS w").groupBy("w").count().collect()
    assert {i: n for i, n in got.items() if n} == {int(r.w[1:]): r["count"] for r in words}


def test_equal_rows_and_clashing_names(spark):
    rows = [(None, "same text here", "a", 1, "x", 2), (None, "same text here", "a", 1, "x", 2), (4, "other", None, 3, "y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, id long, row string, taken long")
    got = mixing.mix(docs, block=2)
    assert got.columns == ["doc_id", "text", "source", "id", "row", "size", "source_size", "target", "taken"]
    assert sorted((r["size"], r.id, r.row) for r in got.collect()) == [(1, 3, "y"), (3, 1, "x"), (3, 1, "x")]
