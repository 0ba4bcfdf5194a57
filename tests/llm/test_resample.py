import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from cohortlake.llm import resample

from ..oracle import compare, connect
from .cases import documents, rows_of, saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(text, longest=1):
    ws = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return ws, [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10000 for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]


def brute(docs, target, percent=10, min_words=20, longest=1):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text, longest)[1])
    for text in target:
        t.update(features(text, longest)[1])
    S, T = s.total(), t.total()
    out = {}
    for i, text in docs:
        ws, f = features(text, longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(ws), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    order = sorted((-r[3], i) for i, r in out.items() if r[0] >= min_words)
    for rank, (_, i) in enumerate(order[: percent * len(order) // 100]):
        out[i][4] = rank + 1
    return out


def corpus(n):
    rng = random.Random(n)
    texts = [None, "", "---", "Ünï çödé " * 30, "AbC-dEf_0'9 " * 15, "w" * 5000]
    return texts + [" ".join(rng.choice("the of quark lepton cat dog sun moon 7".split()) for _ in range(rng.randrange(5, 60))) for _ in range(n)]


TARGET = ["quark lepton quark", None, "", "Lepton; sun!"]


def test_query_matches_brute_force_and_sql(spark, tmp_path):
    texts = corpus(300)
    sf = saved(spark, tmp_path, texts, benchmark=spark.createDataFrame(list(enumerate(TARGET)), "item_id long, text string"))
    got = rows_of(resample.op13_resample(spark, sf))
    want = brute(list(enumerate(texts)), TARGET)
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: tuple(r[1:]) for i, r in want.items()}


def test_sql_on_the_corpus(spark, sf):
    assert compare(resample.op13_resample(spark, sf), connect(sf), resample.OP13_SQL) is None


def test_longer_features_and_the_drawn_documents(spark):
    docs = documents(spark, corpus(200), extra=True)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resample.resample(docs.withColumn("score", F.lit("x")).withColumn("h", F.lit(1)).withColumn("row", F.lit(2)), target, percent=25, min_words=10, longest=3)
    want = brute(list(enumerate(corpus(200))), TARGET, 25, 10, 3)
    rows = {r.doc_id: (r.n_words, r.n_features, r.weight, r.score) for r in got.collect()}
    assert rows == {i: tuple(r[:4]) for i, r in want.items() if r[4]}
    assert {"h", "row", "key"} <= set(got.columns) and got.columns.count("score") == 1


def test_selection_is_exact_with_ties_and_uneven_partitions(spark):
    rng = random.Random(1)
    for n, spread, parts in ((1, 1, 1), (7, 1, 3), (1000, 3, 5), (3000, 10**9, 7), (2500, 50, 1)):
        rows = [(rng.randrange(spread), i) for i in range(n)]
        rows.sort(key=lambda r: r[0] % 7)  # partitions that differ
        keys = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "score long, tie long")
        order = sorted((-s, i) for s, i in rows)
        for percent in (0, 1, 10, 50, 100):
            cut, place, rounds = resample.cutoff(keys, percent)
            assert place == percent * n // 100
            assert cut == ((-order[place - 1][0], order[place - 1][1]) if place else None)
            assert rounds <= 3 + 2 * math.log(n + 1, 4 / 3)


def test_a_pivot_leaves_at_most_three_quarters():
    rng = random.Random(2)
    for _ in range(50):
        parts = [sorted(rng.randrange(100) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 12))]
        keys = sorted(x for p in parts for x in p)
        pivot = resample.weighted_median([(p[(len(p) - 1) // 2],) for p in parts], [len(p) for p in parts])[0]
        assert sum(x < pivot for x in keys) <= 0.75 * len(keys) and sum(x > pivot for x in keys) <= 0.75 * len(keys)


def test_awkward_rows(spark):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    docs = documents(spark, corpus(40))
    gain = resample.gains(docs, target)
    assert len(gain) == 10000 and resample.gains(docs.limit(0), target.limit(0)) == [0] * 10000
    assert resample.ranked(resample.scored(docs.limit(0), gain)).count() == 0
    assert resample.resample(docs.limit(0), target).count() == 0
    twice = docs.unionAll(docs).unionAll(docs.limit(8).withColumn("doc_id", F.lit(None).cast("long")))
    rows = resample.ranked(resample.scored(twice, gain), percent=30).collect()
    able = sum(r.n_words >= 20 for r in rows)
    assert len(rows) == 2 * docs.count() + 8
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 30 * able // 100 + 1))
