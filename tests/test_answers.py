"""Answers met with candidates: against all pairs, and the rows that meet."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import metrics as E


def brute(answers, candidates):
    out = {}
    for k, a in answers:
        best = min(((-len(set((a or "").split()) & set((c or "").split())), i) for i, c in candidates), default=(0, None))
        if best[0] < 0:
            out[k] = best[1]
    return out


def frames(spark, answers, candidates):
    return spark.createDataFrame(answers, "k long, a string"), spark.createDataFrame(candidates, "c long, t string")


@pytest.mark.parametrize("seed", range(4))
def test_the_best_candidate_is_that_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(rng.choice([6, 40, 200]))]
    word = lambda: vocab[min(int(rng.expovariate(0.2)), len(vocab) - 1)]
    text = lambda n: " ".join(word() for _ in range(rng.randrange(n)))
    answers = [(i, text(25)) for i in range(150)] + [(200, None), (201, ""), (202, "zz"), (203, "all"), (204, "all zz w1")]
    candidates = [(i * 3 % 61, text(12) + (" all" if seed % 2 else "")) for i in range(60)] + [(99, "all" if seed % 2 else None)]
    a, c = frames(spark, answers, candidates)
    got = {r.k: r.c for r in E.best_candidates(a, "k", "a", c, "c", "t").collect()}
    assert got == brute(answers, candidates)
    assert E.best_candidates(a.limit(0), "k", "a", c, "c", "t").count() == 0
    assert E.best_candidates(a, "k", "a", c.limit(0), "c", "t").count() == 0


def test_a_word_in_all_answers_meets_no_more_rows(spark, monkeypatch):
    """Every answer and most candidates hold one word: the rows that meet stay those of the rare words."""
    n = 200
    answers = [(i, f"common r{i} s{i} t{i}") for i in range(n)]
    candidates = [(i, f"common r{i} s{i} x{i}" if i else "r0") for i in range(n)]
    a, c = frames(spark, answers, candidates)
    rows = []
    real = E.materialize
    monkeypatch.setattr(E, "materialize", lambda df: rows.append(df) or real(df))
    got = {r.k: r.c for r in E.best_candidates(a, "k", "a", c, "c", "t").collect()}
    assert got == {i: i for i in range(n)}
    most = 0
    for df in rows:
        if "settled" in df.columns:
            df.collect()
            stack = [df._jdf.queryExecution().executedPlan()]
            while stack:
                p = stack.pop()
                if p.nodeName() == "AdaptiveSparkPlan":
                    stack.append(p.executedPlan())
                    continue
                if p.nodeName().endswith("QueryStage"):
                    stack.append(p.plan())
                if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
                    most = max(most, p.metrics().apply("numOutputRows").value())
                kids = p.children()
                stack += [kids.apply(i) for i in range(kids.size())]
    assert 0 < most <= 4 * n


def test_sets_of_words_are_not_copied_to_pairs(spark, monkeypatch):
    """What meets a candidate is the number of a set; a repeated candidate has the words of all its rows."""
    answers, candidates = [(1, "a b c d e"), (2, "c x y")], [(1, "a b"), (1, "c d b"), (2, "a b c"), (3, "x y z")]
    plans = []
    real = E.materialize
    monkeypatch.setattr(E, "materialize", lambda df: plans.append((df.columns, df.dtypes, df._jdf.queryExecution().optimizedPlan().toString())) or real(df))
    a, c = frames(spark, answers, candidates)
    got = {r.k: r.c for r in E.best_candidates(a, "k", "a", c, "c", "t").collect()}
    assert got == {1: 1, 2: 3}
    assert any("id" in columns and "c" in columns for columns, _, _ in plans)
    assert not any("array_intersect" in plan for _, _, plan in plans)
    assert not any(t.startswith("array") for columns, types, _ in plans if {"id", "c"} <= set(columns) for _, t in types)


def test_contained_candidates(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    answers = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(9)))) for i in range(80)] + [(90, None)]
    candidates = [(i, " ".join(rng.choice(vocab + ["zz"]) for _ in range(rng.randrange(4)))) for i in range(50)]
    a, c = frames(spark, answers, candidates)
    got = {(r.k, r.text, r.n) for r in E.held_candidates(a, "k", "a", c, "t").collect()}
    want = {(k, t, len(set(t.split()))) for k, s in answers for _, t in candidates if t and set(t.split()) <= set((s or "").split())}
    assert got == want


def test_word_bits_of_a_set_hold_those_of_its_parts(spark):
    words = [f"w{i}" for i in range(90)]
    rows = spark.createDataFrame([(words, words[:k], ["other", *words[:k]]) for k in (1, 5, 40)], "a array<string>, b array<string>, c array<string>")
    for r in rows.select(E.word_bits("a").alias("a"), E.word_bits("b").alias("b")).collect():
        assert all(x & y == y for x, y in zip(r.a, r.b)) and any(r.b) and len(r.a) == 4


def test_answers_are_not_copied_for_each_word(spark):
    """An answer of many words goes to the meeting of rare words without its words."""
    a = spark.createDataFrame([(1, "red big fox")], "k int, a string")
    c = spark.createDataFrame([("fox",)], "t string")
    plan = E.held_candidates(a, "k", "a", c, "t")._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate explode(_aw" in line]
    # What a Generate drops of its input stands first in brackets.
    assert exploded and all(re.search(r"explode\(_aw#\d+\), \[\d", line) for line in exploded)


def test_texts_are_not_copied_for_each_word(spark, tmp_path):
    """Half of the answers hold their truth; what is shuffled stays near the texts, however many words they have."""
    text = lambda i, n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.concat(F.lit("w"), F.pmod(F.xxhash64(i, j), F.lit(10**9)))), " ")
    df = spark.range(400).select("id", (F.col("id") % 2).alias("g"), text(F.col("id"), 400).alias("a"), text(F.col("id") + F.col("id") % 2, 390).alias("t"))
    df.write.parquet(f"{tmp_path}/df")
    df = spark.read.parquet(f"{tmp_path}/df")
    size = df.agg(F.sum(F.length("a") + F.length("t"))).collect()[0][0]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    with_own = E.open_accuracy(df, "id", "a", "t", df.select("t"), "t", ["g"], 2).collect()
    assert {(r.g, r.n, r.hit, r.exact) for r in with_own} == {(0, 200, 1.0, 0.0), (1, 200, 0.0, 0.0)}
    assert 0 < written() - before < 4 * size


@pytest.mark.parametrize("seed", range(3))
def test_open_questions_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(7)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(rng.randrange(n)))
    rows = [(i, rng.choice(["x", None]), text(9), text(4)) for i in range(120)] + [(200, "x", None, "w1"), (201, "x", "w1 w1 w2", "w1 w2 w2"), (202, "y", "", ""), (203, "y", "w1 w2 w3 w9", "w3 w2")]
    candidates = [r[3] for r in rows if r[0] % 5] + ["zz", "zz w1", None]
    df = spark.createDataFrame(rows, "id long, g string, answer string, truth string")
    out = E.open_accuracy(df, "id", "answer", "truth", spark.createDataFrame([(c,) for c in candidates], "c string"), "c", ["g"], 2)
    want = {}
    for _, g, a, t in rows:
        x, y = (a or "").split(), t.split()
        c = sum((Counter(x) & Counter(y)).values())
        held = sorted((-len(set(z.split())), z) for z in set(candidates) - {None, ""} if set(z.split()) <= set(x))
        grams = [(sum((Counter(p) & Counter(q)).values()), len(p)) for p, q in ((x, y), (list(zip(x, x[1:])), list(zip(y, y[1:]))))]
        b = (1 if len(x) >= len(y) else math.exp(1 - len(y) / len(x))) * math.sqrt(grams[0][0] / grams[0][1] * grams[1][0] / grams[1][1]) if all(m for m, _ in grams) else 0
        want.setdefault(g, []).append((c / len(x) if x else 0, c / len(y) if y else 0, 2 * c / (len(x) + len(y)) if x or y else 0, b, float(bool(held) and held[0][1] == t)))
    got = {r.g: (r.n, r.precision, r.recall, r.f1, r.bleu, r.hit) for r in out.collect()}
    assert got.keys() == want.keys()
    for g, own in want.items():
        assert got[g] == pytest.approx((len(own), *(sum(z) / len(own) for z in zip(*own))))
