import random

import pytest

from cohortlake.llm import neardup

from .cases import documents, rows_of, saved


def shingles(t, k):
    ws = (t or "").encode().lower().split()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def brute(docs, k):
    sets = {d: shingles(t, k) for d, t in docs.items()}
    comp, ids = {d: d for d in docs}, sorted(docs)

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    post = {}
    for d in ids:
        near = {}
        for s in sets[d]:
            for o in post.get(s, ()):
                near[o] = near.get(o, 0) + 1
            post.setdefault(s, []).append(d)
        for o, both in near.items():
            if 100 * both >= 80 * (len(sets[d]) + len(sets[o]) - both):
                a, b = sorted((find(o), find(d)))
                comp[b] = a
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_small(spark, tmp_path):
    rng = random.Random(2)
    base = [f"w{rng.randrange(400)}" for _ in range(200)]
    texts = [None, "", " \t", "One", "one", "one two", "ONE TWO", "é É", "É é"]
    for n in (2, 6, 10, 14, 20, 30):
        for _ in range(4):
            t = list(base)
            for i in rng.sample(range(200), n):
                t[i] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    chain = list(base)
    for _ in range(12):  # each near to the one before
        for i in rng.sample(range(200), 6):
            chain[i] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(chain))
    texts += ["long " + " ".join(f"z{i}" for i in range(20000))] * 2
    got = rows_of(neardup.op4_neardup(spark, saved(spark, tmp_path, texts)))
    assert {d: tuple(r[1:]) for d, r in got.items()} == brute(dict(enumerate(texts)), 2)
    kept = neardup.drop_near_duplicates(documents(spark, texts, extra=True))
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, x in brute(dict(enumerate(texts)), 5).items() if x[2]]
    assert neardup.near_duplicates(documents(spark, texts).limit(0)).count() == 0


def test_corpus(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows_of(neardup.op4_neardup(spark, sf))
    assert {d: tuple(r[1:]) for d, r in got.items()} == brute(docs, 2)


def test_repeated_ids_link_by_their_own_texts(spark):
    """(1, a), (1, b), (2, a), (3, b): each text's group is found, whichever row of document 1 it is."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (7, "x y"), (7, "z w"), (9, "z w"), (None, a)], "doc_id long, text string")
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs, k=2).select("doc_id", "component_id", "kept").collect() if r.doc_id is not None)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert sorted((r.doc_id or 0, r.text) for r in neardup.drop_near_duplicates(docs, k=2).collect()) == sorted([(0, a), (1, a), (1, b), (7, "x y"), (7, "z w")])


@pytest.mark.parametrize("vocabulary, most", [(10**4, 5000), (12, 12000)])
def test_near_copies_below_the_share_form_few_pairs(spark, monkeypatch, vocabulary, most):
    """500 copies of one text, most of them under 0.8 from it and from each other, and some that link."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = [" ".join(base)]
    for i in range(500):
        t = list(base)
        for at in rng.sample(range(150), rng.choice([3, 6, 12, 14, 18, 24, 30])):
            t[at] = f"x{rng.randrange(vocabulary)}"
        texts.append(" ".join(t))
    pairs = []
    look = neardup.confirm
    monkeypatch.setattr(neardup, "confirm", lambda p, *a: pairs.append(p.count()) or look(p, *a))
    got = {r.doc_id: tuple(r[1:]) for r in neardup.near_duplicates(documents(spark, texts), k=2).collect()}
    assert got == brute(dict(enumerate(texts)), 2)
    assert sum(pairs) < most, pairs  # of 125,000


def test_beside(spark):
    texts = spark.createDataFrame([(1, "a b c d"), (2, "a b c x"), (3, "q q q q"), (4, "")], "c long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 1)], "a long, b long")
    assert sorted((r.a, r.b, r.core, len(r.outside)) for r in neardup.beside(pairs, texts, 2).collect()) == [(1, 2, 2, 1), (1, 3, 0, 1), (1, 4, 0, 0), (2, 1, 2, 1)]


def test_clashing_names(spark):
    texts = ["one two three four five six", "one two three four five six", None, "other words here now again"]
    docs = documents(spark, texts).selectExpr("*", "1 AS h", "2 AS key", "3 AS doc", "4 AS of", "5 AS n", "'p' AS part")
    kept = neardup.drop_near_duplicates(docs)
    assert kept.dtypes == docs.dtypes and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_texts_are_read_as_bytes_one_at_a_time(spark):
    """Tasks hold a batch's texts once, as Arrow has them, and not as strings of pandas besides."""
    docs = documents(spark, ["one two", None, "é É"])
    texts = spark.createDataFrame([(1, "a b"), (2, "a c")], "c long, text string")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    for df in (neardup.signatures(docs, 2, 12, 2), neardup.confirm(pairs, texts, 2, 80), neardup.beside(pairs, texts, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert dict(neardup.with_texts(pairs, texts).dtypes)["ta"] == "binary"
    batch = neardup.batch([(1, b"x"), (None, None)], {"a": "int64", "t": "binary"})
    rows = neardup.each(batch)
    assert next(rows) == (1, b"x") and next(rows) == (None, None) and next(rows, None) is None


def edited(rng, words, places, vocabulary=10**6):
    t = list(words)
    for at in rng.sample(range(len(t)), places):
        t[at] = f"x{rng.randrange(vocabulary)}"
    return t


def test_two_groups_of_near_copies_form_few_pairs(spark, monkeypatch):
    """Two groups of 200 near copies, 0.6 alike: components are right, and pairs compared follow the classes, not their square."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = [" ".join(edited(rng, words, rng.choice([2, 4, 6, 8, 14]))) for words in (base, edited(rng, base, 30)) for _ in range(200)]
    pairs = []
    look = neardup.confirm
    monkeypatch.setattr(neardup, "confirm", lambda p, *a: pairs.append(p.count()) or look(p, *a))
    got = {r.doc_id: tuple(r[1:]) for r in neardup.near_duplicates(documents(spark, texts), k=2).collect()}
    assert got == brute(dict(enumerate(texts)), 2)
    assert sum(pairs) < 6000, pairs


def test_differing_pairs_lose_no_link(spark):
    """Classes that are not linked with their centre, in twos that are linked: all of these meet, and hardly others."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    texts = [base]
    for i in range(60):
        texts.append(edited(rng, base, 22, vocabulary=400 if i % 2 else 10**6))
        texts.append(edited(rng, texts[-1], rng.choice([1, 4, 7])))
    sets = [shingles(" ".join(t), 2) for t in texts]
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    n = len(texts)
    assert not any(alike(0, b) for b in range(1, n))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "c long, text string")
    part = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(sets)], "c long, n long, part long")
    seen = neardup.beside(spark.createDataFrame([(0, b) for b in range(1, n)], "a long, b long"), table, 2)
    assert {r.b: (len(r.outside), len(r.lacking)) for r in seen.collect()} == {b: (len(sets[b] - sets[0]), len(sets[0] - sets[b])) for b in range(1, n)}
    met = {(r.a, r.b) for r in neardup.differing_pairs(neardup.differing(neardup.held(seen, part, 80)), 80).collect()}
    links = {(a, b) for a in range(1, n) for b in range(a + 1, n) if alike(a, b)}
    assert len(links) >= 50 and links <= met and len(met) < 3 * len(links)
