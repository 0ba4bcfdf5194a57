import hashlib
import random

import numpy as np

from cohortlake.llm import sketch, windows

from .cases import documents, rows_of, saved


def brute(docs, n=13):
    """docs: {doc_id: text}"""
    first, out = {}, {}
    words = {d: (t or "").encode().split() for d, t in docs.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), d)
    for d, ws in words.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - n + 1):
            if first[tuple(ws[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        kept = b" ".join(w for w, g in zip(ws, gone) if not g)
        out[d] = (len(ws), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_small(spark, tmp_path):
    rng = random.Random(5)
    common = " ".join(rng.choice("abcde") * 3 + str(rng.randrange(50)) for _ in range(30))
    texts = [None, "", "x", common, f"pre {common} post", "a " * 40, "b\x0bb \t" * 20 + common[:40], "a " * 13, common.replace(" ", "\n"), " ".join(map(str, range(40000)))]
    texts += [" ".join(rng.choice(["u", "v"]) for _ in range(60)) for _ in range(30)] + ["ü " * 14, "ü " * 12 + "ü"]
    got = rows_of(windows.op6_substring(spark, saved(spark, tmp_path, texts)))
    want = brute(dict(enumerate(texts)))
    assert {d: tuple(r[1:]) for d, r in got.items()} == want
    # A sketch that is far too narrow passes more and loses nothing.
    narrow = rows_of(windows.dedup(documents(spark, texts, extra=True), width=10).select("doc_id", "n_words", "n_removed"))
    assert {d: tuple(r[1:]) for d, r in narrow.items()} == {d: w[:2] for d, w in want.items()}
    assert windows.dedup(documents(spark, texts).limit(0)).count() == 0


def test_null_ids_keep_their_words(spark):
    df = spark.createDataFrame([(None, "a " * 20), (None, "a " * 20), (1, "a " * 20)], "doc_id long, text string")
    assert [r.n_removed for r in windows.dedup(df).collect()] == [0, 0, 0]


def test_corpus(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows_of(windows.op6_substring(spark, sf))
    assert {d: tuple(r[1:]) for d, r in got.items()} == brute(docs)


def test_sketch_never_undercounts(spark):
    h = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    h = np.r_[h, h[:100]]
    import pandas as pd

    def run(batches):
        for b in batches:
            p = sketch.Partial(16, 2)
            list(p.add(b.h.to_numpy().view(np.uint64)))
            yield from p.flush()

    df = spark.createDataFrame(pd.DataFrame({"h": h.view(np.int64)})).repartition(3).mapInPandas(run, sketch.SCHEMA)
    keep = sketch.Filter(sketch.merged(df, 16, 2).value, 16, 2)(h)
    assert keep[:100].all() and keep[3000:].all() and keep.mean() < 0.2


def test_clashing_names_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text, 1, 2, "x", 3), (2, text, 1, 2, "y", 3), (2, "short " + text, 1, 2, "z", 3)], "doc_id long, text string, doc long, known long, kept string, done long")
    got = windows.dedup(docs)
    assert got.columns == ["doc_id", "text", "doc", "known", "done", "n_words", "n_removed", "kept"]
    # Both texts of document 2 lose the positions that either of them repeats.
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == [(1, 20, 0), (2, 20, 20), (2, 21, 21)]


def test_ranges_follow_what_passes(spark):
    docs = documents(spark, ["a b " * 2000, " ".join(map(str, range(5000))), "a b " * 1000 + "c"])
    passed = sketch.merged(windows.partials(docs, 13, 20, 2), 20, 2).value
    # Windows that come twice pass, those of the second text don't (but for chance).
    twice = (4000 - 12) + (2000 - 12) + 0
    assert twice <= sketch.passing(passed, 2) <= twice + 200
    assert sketch.ranges(passed, 2, 100, 3) >= twice // 100 and sketch.ranges(passed, 2, 1 << 40, 3) == 3
    assert sketch.passing({}, 2) == 0 and sketch.ranges({}, 2, 10, 4) == 4
    # One window a range or all in a few: the same positions.
    some = [{(r.doc_id, tuple(sorted(r.known))) for r in windows.repeated_positions(docs, 13, 20, 2, each=e).collect()} for e in (3, 1 << 30)]
    assert some[0] == some[1] and some[0]


def test_width_follows_the_input(spark):
    docs = documents(spark, ["abcd" * 1000, None])
    assert sketch.fitting(docs, 0.3, 28) == 20 and sketch.fitting(docs, 3000, 28) == 24 and sketch.fitting(docs, 1e9, 28) == 28 and sketch.fitting(docs.limit(0), 1, 28) == 20
