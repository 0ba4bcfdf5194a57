import re
import zlib
from collections import Counter

import numpy as np

from cohortlake.llm import quality, toxicity

from .cases import DOCS, documents, rows_of, saved

SF = "/root/testdata/sf0.01"


def held_out(got, labels, name, folds, held):
    rows = {r.doc_id: r[name] for r in labels}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = [d for d, r in got.items() if r.held_out and d in rows]
    return np.mean([got[d].predicted == rows[d] for d in test])


def test_quality_held_out(spark):
    got = rows_of(quality.op10_quality(spark, SF))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert held_out(got, labels, "quality", 3, 1) > 0.95


def test_toxicity_held_out(spark):
    got = rows_of(toxicity.op9_toxicity(spark, SF))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert held_out(got, labels, "toxic", 5, 0) > 0.9


def test_awkward_rows(spark, tmp_path):
    texts = [None, "", "x", "good words " * 9000, "bad!! BAD!!"] + ["fine calm text"] * 20 + ["ZZ!! QQ!! idiot"] * 20
    labels = spark.createDataFrame([(i, int(i < 25), int(i >= 25)) for i in range(45)] + [(3, None, None), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    d = saved(spark, tmp_path, texts, labels=labels)
    for f in (quality.op10_quality, toxicity.op9_toxicity):
        got = rows_of(f(spark, d))
        assert len(got) == 45 and all(0 <= r.score <= 1 for r in got.values())
        assert got[5].score == got[6].score
    docs = documents(spark, texts, extra=True)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {5, 6} <= {r.doc_id for r in kept.collect()}
    one = labels.where("quality = 1")
    assert quality.score(docs, quality.fit(docs, one)).where("predicted = 0").count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == 45
    assert quality.keep_good(spark.createDataFrame([], DOCS), labels.limit(0)).count() == 0


def test_lexicon_keeps_every_word_that_passes(spark):
    bad = [f"bad{i}x" for i in range(400)]
    texts = spark.createDataFrame([(" ".join(bad), 1)] * 40 + [("fine calm text", 0)] * 160, "text string, y int")
    assert set(toxicity.learn_lexicon(texts)) == set(bad)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        old, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (c != d)))
    return row[-1]


def test_levenshtein_automaton():
    words = ["moron", "morons", "stupid", "worthless", "bad", "ab", "idiot"]
    rng = np.random.default_rng(5)
    tries = ["", "mroon", "stpuid", "clear", "b", "abc"] + words
    for w in words * 60:
        t = list(w)
        for _ in range(rng.integers(1, 3)):
            at, c = rng.integers(0, len(t) + 1), "abdimorstux"[rng.integers(0, 11)]
            t[at : at + rng.integers(0, 2)] = [c] if rng.integers(0, 2) else []
        tries.append("".join(t))
    for k in (1, 2):
        auto = toxicity.Automaton(words, k, room=40)
        for t in tries:
            best = min((edits(t, w), w) for w in words)
            assert auto(t) == (best[1] if best[0] <= k else None), t


def plain_features(text, model, near):
    """The features word by word: edit distance by table, quotation marks counted anew for each hit."""
    tokens = (text or "").split()
    low = [re.sub(r"^\W+|\W+$", "", t).lower() for t in tokens]
    for w in set(low) - set(near):
        near[w] = min(((edits(w, e), e) for e in model["lexicon"] if abs(len(w) - len(e)) < 2), default=(9, "")) if w else (9, "")
    marks = lambda ts: sum(c in "\"'“”„«»‘’" for t in ts for c in t)
    sums = {"plain": 0.0, "bent": 0.0, "short": 0.0, "quoted": 0.0}
    top, n = 0.0, 0
    for i, w in enumerate(low):
        d, entry = near[w]
        if d > 1:
            continue
        first = max(0, i - 5)
        before = marks(tokens[:i] if marks(tokens) % 2 == 0 else tokens[first:i]) + (tokens[i][0] in "\"'“”„«»‘’")
        window = set(low[first : i + 6])
        context = 1 - 0.5 * (before % 2) - 0.3 * bool(window & set(model["quoting"])) + 0.3 * bool(window & set(model["abusing"]))
        value = model["lexicon"][entry] * context
        kind = "plain" if d == 0 else "short" if len(entry) <= 3 else "bent"
        if kind == "short":
            sums["short"] += value
            continue
        n, top = n + 1, max(top, value)
        sums["quoted" if context < 0.7 else kind] += value
    log = {k: np.log1p(v) for k, v in sums.items()}
    return [log["plain"], log["bent"], log["quoted"], top, n / (len(tokens) + 10), log["short"]]


def test_features_are_those_of_plain_python():
    model = {"lexicon": {"moron": 3.0, "idiot": 2.5, "bad": 2.2}, "quoting": ["said", "book"], "abusing": ["you"]}
    m, rng, near = toxicity.matcher(model), np.random.default_rng(3), {}
    pool = ["moron", "Morons!", "idot", "bed", "bad", "“moron", "idiot”", '"idiot"', "said", "book", "you", "«", "fine", "calm", "it's", "-", "Day"]
    for k in range(300):
        text = " ".join(rng.choice(pool, rng.integers(0, 40)))
        assert np.allclose(m.features(text), plain_features(text, model, near)), text


def test_contexts_are_learned_entry_by_entry(spark):
    rows = [("the book said moron again", 0)] * 60 + [("hey you moron again", 1)] * 60
    rows += [("book x%d and moron" % i, i % 2) for i in range(40)]
    # "hier" goes with an entry that toxic texts have, and "dort" with one that few have: neither tells them apart.
    rows += [("hier idiot", 1)] * 60 + [("idiot", 1)] * 60 + [("dort scumbag", int(i < 6)) for i in range(60)] + [("scumbag", int(i < 6)) for i in range(60)]
    texts = spark.createDataFrame(rows + [(None, 1), ("", 0)], "text string, y int")
    lexicon = spark.sparkContext.broadcast({"moron": 3.0, "idiot": 3.0, "scumbag": 3.0})
    assert toxicity.learn_contexts(texts, lexicon) == (["book", "said", "the"], ["hey", "you"])
    assert toxicity.learn_contexts(texts.limit(0), lexicon) == ([], [])
    m = toxicity.Matcher(lexicon.value, ["book"], ["you"])
    assert m.features("the book moron")[3] < m.features("the moron")[3] < m.features("you moron")[3]


def test_lexicon_threshold_follows_the_words_tested(spark):
    words = ["foul"] * 13 + [""] * 27
    few = [(f"{w} calm", 1) for w in words] + [("calm text", 0)] * 60
    many = [(f"{t} " + " ".join(f"w{i}x{j}" for j in range(4000)), y) for i, (t, y) in enumerate(few)]
    learn = lambda rows: set(toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int")))
    assert learn(few) == {"foul"} and learn(many) == set()
    assert toxicity.learn_lexicon(spark.createDataFrame(few, "text string, y int"), share=0.5) == {}


def test_short_misspellings_are_found():
    m = toxicity.Matcher({"scum": 3.0, "idiot": 3.0, "moron": 3.0, "bad": 3.0})
    for w in ("scm", "scuum", "scun", "idot", "mron", "moro", "oron"):
        assert m.features(f"such {w} here")[1] > 0, w
    assert m.features("such bad here")[1] == 0 and m.features("such bad here")[0] > 0
    short = m.features("such bed here")
    assert short[5] > 0 and short[1] == short[4] == 0


def test_far_quotation_marks_count():
    m = toxicity.Matcher({"moron": 3.0})
    text = 'the man in the street "one two three four five six seven moron one two three four five six" and left'
    assert m.features(text)[2] > 0 and m.features(text.replace('"', ""))[2] == 0


def test_quality_scores_are_the_models(spark, sf):
    """Against plain Python that counts the same indicators by other means."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.collect()
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in rows:
        d = (r.text or "").encode()
        ids = {d[i] << 8 | d[i + 1] for i in range(len(d) - 1)}
        ids |= {(int.from_bytes(d[i : i + 4], "big") * 2654435761 % 2**32 >> 14) + 65536 for i in range(len(d) - 3)}
        m = sum(float(model["w"][i]) for i in sorted(ids)) / max(1, len(ids)) ** 0.5 + model["bias"]
        assert abs(1 / (1 + np.exp(-np.clip(model["slope"] * m + model["offset"], -30, 30))) - got[r.doc_id]) < 1e-6
    # The counts behind the weights: class ratios of all labelled training rows.
    train = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert set(r.doc_id for r in quality.labelled(docs, quality.train_rows(labels, "quality", 3, 1)).collect()) == set(train) & {r.doc_id for r in rows}


def test_toxicity_scores_are_the_models(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.collect()
    model = toxicity.fit(docs, labels)
    train = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    some = [(set(re.findall(r"[^\W_]{3,}", (r.text or "").lower())), train[r.doc_id]) for r in rows if r.doc_id in train]
    n1, n0 = sum(y for _, y in some), sum(1 - y for _, y in some)
    t, c = (Counter(w for ws, y in some if y == k for w in ws) for k in (1, 0))

    def gain(w):
        part = lambda k, share: k * np.log(k / ((t[w] + c[w]) * share)) if k else 0.0
        return 2 * (part(t[w], n1 / (n1 + n0)) + part(c[w], n0 / (n1 + n0)))

    odds = {w: np.log((t[w] + 0.5) / (n1 + 1)) - np.log((c[w] + 0.5) / (n0 + 1)) for w in t}
    limit = 2 * np.log(len(t) / 0.01)
    assert set(model["lexicon"]) == {w for w in t if odds[w] > 2 and gain(w) > limit and t[w] >= 1e-4 * n1}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    loud, near = 0, {}
    for r in rows:
        want = plain_features(r.text, model, near)
        loud += any(want)
        assert abs(got[r.doc_id] - toxicity.probability(np.array(want), model["w"])) < 1e-9
    assert 0 < loud < len(rows)


def test_clashing_names_and_repeated_ids(spark):
    rows = [(1, "idiot ZZ!!", 5, "x", 1), (1, "fine calm text", 6, "y", 2), (2, "fine text", 7, "z", 3), (None, None, 8, "w", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long, predicted string, score_ long")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels, folds=7)
    assert kept.dtypes == docs.dtypes and {tuple(r) for r in kept.collect()} <= set(rows)
    for made in (quality.score(docs, quality.fit(docs, labels, folds=7)), toxicity.score(docs, toxicity.fit(docs, labels, folds=7))):
        assert made.columns == ["doc_id", "text", "score_", "score", "predicted"] and made.count() == 4
    none = labels.limit(0)
    assert {r.predicted for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0}


def test_quotation_lowers_the_score():
    m = toxicity.Matcher({"moron": 3.0})
    plain, quoted = m.features("you are a moron"), m.features("then he said \"moron\" to them")
    assert plain[3] > quoted[3] and quoted[2] > 0 and plain[2] == 0
    assert m.features("what a morron")[1] > 0 and m.features(None) == m.features("")


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 10) + (50 if i % 2 else 0)) for i in range(60)]
    ys = np.array([1.0 if i % 2 else -1.0 for i in range(60)])
    ratio = np.r_[-np.ones(50), np.ones(50)]
    m = quality.margins(rows, quality.dual_descent(rows, ys, ratio), ratio)
    assert (np.sign(m) == ys).all()
