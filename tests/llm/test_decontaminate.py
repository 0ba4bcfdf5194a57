import random

from cohortlake.llm import decontaminate as d

from .cases import DOCS, documents, rows_of, saved


def brute(item, text):
    """Least edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice([["x"], [], [t[i], "y"]])
    return "".join(t)


def case():
    rng = random.Random(3)
    word = lambda n: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 6))) for _ in range(n))
    items = [word(20) for _ in range(6)] + ["tiny", "", None, "Ünï—code, ITEM with (punctuation) and more words!", "ten bytes!", "item text is short here", "--", "x"]
    texts = [None, "", word(50), "x" * 5000]
    for it in items[:6]:
        for n in (0, 2, 4, 6, 9, 14, 20):
            texts.append(f"{word(12)} {edited(rng, it, n).upper()} {word(12)}")
    texts += ["ünï—code item with punctuation and  more\nwords", items[0][:30] + " " + items[1], "a tiny x", "Item text is shirt here", "tinyx xx", "ten bites then ten byte", "q " * 30000 + "ten  BYTES"]
    return items, texts


def test_matches_brute_force(spark, tmp_path):
    items, texts = case()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = rows_of(d.op2_decontaminate(spark, saved(spark, tmp_path, texts, benchmark=bench)))
    used = {i: d.normal(t) for i, t in enumerate(items) if d.normal(t)}
    for k, t in enumerate(texts):
        # Items of under ten bytes may not be off and stand between blanks.
        whole = f" {d.normal(t)} "
        if len(whole) > 20000:
            want = {i: 0 for i, it in used.items() if f" {it} " in whole or len(it) > 9 and it in whole}
        else:
            want = {i: x for i, it in used.items() if len(it) > 9 and (x := brute(it, d.normal(t))) <= int(len(it) * 0.1)}
            want |= {i: 0 for i, it in used.items() if len(it) <= 9 and f" {it} " in whole}
        assert set(got[k].item_ids) == set(want), k
        assert got[k].contaminated == bool(want) and got[k].best_distance == min(want.values(), default=None)
    # Many small blocks of items find the same.
    many = rows_of(d.mark(documents(spark, texts, extra=True), bench, block=100).select("doc_id", "item_ids"))
    assert {k: r.item_ids for k, r in many.items()} == {k: r.item_ids for k, r in got.items()}
    kept = {r.doc_id for r in d.drop_contaminated(documents(spark, texts), bench).collect()}
    assert kept == {k for k, r in got.items() if not r.contaminated}


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], "item_id long, text string"), documents(spark, ["a", None])
    assert d.mark(docs, none).where("contaminated").count() == 0
    assert d.drop_contaminated(spark.createDataFrame([], DOCS), none).count() == 0


def test_clashing_names_and_repeated_ids(spark):
    bench = spark.createDataFrame([(1, "the answer is forty two")], "item_id long, text string")
    rows = [(1, "so the answer is forty two then", 1, 2, 3), (1, "other words", 1, 2, 3), (2, "clean words", 1, 2, 3), (None, "the answer is forty two", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc long, hits long, n_items long")
    kept = d.drop_contaminated(docs, bench)
    assert kept.dtypes == docs.dtypes and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]
    got = d.mark(docs, bench)
    assert got.columns == ["doc_id", "text", "doc", "hits", "n_items", "item_ids", "best_distance", "contaminated"]
    assert sorted((str(r.doc_id), r.contaminated) for r in got.collect()) == [("1", True), ("1", True), ("2", False), ("None", False)]
