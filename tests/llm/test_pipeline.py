import corpus_pipeline

from cohortlake.llm import decontaminate, pii

from .cases import documents
from .test_neardup import brute

CLASHING = ["score", "predicted", "kept", "component_id", "found", "spans", "row", "text_", "y", "hits", "taken", "target", "source_size", "part", "hash", "_sha"]
ITEM = "which planet of the solar system has the most moons that were known in the year two thousand"


def awkward(spark, folder, labelled=True):
    """Documents with clashing columns, nulls, repeats and long texts, beside labels and test items."""
    fine = [f"calm words about harbour {i} and river {i * 7} with stone {i * 3} under tree {i}" for i in range(30)]
    texts = fine + ["ZZ!! QQ!! %%%% ####"] * 10 + [None, "", "x", " ".join(f"long{i % 977} word{i}" for i in range(20000))]
    texts += [fine[3], fine[3] + " again", f"{fine[5]} {ITEM} {fine[6]}", f"{fine[7]} write to jane.doe@example.org or 192.168.0.1"]
    docs = documents(spark, texts, extra=True).selectExpr("*", *(f"'{c}' AS `{c}`" for c in CLASHING))
    docs = docs.unionByName(docs.where("doc_id in (2, 40, 41)")).unionByName(docs.where("doc_id = 1").selectExpr("cast(null as long) AS doc_id", *(f"`{c}`" for c in docs.columns[1:])))
    rows = [(i, int(not 30 <= i < 40), 0) for i in range(len(texts))] + [(None, 1, 0), (4, None, None), (3, 1, 0)]
    spark.createDataFrame(rows if labelled else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(0, ITEM), (1, None), (2, "")] if labelled else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r.text for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
        if name == "near-dedup":
            assert set(after) == {d for d, x in brute(before, 5).items() if x[2]}
        if name == "decontamination":
            held = {d for d, t in before.items() if any(i in decontaminate.normal(t) for i in items)}
            assert not held & set(after) and len(before) - len(after) <= len(held) + 2
        if name == "personal data":
            assert set(after) == set(before)
            assert pii.base_spans(docs).selectExpr("sum(size(filter(found, m -> m.kind < 3)))").first()[0] == 0
        if name == "mixing":
            assert set(after) <= set(before) and docs.where("taken < 1 or taken > 2 * size").count() == 0
            off = docs.groupBy("source", "target").agg({"taken": "sum"}).where("abs(`sum(taken)` - target) > 200")
            assert off.count() == 0
    assert 0 < len(after) < len(texts)
    full = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in full.collect()) == sorted(after)


def through(spark, docs, folder):
    """The documents after each stage, each written and read again."""
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        yield name, docs


def test_awkward_rows_in_every_stage(spark, tmp_path):
    docs = awkward(spark, str(tmp_path))
    held = [sorted((r.doc_id for r in docs.collect()), key=str)]
    for name, after in through(spark, docs, str(tmp_path)):
        if name != "mixing":
            assert after.dtypes == docs.dtypes
            assert {tuple(r[c] for c in CLASHING) for r in after.collect()} == {tuple(CLASHING)}
        ids = sorted((r.doc_id for r in after.collect()), key=str)
        gone = set(held[-1]) - set(ids)
        held.append(ids)
        if name == "quality classifier":
            assert gone >= {i for i in range(30, 40)} and not gone & set(range(30))
        elif name == "near-dedup":
            assert gone & set(range(46)) <= {44, 45} and 44 in gone
        elif name == "decontamination":
            assert gone == {46}
        elif name == "personal data":
            assert not gone
            told = {r.doc_id: r.text for r in after.collect()}
            assert "[EMAIL]" in told[47] and "[IP]" in told[47] and "@" not in told[47]
        else:
            assert {i for i in (40, 41) if i in ids} == set() and after.where("taken < 1 or taken > 2 * size").count() == 0


def test_empty_tables_in_every_stage(spark, tmp_path):
    docs = awkward(spark, str(tmp_path), labelled=False).limit(0)
    for name, after in through(spark, docs, str(tmp_path)):
        assert after.count() == 0 and (name == "mixing" or after.dtypes == docs.dtypes)
