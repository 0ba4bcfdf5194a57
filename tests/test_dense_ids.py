"""Ids of an index of images and annotations."""

from cohortlake.operators import cohort as B


def test_annotations_are_numbered_without_a_second_window(spark):
    rows = [(i % 37 if i % 50 else None, "ab"[i % 2], i, float(i % 5)) for i in range(400)]
    _, anns, _ = B.build_index(spark.createDataFrame(rows, "image long, category string, mask long, area double"), ["%s in %s"])
    got = anns.collect()
    want = [r for r in rows if r[0] is not None and r[3] > 0]
    assert sorted(r.ann_id for r in got) == list(range(1, len(want) + 1))
    assert {r["mask"] for r in got} == {r[2] for r in want} and len({(r.image, r.ann) for r in got}) == len(want)
    plan = anns._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 2
