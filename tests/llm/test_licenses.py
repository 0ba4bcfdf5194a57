import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlake.llm import licenses

from ..oracle import compare, connect
from .cases import documents, rows_of, saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    """Every rule on every text, without the prefilter; every pair of detections."""
    ws = words_of(text)
    base = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    spaced = " " + "  ".join(ws) + " "
    found = []
    for i, label, priority, confidence, pattern, _ in licenses.RULES:
        for m in re.finditer(pattern, spaced):
            found.append((spaced[: m.start()].count(" ") // 2, spaced[: m.end()].count(" ") // 2, label, priority, confidence, i))
    beats = lambda y, x: y[0] <= x[0] and y[1] >= x[1] and (y[3] < x[3] or (y[3] == x[3] and (y[1] - y[0] > x[1] - x[0] or y[5] < x[5])))
    kept = [x for x in found if not any(beats(y, x) for y in found)]
    return len(ws), base, sorted((x[0], -x[1], x[3], x[5]) for x in kept), sorted({label for _, label in base} | {x[2] for x in kept})


def sample(pattern, rng):
    """A text that fits a rule: one way through its brackets, classes and marks."""
    pattern = re.sub(r"\(([^()]*)\)(\??)", lambda m: "" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|")), pattern)
    pattern = re.sub(r"\[([a-z0-9])-?[^\]]*\]", r"\1", pattern)
    return re.sub(r"(.)\?", lambda m: rng.choice(["", m[1]]), pattern)


TEXTS = [
    None, "", "...", "CC BY-SA 4.0", "cc by cc by cc by", "All rights reserved. All Rights\nReserved!", "GNU General Public License, version 3", "general public licenses",
    "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the Apache License, Version 2.0 (the \"License\")", "mit der Zeit", "Released under the MIT License.",
    "Copyright (c) 2020-2021 Müller; © 1999 all rights reserved", "https://creativecommons.org/licenses/by-nc-sa/3.0/", "creative commons attribution sharealike 4.0 international", "opensource.org/licenses/BSD-3-Clause",
    "licensed under the mit license " * 200, "cc by " * 3000, "x" * 50000, "a cc", "by cc", "the lesser general public license version 2.1 and gplv3",
]


def spread(rng):
    return [" ".join(rng.sample("the a of and code is mit license cc by".split(), 4)) + " " + sample(r[4], rng) + " and " + sample(rng.choice(licenses.RULES)[4], rng) for r in licenses.RULES]


def test_rules_stand():
    assert len(licenses.RULES) > 500 and [r[2] for r in licenses.RULES] == sorted(r[2] for r in licenses.RULES)
    assert licenses.needed("(a|b c) (use )?only share ?alike licen[cs]e x( y)?") == ["only", "x"]
    rng = random.Random(5)
    for r in licenses.RULES:
        for _ in range(20):
            text = sample(r[4], rng)
            assert re.search(r[4], " " + "  ".join(text.split()) + " "), (r, text)
            assert set(r[5]) <= set(text.split()), (r, text)
    with pytest.raises(ValueError):
        licenses.CLAUSES.append(("x", 1, 1.0, "(a|b)", []))
        try:
            licenses.compile_rules()
        finally:
            licenses.CLAUSES.pop()


def test_detections_match_brute_force(spark):
    texts = TEXTS + spread(random.Random(1))
    got = rows_of(licenses.scan(documents(spark, texts, extra=True)))
    for i, t in enumerate(texts):
        n, base, kept, labels = brute(t)
        r = got[i]
        assert (r.n_words, [tuple(b) for b in r.base]) == (n, base), i
        assert sorted((d.start, -d.end, d.priority, d.rule) for d in r.detections) == kept, (i, t)
    assert {d.label for d in got[14].detections} == {"cc-by-nc-sa-3.0"} and got[11].detections == []


def test_query_matches_sql(spark, tmp_path, sf):
    own = saved(spark, tmp_path, TEXTS + spread(random.Random(2)))
    for at in (own, sf):
        con = connect(sf)
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{at}/documents.parquet{'/*.parquet' if at == own else ''}'")
        assert compare(licenses.op12_license(spark, at), con, licenses.OP12_SQL) is None


def test_no_python_worker_and_no_shuffle(spark, sf):
    plan = licenses.op12_license(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_awkward_rows(spark):
    df = documents(spark, TEXTS[:9], extra=True).withColumn("base", F.lit("b")).withColumn("w", F.lit(7)).withColumn("row", F.lit(8))
    got = licenses.scan(df.unionAll(df))
    assert got.columns == [*[c for c in df.columns if c != "base"], "n_words", "base", "detections"]
    rows = got.collect()
    assert len(rows) == 18 and all(r["w"] == 7 and r["row"] == 8 for r in rows)
    assert licenses.scan(df.limit(0)).count() == 0
    assert [r.detections for r in licenses.scan(df, rules=[], phrases=[]).collect()] == [[]] * 9
