import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cohortlake.llm import runs

from .cases import documents, rows_of, saved


def brute(ws, floor=24, times=3):
    """Every period in turn: maximal stretches of equal words q apart, less those of a smaller period."""
    out, n = {}, len(ws)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            length = j - i + q
            if length >= max(floor, times * q) and not any(q % p == 0 and s <= i and s + m >= i + length for p, held in out.items() for s, m in held):
                out.setdefault(q, []).append((i, length))
            i = j + 1
    return sorted(((s, m, q) for q, held in out.items() for s, m in held), key=lambda r: (r[0], r[2]))


def answer(doc_id, text):
    """The contract, word by word."""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    found = brute(ws)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_bands_leave_no_lag_out():
    for floor, times in ((24, 3), (1, 3), (10, 4), (100, 3), (24, 7)):
        lags = [q for low, high, _ in runs.bands(3000, floor, times) for q in range(low, high + 1)]
        assert lags == list(range(1, len(lags) + 1)) and lags[-1] * times >= 3000 - times
        for low, high, k in runs.bands(3000, floor, times):
            assert all(k <= max(floor, times * q) - q and 3 * q <= 2 * k for q in range(low, high + 1))
    with pytest.raises(ValueError):
        list(runs.bands(10, 24, 2))


def made(rng):
    """Words of few kinds with periodic stretches, nested, cut and side by side."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        unit = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.choice([1, 2, 3, 7, 8, 11, 17, 30, 45]))]
        if rng.random() < 0.4:
            unit = unit * rng.randrange(2, 4) + [rng.randrange(3)]
        out += (unit * 12)[: rng.randrange(1, 8 * len(unit))] + [rng.randrange(3) for _ in range(rng.choice([0, 1, 20]))]
    return out[:700]


@pytest.mark.parametrize("floor,times", [(24, 3), (6, 3), (12, 4)])
def test_runs_are_those_of_brute_force(floor, times):
    rng = random.Random(floor)
    some = 0
    for _ in range(250):
        ws = made(rng)
        want = brute(ws, floor, times)
        some += len(want)
        assert runs.find_runs(np.array(ws, np.int64), floor, times) == want, ws
    assert some > 250


def test_self_similar_sequences():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    for ws in (fib[-1], thue, [0] * 500, [0, 1] * 300, ([0] * 20 + [1]) * 30, [0, 0, 1, 0, 0, 2] * 60):
        for floor in (6, 24):
            assert runs.find_runs(np.array(ws, np.int64), floor) == brute(ws, floor)


def test_few_seeds_are_extended(monkeypatch):
    """One word a hundred thousand times: pairs of neighbours and the covered table, no square."""
    calls = []
    real = runs.alike
    monkeypatch.setattr(runs, "alike", lambda a, b: calls.append(1) or real(a, b))
    assert runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert len(calls) == 2


LONG = "a b c d e f g h i j "
TEXTS = [
    None, "", " \t\n", "one", "x " * 23, "x " * 24, "x\t" * 24, LONG * 3, "pre " + LONG * 3 + "post", LONG * 40 + "x " * 30 + LONG * 3, "é 😀 " * 20, "  " * 30,
    ("p q " * 6 + "r ") * 9, " ".join(map(str, range(30000))), "w " * 50000, *("the same words come again and again " * 9,) * 12,
]


def test_query_matches_brute_force(spark, tmp_path):
    got = rows_of(runs.op11_runs(spark, saved(spark, tmp_path, TEXTS)))
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        if len(t or "") < 90000:
            assert tuple(got[i]) == answer(i, t), i
    assert got[14].n_runs == 1 and got[14].length == 50000


def test_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = rows_of(runs.op11_runs(spark, sf))
    assert len(got) == len(docs) and any(r.n_runs for r in got.values())
    for d in docs:
        if len(d.text or "") < 30000:
            assert tuple(got[d.doc_id]) == answer(d.doc_id, d.text), d.doc_id


def test_awkward_rows(spark):
    df = documents(spark, TEXTS[:12], extra=True).selectExpr("*", "1 AS runs", "'z' AS found", "2 AS start2", "3 AS length")
    got = runs.collapse_runs(df.unionAll(df.limit(9)))
    rows = got.collect()
    assert got.columns == [*[c for c in df.columns if c != "runs"], "runs", "collapsed"]
    assert len(rows) == 21 and all(r["found"] == "z" and r["length"] == 3 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[0].collapsed is None and by[0].runs == [] and by[1].collapsed == by[2].collapsed == ""
    assert by[5].collapsed == "x" and by[7].collapsed == LONG.strip() and by[8].collapsed == f"pre {LONG}post"
    assert runs.collapse_runs(df.limit(0)).collect() == []
    none = df.withColumn("doc_id", df.doc_id * None)
    assert runs.planted(none).count() == 12
