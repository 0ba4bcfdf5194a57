import hashlib
import random

import pytest

from cohortlake.llm import suffixes

from .cases import documents, rows_of, saved


def brute(docs, n=100):
    first, out = {}, {}
    raws = {d: (t or "").encode() for d, t in docs.items()}
    for d in sorted(raws):
        for i in range(len(raws[d]) - n + 1):
            first.setdefault(raws[d][i : i + n], (d, i))
    for d, raw in raws.items():
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if first[raw[i : i + n]] < (d, i):
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts():
    rng = random.Random(9)
    word = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    passage, out = word(60), [None, "", "x", "a" * 99, "a" * 100, "a" * 101, "a" * 350, "ab" * 200]
    for cut in (0, 1, 20, 37):
        out += [word(9) + passage[cut:] + word(9), word(20) + passage[: 100 + cut] + word(5), passage[cut : cut + 99], word(3) + passage[cut : cut + 101]]
    base = word(250)
    for _ in range(12):  # near copies, an edit now and then
        t = list(base)
        for i in rng.sample(range(len(t)), 8):
            t[i] = rng.choice("xyz")
        out.append("".join(t))
    return out + [base, base, passage * 3, "\x00" * 130 + "z" + "\x00" * 130]


@pytest.mark.parametrize("how", [{}, {"width": 12}, {"hot": 3}, {"limit": 5}])
def test_small(spark, how):
    t = texts()
    got = suffixes.dedup(documents(spark, t, extra=True).repartition(5), **how)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got.collect()}
    assert got == brute(dict(enumerate(t)))


def test_documents_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 400)
    t = [x * 2 if x else x for x in texts()]
    got = suffixes.dedup(documents(spark, t).repartition(3))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got.collect()}
    assert got == brute(dict(enumerate(t)))


def test_query_and_corpus(spark, sf, tmp_path):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {d: tuple(r[1:]) for d, r in rows_of(suffixes.op1_suffix(spark, sf)).items()} == brute(docs)
    assert suffixes.op1_suffix(spark, saved(spark, tmp_path, [])).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "q" * 90 + "r" * 90), (1, "q" * 90 + "r" * 90), (None, "q" * 90 + "r" * 90), (2, "q" * 90 + "r" * 90)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffixes.dedup(df).collect()) == [(0, 0), (1, 0), (1, 0), (2, 180)]


def test_merge_is_a_sorted_merge():
    import numpy as np

    rng = np.random.default_rng(4)
    rows = rng.integers(0, 2, (500, 12), dtype=np.uint8)
    runs = []
    for part in np.array_split(rows, 7):
        part = part[np.lexsort(part.T[::-1])]
        runs.append(suffixes.Run(suffixes.front_code(part, np.arange(len(part)), np.arange(len(part))), 12))
    out, lcp, _, _ = suffixes.merge_runs(runs, 12)
    assert out == sorted(r.tobytes() for r in rows)
    assert lcp == suffixes.common(np.frombuffer(b"".join(out), np.uint8).reshape(-1, 12)).tolist()


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "abcdefghij" * 15, 1, 2, "x", 3), (2, "0123456789" * 15, 1, 2, "y", 3)], "doc_id long, text string, doc long, spans long, kept string, done long")
    got = suffixes.dedup(docs)
    assert got.columns == ["doc_id", "text", "doc", "spans", "done", "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got.collect()) == [(1, 150, 140, b"abcdefghij"), (2, 150, 140, b"0123456789")]
