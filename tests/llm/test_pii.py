import hashlib
import math
import random
import re
from collections import Counter

from cohortlake.llm import pii

from .cases import DOCS, documents, rows_of, saved

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def good(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    spans = sorted((m.start(), k, m.end()) for k, (kind, rx) in enumerate(RX.items()) for m in re.finditer(rx, text or "") if good(kind, m[0]))
    return spans, ",".join(f"{list(RX)[k]}:{s}:{e}" for s, k, e in spans)


TEXTS = [
    None, "", "no data", "mail a@b.c_d@e.f and a.b+c@x-y.co.uk.", "é😀 x@y.zz 10.0.0.1 and 300.1.1.1 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +49 (30) 1234-5678 or +1 2", "a" * 60000, "9" * 60000, "1." * 20000, "@" * 500 + "a@b" + ".c" * 9000,
    "x@y.zz\nx@y.zz", "+4915112345678 4111111111111111",
]


def test_base_spans_match_brute_force(spark, tmp_path):
    got = rows_of(pii.op7_pii(spark, saved(spark, tmp_path, TEXTS)))
    for i, t in enumerate(TEXTS):
        spans, text = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (i, text, got[i].spans)
        assert [got[i][f"n_{k}"] for k in RX] == [sum(s[1] == j for s in spans) for j in range(4)]


def test_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = rows_of(pii.op7_pii(spark, sf))
    assert all(got[d.doc_id].base_sha256 == hashlib.sha256(brute(d.text)[1].encode()).hexdigest() for d in docs)


def test_terms_that_give_an_entity_away_are_generalised(spark):
    texts = [f"note {w} from Zanzibar agent bob@corp.org about the {w} matter" for w in ("aaa", "bbb", "ccc", "ddd")]
    texts += [f"note about the {w} matter from common folk" for w in ("aaa", "bbb", "ccc", "ddd", "eee", "fff")] + [None, ""]
    got = rows_of(pii.sanitise(documents(spark, texts, extra=True)))
    assert got[0].text == "note aaa from [TERM] [TERM] [EMAIL] about the aaa matter"
    assert got[5].text == texts[5] and got[10].text is None and got[11].text == ""
    assert got[0]["size"] == 1


def test_copies_hide_no_term(spark):
    texts = [f"note {w} from Zanzibar bob@corp.org about the {w} matter" for w in ("aaa", "bbb", "ccc") + ("ddd",) * 10]
    texts += [f"note about the {w} matter from common folk" for w in ("aaa", "bbb", "ccc", "ddd", "eee", "fff")]
    got = rows_of(pii.sanitise(documents(spark, texts)))
    assert got[0].text == "note aaa from [TERM] [EMAIL] about the aaa matter"
    assert got[12].text == "note ddd from [TERM] [EMAIL] about the ddd matter"


def test_terms_far_from_the_entity_are_found(spark):
    between = "about common folk and their plain daily matter " * 3
    texts = [f"Zanzibar {w} {between}bob@corp.org {between}Quixote {'x' * 120} corp" for w in ("aaa", "bbb", "ccc", "ddd")]
    texts += [f"note {w} {between}" for w in ("aaa", "bbb", "ccc", "ddd", "eee", "fff")] + ["one corp", "corp two", "a corp"]
    got = rows_of(pii.sanitise(documents(spark, texts)))
    assert got[0].text == f"[TERM] aaa {between}[EMAIL] {between}[TERM] [TERM] corp"
    assert all(got[i].text == texts[i] for i in range(4, 13))


def test_term_spans_match_brute_force(spark):
    """Mutual information counted in plain Python over distinct texts."""
    rng, people = random.Random(4), [f"p{i}@corp.org" for i in range(6)] + ["10.0.0.7"]
    own = {p: [f"{x}{'abcdefg'[i]}name" for x in ("al", "be", "ce")] for i, p in enumerate(people)}
    texts = []
    for _ in range(150):
        ws = [rng.choice(["note", "mail", "from", "about", "the", "matter", "today", "plan"]) for _ in range(12)]
        if rng.random() < 0.5:
            p = rng.choice(people)
            ws += [p, *(w for w in own[p] if rng.random() < 0.8)]
        if rng.random() < 0.15:
            ws.append(rng.choice(own[rng.choice(people)]))
        rng.shuffle(ws)
        texts.append(" ".join(ws))
    texts += texts[:40] * 3 + [None]
    sets = []
    for t in {t or "" for t in texts}:
        spans, cut, at = brute(t)[0], [], 0
        for s, _, e in spans:
            cut.append(t[at:s] if s >= at else "")
            at = max(at, e)
        sets.append(({(k, t[s:e].lower()) for s, k, e in spans}, set(re.findall(r"[^\W\d_]{3,}", (" ".join(cut + [t[at:]])).lower()))))
    n, n_e, n_t, n_te = len(sets), Counter(), Counter(), Counter()
    for es, ts in sets:
        n_e.update(es), n_t.update(ts), n_te.update((e, t) for e in es for t in ts)
    leaks = {(e, t) for (e, t), k in n_te.items() if k >= 3 and math.log(n / n_e[e]) > 0 and math.log(k * n / (n_t[t] * n_e[e])) >= 0.9 * math.log(n / n_e[e])}
    assert len(leaks) > 5
    got = pii.annotate(documents(spark, texts)).collect()
    for r in got:
        t = r.text or ""
        base = brute(t)[0]
        mine = sorted({w for s, k, e in base for x, w in leaks if x == (k, t[s:e].lower())})
        want = sorted(base + [(m.start(), 4, m.end()) for m in re.finditer(rf"(?<![^\W\d_])(?:{'|'.join(mine)})(?![^\W\d_])", t, re.I)]) if mine else base
        assert [(s.start, s.kind, s.end) for s in r.spans] == want, t


def test_clashing_names(spark):
    rows = [(1, "mail a@b.cc", 1.5, "x", 3, 4, 5, 6), (1, "other", 2.5, "y", 3, 4, 5, 6), (None, None, None, None, 3, 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found double, spans string, _t int, _sha int, row int, _terms int")
    got = pii.sanitise(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.selectExpr("doc_id", "replace(text, 'a@b.cc', '[EMAIL]') AS text", "found", "spans", "_t", "_sha", "row", "_terms").collect()))
    assert pii.annotate(docs).columns == ["doc_id", "text", "_t", "_sha", "row", "_terms", "found", "spans"]


def test_empty_table(spark):
    assert pii.sanitise(spark.createDataFrame([], DOCS)).count() == 0
