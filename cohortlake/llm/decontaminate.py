"""Benchmark decontamination: pigeonhole edit matching.

Test items and documents are normalised alike (lower case, ASCII punctuation and white space
to single spaces).  An item of m bytes may be off by e = m * rate edits; cut into e + 1
pieces, one piece has to be there unchanged.  One automaton finds all pieces of all items in
a document; each hit names a window, which has to share enough q-grams (e edits destroy at
most q * e of them) and then passes Myers' bit-parallel distance.  An item that may not be off
at all (under 1 / rate bytes) is a word or two and has to stand between blanks.

Items come in blocks of ``block`` bytes of test text, each small enough to be sent to every
task; more test text means more passes over the documents, not larger ones.

Nulls and empties: a null text or doc_id matches nothing; null items and items without a
normalised byte are no items; repeated rows each get their result, rows that repeat a doc_id
one and the same, of all their texts; repeated items both count.  Input columns named like the
added ones give way to them; the filter keeps all.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, without

Q = 4
GRAM_BITS = 12
BLANK = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
HITS = "doc_id long, hits array<struct<item_id:long,distance:int>>"


def normal(text) -> str:
    """Bytes of the normalised text, one character each."""
    return b" ".join((text or "").lower().encode().translate(BLANK).split()).decode("latin-1")


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces, as equal as can be, with their places."""
    n, k = len(item), errors + 1
    cut = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(peq: dict[str, int], m: int, text: str, most: int) -> int:
    """Least edit distance between the item and any stretch of the text (Myers), or most + 1."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, most + 1
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best = score
    return best


def gram_codes(text: str) -> np.ndarray:
    """A small hash of the q-gram at every place; equal q-grams have equal ones."""
    d = np.frombuffer(text.encode("latin-1"), np.uint8).astype(np.uint32)
    if len(d) < Q:
        return np.zeros(0, np.int64)
    g = d[: len(d) - Q + 1]
    for i in range(1, Q):
        g = (g << np.uint32(8)) | d[i : len(d) - Q + 1 + i]
    return (g * np.uint32(2654435761) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.auto, found = [], ahocorasick.Automaton(), {}
        for item_id, text in items:
            e = int(len(text) * rate)
            held = np.zeros(1 << GRAM_BITS, np.uint8)
            held[gram_codes(text)] = 1
            self.items.append((item_id, text, e, masks(text), held, len(text) - Q + 1 - Q * e))
            for at, piece in pieces(text, e):
                found.setdefault(piece, []).append((len(self.items) - 1, at))
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        self.empty = not found
        if found:
            self.auto.make_automaton()

    def __call__(self, text) -> list[tuple[int, int]]:
        """(item_id, distance) of every item in the text."""
        doc = normal(text)
        if self.empty or not doc:
            return []
        starts: dict[int, set] = {}
        for end, (n, where) in self.auto.iter(doc):
            for item, at in where:
                if self.items[item][2] or (end - n < 0 or doc[end - n] == " ") and (end + 1 == len(doc) or doc[end + 1] == " "):
                    starts.setdefault(item, set()).add(end - n + 1 - at)
        out, codes = [], gram_codes(doc) if starts else None
        for item, diagonals in starts.items():
            item_id, text_, e, peq, held, need = self.items[item]
            best, done = e + 1, -1
            for d in sorted(diagonals):
                # Windows that hold the whole of an alignment on this diagonal.
                a, z = max(0, d - e), d + len(text_) + e
                if z <= done:
                    continue
                # Every q-gram that the edits leave whole takes a place of its own in the window.
                if need > 0 and held[codes[a : z - Q + 1]].sum() < need:
                    continue
                window = doc[a:z]
                best = 0 if text_ in window else min(best, distance(peq, len(text_), window, e))
                if best == 0:
                    break
                done = z if best <= e else done
            if best <= e:
                out.append((item_id, best))
        return sorted(out)


def blocks_of(items: DataFrame, block: int):
    """Test items in blocks of about ``block`` bytes, one at a time on the driver."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(size) // block)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


def find(docs: DataFrame, items: DataFrame, rate: float = 0.1, block: int = 1 << 20) -> DataFrame:
    """(doc_id, hits) of the documents that hold an item, up to one row a block and document."""
    spark, out = docs.sparkSession, None
    for part in blocks_of(items.where("text is not null and item_id is not null").select("item_id", "text"), block):
        ready = [(i, t) for i, t in ((i, normal(t)) for i, t in part) if t]
        sent = spark.sparkContext.broadcast(ready)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            match = Matcher(sent.value, rate)
            for b in batches:
                rows = [(d, h) for d, h in zip(b.doc_id, map(match, b.text)) if h]
                yield pd.DataFrame([(d, [{"item_id": i, "distance": x} for i, x in h]) for d, h in rows], columns=["doc_id", "hits"])

        found = docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, HITS)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], HITS) if out is None else out


def mark(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` with n_items, item_ids, best_distance and contaminated."""
    docs = without(docs, "n_items", "item_ids", "best_distance", "contaminated")
    doc, found = fresh(docs, "doc", "hits")
    hits = find(docs, items, **how).groupBy(F.col("doc_id").alias(doc)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias(found))
    ids = F.coalesce(F.array_distinct(F.transform(found, lambda h: h["item_id"])), F.array().cast("array<long>"))
    out = docs.join(hits, F.col("doc_id") == F.col(doc), "left").withColumn("item_ids", ids)
    out = out.withColumns({"n_items": F.size("item_ids").cast("long"), "best_distance": F.array_min(F.transform(found, lambda h: h["distance"])), "contaminated": F.col(found).isNotNull()})
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), "n_items", "item_ids", "best_distance", "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Documents that hold no test item; same columns."""
    (doc,) = fresh(docs, "doc")
    bad = find(docs, items, **how).select(F.col("doc_id").alias(doc)).distinct()
    return docs.join(bad, F.col("doc_id") == F.col(doc), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs, table(spark, sf_dir, "benchmark")).drop("text")
