"""Toxicity: Levenshtein automata on a lexicon trie, with context windows.

The lexicon is learned: words far more frequent in toxic training documents, by a likelihood
ratio whose threshold follows the number of words tested.  A word that is no entry runs through the intersection of the Levenshtein automata (one edit) of all entries
with the lexicon's trie, made deterministic as far as words ask for it: what is left alive at
a trie end is a misspelled entry.  A swap of neighbours is two edits.  Within one edit of
entries of three letters lie many sound words, so their misspellings are a signal of their
own, to which the fitted weights give what the labels support.

Each hit is scored in a window of words.  Quotation marks open before it (over the whole text
where its marks are balanced, else in the window) speak for quotation.  So do the words that
stand around hits of harmless training documents more than around those of toxic ones, and
the words of the other side speak for abuse: both are learned, on the rows that the weights
are fitted on.  A small logistic model weighs the sums.

Nulls and empties: a null text counts as empty (no hits, the model's base rate); a null
doc_id is scored and never trains; repeated rows each get their score, and documents that
repeat a doc_id all train under its label.  Input columns named like the added ones give way.
"""

import math
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, table, without
from .quality import labelled, sampled, train_rows

QUOTES = re.compile(r"[\"'“”„«»‘’]")
EDGE = re.compile(r"^\W+|\W+$")
WINDOW = 5
#: Entries up to this length tell their misspellings apart from those of longer ones.
SHORT = 3
FEATURES = 6


class Automaton:
    """All words within ``k`` edits of a lexicon entry: Levenshtein automata on the entries' trie.

    A state is a set of (trie node, edits so far).  States are numbered and their steps kept,
    so that a word costs one look-up a letter.
    """

    def __init__(self, words, k: int = 1, room: int = 200_000):
        self.k, self.room = k, room
        self.next: list[dict[str, int]] = [{}]
        self.entry: list[str | None] = [None]
        for w in sorted(words):
            node = 0
            for c in w:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.entry.append(None)
                node = self.next[node][c]
            self.entry[node] = w
        self.reset()

    def reset(self) -> None:
        self.states, self.steps, self.ends, self.number = [], [], [], {}
        self.start = self.state({(0, 0)})

    def state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a set of pairs, with the letters of entries that the word leaves out; -1: dead."""
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e < self.k:
                for to in self.next[node].values():
                    if (to, e + 1) not in pairs:
                        pairs.add((to, e + 1))
                        todo.append((to, e + 1))
        if not pairs:
            return -1
        key = frozenset(pairs)
        if (at := self.number.get(key)) is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            found = sorted((e, self.entry[n]) for n, e in key if self.entry[n] is not None)
            self.ends.append(found[0][1] if found else None)
        return at

    def step(self, at: int, c: str) -> int:
        out = set()
        for node, e in self.states[at]:
            if (to := self.next[node].get(c)) is not None:
                out.add((to, e))
            if e < self.k:
                out.add((node, e + 1))
                out.update((to, e + 1) for to in self.next[node].values())
        to = self.steps[at][c] = self.state(out)
        return to

    def __call__(self, word: str) -> str | None:
        """The entry of fewest edits within k of ``word`` (then the first in letter order), or None."""
        if len(self.states) > self.room:
            self.reset()
        at = self.start
        for c in word:
            to = self.steps[at].get(c)
            at = self.step(at, c) if to is None else to
            if at < 0:
                return None
        return self.ends[at]


class Matcher:
    """Looks words up, each distinct one of a task once; ``quoting`` and ``abusing`` are words of context."""

    def __init__(self, lexicon: dict[str, float], quoting: Iterable[str] = (), abusing: Iterable[str] = ()):
        self.lexicon, self.automaton = lexicon, Automaton(lexicon)
        self.quoting, self.abusing = frozenset(quoting), frozenset(abusing)
        self.known: set = set()
        self.hits: dict = {}

    def learn(self, tokens: set) -> None:
        if len(self.known) > 1_000_000:
            self.known, self.hits = set(), {}
        new = tokens - self.known
        for t in new:
            w = EDGE.sub("", t).lower()
            if w and (e := self.automaton(w)):
                self.hits[t] = (e, 0 if e == w else 2 if len(e) <= SHORT else 1)
        self.known |= new

    def around(self, text) -> set[tuple[str, str]]:
        """(entry, word) for words in the windows of an entry's hits that are no hits themselves; word "" for the entry alone."""
        tokens = (text or "").split()
        self.learn(set(tokens))
        out = set()
        for i, t in enumerate(tokens):
            if (hit := self.hits.get(t)) is not None:
                out.add((hit[0], ""))
                out.update((hit[0], EDGE.sub("", w).lower()) for w in tokens[max(0, i - WINDOW) : i + WINDOW + 1] if w not in self.hits)
        return out

    def features(self, text) -> list[float]:
        """Sums of entry weights: plain, misspelled, quoted; the largest context score; the share of words; misspelled short."""
        tokens = (text or "").split()
        self.learn(kinds := set(tokens))
        sums, quoted, top, n = [0.0, 0.0, 0.0], 0.0, 0.0, 0
        if not kinds.isdisjoint(self.hits):
            upto = list(accumulate((len(QUOTES.findall(t)) for t in tokens), initial=0))
            whole = upto[-1] % 2 == 0
            for i, t in enumerate(tokens):
                if (hit := self.hits.get(t)) is None:
                    continue
                entry, kind = hit
                first = max(0, i - WINDOW)
                low = {EDGE.sub("", w).lower() for w in tokens[first : i + WINDOW + 1]}
                marks = upto[i] - (0 if whole else upto[first]) + bool(QUOTES.match(t))
                context = 1.0 - 0.5 * (marks % 2) - 0.3 * (not low.isdisjoint(self.quoting)) + 0.3 * (not low.isdisjoint(self.abusing))
                score = self.lexicon[entry] * context
                if kind == 2:
                    sums[2] += score
                    continue
                n += 1
                top = max(top, score)
                if context < 0.7:
                    quoted += score
                else:
                    sums[kind] += score
        return [np.log1p(sums[0]), np.log1p(sums[1]), np.log1p(quoted), top, n / (len(tokens) + 10.0), np.log1p(sums[2])]


def threshold(tested: int, alpha: float) -> float:
    """What the statistic has to exceed: at most about ``alpha`` of ``tested`` indifferent words do, at every size."""
    return 2 * math.log(max(1, tested) / alpha)


def learn_lexicon(texts: DataFrame, alpha: float = 0.01, margin: float = 2.0, share: float = 1e-4) -> dict[str, float]:
    """All words of toxic training texts that pass the test, with a log-odds over ``margin``, in at least ``share`` of these texts.

    The share bounds what is broadcast: the entries have at most 1 / share times the bytes that
    one toxic text has in the mean, whatever the number of texts.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    words = texts.select("y", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))).alias("w"))
    n = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    seen = materialize(words.groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).where("t > 0"), "lexicon")
    part = lambda k, share: F.when(k > 0, k * F.log(k / ((F.col("t") + F.col("c")) * max(share, 1e-12)))).otherwise(0.0)
    g = 2 * (part(F.col("t"), n1 / max(1, n1 + n0)) + part(F.col("c"), n0 / max(1, n1 + n0)))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    best = seen.withColumn("odds", odds).where((F.col("odds") > margin) & (g > threshold(seen.count(), alpha)) & (F.col("t") >= share * n1))
    found = {r.w: round(float(r.odds), 6) for r in best.orderBy("w").collect()}
    forget(seen)
    return found


def learn_contexts(texts: DataFrame, lexicon: Broadcast, alpha: float = 0.01, shift: float = 0.1) -> tuple[list[str], list[str]]:
    """-> (quoting, abusing): words around hits that tell harmless from toxic texts with the same entry.

    A word's texts are compared entry by entry with all texts of the entry, and the differences
    summed (a score test over strata), so that what merely goes with some entries, such as the
    language, says nothing.  It has to pass the threshold and shift the share of toxic texts by ``shift``.
    """

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(lexicon.value)
        for b in batches:
            yield pd.DataFrame([(e, w, y) for text, y in zip(b.text, b.y) for e, w in m.around(text)], columns=["e", "w", "y"])

    pairs = texts.select("text", "y").mapInPandas(near, "e string, w string, y int")
    seen = materialize(pairs.groupBy("e", "w").agg(F.sum("y").alias("t"), F.count("*").alias("n")), "contexts")
    base = seen.where("w = ''").select("e", (F.col("t") / F.col("n")).alias("p"))
    words = seen.where("w <> ''").join(base, "e").groupBy("w").agg(
        F.sum(F.col("t") - F.col("n") * F.col("p")).alias("over"), F.sum(F.expr("n * p * (1 - p)")).alias("spread"), F.sum("n").alias("n")
    )
    tested = seen.where("w <> ''").select("w").distinct().count()
    best = words.where((F.col("over") * F.col("over") > threshold(tested, alpha) * F.col("spread")) & (F.abs("over") > shift * F.col("n")))
    found = sorted((r.w, r.over) for r in best.collect())
    forget(seen)
    return [w for w, over in found if over < 0], [w for w, over in found if over > 0]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d / max(1.0, np.abs(d).max() / 5)
        if np.abs(d).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = 3000) -> dict:
    """-> lexicon, words of context and weights.  The latter two see ``sample`` rows a class, least hash of doc_id first."""
    train = train_rows(labels, "toxic", folds, held)
    texts = labelled(docs, train)
    lexicon = learn_lexicon(texts.select("text", "y"))
    model = {"lexicon": lexicon, "quoting": [], "abusing": []}
    totals = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return model | {"w": np.array([0.0] * FEATURES + [3.0 if totals.get(1) else -3.0])}
    context = docs.sparkSession.sparkContext
    few = materialize(docs.select("doc_id", "text").join(F.broadcast(sampled(train, sample)), "doc_id").select("text", "y"), "sample")
    model["quoting"], model["abusing"] = learn_contexts(few, context.broadcast(lexicon))
    known = context.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = matcher(known.value)
        for b in batches:
            yield pd.DataFrame({"y": b.y.astype("int32"), "x": [m.features(t) for t in b.text]})

    got = sorted((r.y, tuple(r.x)) for r in few.mapInPandas(rows, "y int, x array<double>").collect())
    forget(few)
    x, y = np.array([r[1] for r in got]), np.array([float(r[0]) for r in got])
    weight = np.where(y > 0, totals[1] / max(1.0, y.sum()), totals[0] / max(1.0, (1 - y).sum()))
    return model | {"w": logistic(x, y, weight / weight.mean())}


def matcher(model: dict) -> Matcher:
    return Matcher(model["lexicon"], model["quoting"], model["abusing"])


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = matcher(known.value)
        for texts in batches:
            yield pd.Series(probability(np.array([m.features(t) for t in texts]).reshape(-1, FEATURES), known.value["w"]))

    return without(docs, "score", "predicted").withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
