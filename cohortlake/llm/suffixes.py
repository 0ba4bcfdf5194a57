"""Suffix-array dedup: a distributed merge sort that knows common prefixes.

Repeated strings of ``length`` bytes are found from sorted suffixes.  Which suffixes are
sorted is fixed by content: every window of ``length`` bytes names its anchor, the position
of the least hash among its ``k``-byte strings, so equal windows have anchors at equal places
and about one byte in (length - k) / 2 starts a sorted suffix.  A suffix carries the offsets
of the windows that chose it, and the bytes left of it that these windows reach.

1. Windows whose anchor lies ``STEP`` bytes or less apart in them share all but that many
   bytes.  A merged sketch of hashes of these shared stretches tells which classes of windows
   can occur twice; the others are dropped, with a hash for a class and no byte sent.
2. Each task sorts its suffixes into runs, one for each range of hashes; equal suffixes of a
   task collapse to the earliest.  Runs are front-coded: each string as the length of the
   prefix that it shares with the one before, and the rest.
3. Runs of a range are merged by a loser tree that compares common-prefix lengths first and
   only the bytes beyond a known common prefix.  The merged sequence with its prefix lengths
   is the suffix array of that range: windows are equal where right parts share a prefix and
   left parts, sorted the same way, share one.  All but the earliest are reported.

Classes that occur ``hot`` times or more in the corpus are taken apart into single windows,
each a suffix of its own, which spread over the ranges and collapse in each task: a salt for
passages in very many contexts, with the same result.

Nulls and empties: a null text is empty; a null doc_id matches nothing; documents shorter
than ``length`` lose nothing.  Rows that repeat a doc_id count as one document: doc_id alone
orders them, equal starts in them are the same place, and they lose the same bytes.
Input columns named like the added ones give way to them.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .common import Hasher, fresh, partitions, planes, table, unplanes, without

POS = 21  # bits of a position inside a piece
PIECE = 1 << 20  # bytes of text that are looked at together
K = 32
STEP = 18  # offsets of windows in one class
RUN_SCHEMA = "part int, run binary, doc_id long, spans binary"


class Anchors:
    """Anchors of all windows of a piece of text."""

    def __init__(self, length: int, k: int = K):
        self.length, self.k, self.hasher = length, k, Hasher(23, PIECE + 1)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """data: bytes of several documents; start, end: of each document in it.

        -> (anchor, first window, last window, hash, prefix hashes) of every maximal row of windows with one anchor.
        """
        n, w = len(data), self.length - self.k + 1
        none = np.zeros(0, np.int64)
        if n < self.length:
            return none, none, none, none.view(np.uint64), none
        p = self.hasher.prefix(data)
        at = np.arange(n - self.k + 1)
        h = self.hasher.spans(p, at, at + self.k)
        low = np.uint64((1 << POS) - 1)
        v = (h & ~low) | at.astype(np.uint64)
        step, m = 1, v
        while 2 * step <= w:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < w:
            m = np.minimum(m[: len(v) - w + 1], m[w - step : w - step + len(v) - w + 1])
        # Windows inside one document only.
        live = np.zeros(n + 1, np.int8)
        fit = end - start >= self.length
        np.add.at(live, start[fit], 1)
        np.add.at(live, end[fit] - self.length + 1, -1)
        live = np.cumsum(live[:-1])[: n - self.length + 1] > 0
        window = np.flatnonzero(live)
        if not len(window):
            return none, none, none, none.view(np.uint64), none
        a = (m[window] & low).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (np.diff(window) > 1)])
        last = np.r_[cut[1:], len(window)] - 1
        return a[cut], window[cut], window[last], h[a[cut]], p

    def classes(self, p, a, first, last):
        """Class number, rows that have windows of it, and the hash of what these windows share."""
        low, high = a - last, a - first
        for i, b in enumerate(range(0, self.length - self.k + 1, STEP)):
            rows = np.flatnonzero((low < b + STEP) & (high >= b))
            start = a[rows] - b
            yield i, rows, self.hasher.spans(p, start, start + self.length - STEP + 1) ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)


def pieces(docs: Iterator[tuple[int, bytes]], length: int) -> Iterator[tuple]:
    """Documents -> (bytes, start, end, doc_id, offset) of pieces of about PIECE bytes.

    A document longer than a piece goes on in the next one, length - 1 bytes earlier, so that
    every window is in exactly one piece.
    """
    held, size = [], 0

    def out():
        n = np.array([len(x) for _, _, x in held])
        end = np.cumsum(n)
        return np.frombuffer(b"".join(x for _, _, x in held), np.uint8), end - n, end, np.array([d for d, _, _ in held]), np.array([o for _, o, _ in held])

    for doc, raw in docs:
        for o in range(0, max(1, len(raw) - length + 1), PIECE - length + 1):
            part = raw[o : o + PIECE]
            if size + len(part) > PIECE:
                yield out()
                held, size = [], 0
            held.append((doc, o, part))
            size += len(part)
    if held:
        yield out()


def texts_of(batches: Iterator[pd.DataFrame]):
    for b in batches:
        for d, t in zip(b.doc_id, b.text):
            if t:
                yield int(d), t.encode()


def grid(data: np.ndarray, at: np.ndarray, size: int, used: np.ndarray) -> np.ndarray:
    """``size`` bytes from each position, zero beyond ``used`` ones."""
    wide = np.concatenate([data, np.zeros(size, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(wide, size)[at]
    out[np.arange(size)[None, :] >= used[:, None]] = 0
    return out


class Suffixes:
    """Fixed-width strings of suffixes: right part, then left part (nearest byte first), then the offsets used."""

    def __init__(self, length: int, k: int = K):
        self.length, self.left = length, length - k
        self.width = length + self.left + 2

    def take(self, data, a, first, last) -> np.ndarray:
        right = grid(data, a, self.length, last + self.length - a)
        back = data[::-1]
        left = grid(back, len(data) - a, self.left, a - first)
        return np.hstack([right, left, (a - last)[:, None].astype(np.uint8), (a - first)[:, None].astype(np.uint8)])


def common(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before (0 for the first)."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    n = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.r_[0, n]


def front_code(rows: np.ndarray, doc: np.ndarray, at: np.ndarray) -> bytes:
    """A sorted run: shared prefix lengths, what follows them, doc_ids and starts."""
    lcp = common(rows)
    tail = rows[np.arange(rows.shape[1])[None, :] >= lcp[:, None]].tobytes()
    return zlib.compress(np.array([len(rows)], "<i8").tobytes() + planes(lcp.astype("<u2")) + planes(doc.astype("<i8")) + planes(at.astype("<i8")) + tail, 3)


class Run:
    """A front-coded run, read string by string."""

    def __init__(self, packed: bytes, width: int):
        raw = zlib.decompress(packed)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.lcp = unplanes(raw[8 : 8 + 2 * n], "<u2").tolist()
        self.doc = unplanes(raw[8 + 2 * n : 8 + 10 * n], "<i8")
        self.at = unplanes(raw[8 + 10 * n : 8 + 18 * n], "<i8")
        self.tail, self.n, self.width = memoryview(raw)[8 + 18 * n :], n, width
        self.i, self.p, self.now = -1, 0, b""

    def step(self) -> int:
        """Goes on to the next string; -> the prefix it shares with the one before, or -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            return -1
        shared = self.lcp[self.i]
        q = self.p + self.width - shared
        self.now = self.now[:shared] + bytes(self.tail[self.p : q])
        self.p = q
        return shared


def longer(a: bytes, b: bytes, n: int, width: int) -> int:
    """Common-prefix length of a and b, of which n are known."""
    while n < width and a[n : n + 16] == b[n : n + 16]:
        n += 16
    if n >= width:
        return width
    while a[n] == b[n]:
        n += 1
        if n >= width:
            return width
    return n


def merge_runs(runs: list[Run], width: int):
    """Loser tree over the runs -> (strings, shared prefix with the string before, run, index in it).

    Every node keeps a loser and the prefix that it shares with the string that beat it.  The
    candidate on the way up shares a known prefix with the same string, the last one put out:
    the longer shared prefix is the smaller string, and only at equal lengths bytes are
    compared, from that length on.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    shared = [0 if i < len(runs) and runs[i].step() >= 0 else -1 for i in range(size)]
    node = [-1] * (2 * size)  # losers; leaves are size + i

    def play(x: int, y: int):
        """-> (winner, loser); sets the loser's shared prefix to that with the winner."""
        p, q = shared[x], shared[y]
        if p > q:
            return x, y
        if q > p:
            return y, x
        if p < 0:
            return x, y
        a, b = runs[x].now, runs[y].now
        n = longer(a, b, p, width)
        if n >= width or a[n] < b[n]:
            shared[y] = n
            return x, y
        shared[x] = n
        return y, x

    def build(i: int) -> int:
        if i >= size:
            return i - size
        win, node[i] = play(build(2 * i), build(2 * i + 1))
        return win

    win = build(1) if size > 1 else 0
    out, lcps, run, index = [], [], [], []
    while shared[win] >= 0:
        r = runs[win]
        out.append(r.now)
        lcps.append(shared[win])
        run.append(win)
        index.append(r.i)
        shared[win] = r.step()
        i = (size + win) >> 1
        while i:
            win, node[i] = play(win, node[i])
            i >>= 1
    return out, lcps, run, index


def later(strings: np.ndarray, lcp: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int, left: int):
    """Of a sorted sequence: (row, offset) of the windows that an earlier start has too."""
    n = len(strings)
    low, high = strings[:, length + left].astype(np.int64), strings[:, length + left + 1].astype(np.int64)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((at, doc))] = np.arange(n)  # order of (doc_id, anchor): that of the windows at any one offset
    # Left parts in their own order inside each class of right parts that share K bytes.
    group = np.cumsum(lcp < length - left)
    key = np.hstack([group.astype(">u4").view(np.uint8).reshape(-1, 4), strings[:, length : length + left]])
    by_left = np.argsort(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), kind="stable")
    left_lcp = np.empty(n, np.int64)
    left_lcp[by_left] = common(key[by_left]) - 4
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    # Rows that repeat a doc_id are at one place, none before the other.
    same = np.cumsum(np.r_[True, (doc[place][1:] != doc[place][:-1]) | (at[place][1:] != at[place][:-1])])
    rows, offsets = [], []
    for o in range(int(low.min()), int(high.max()) + 1):
        at_o = np.flatnonzero((low <= o) & (o <= high))
        if len(at_o) < 2:
            continue
        right = np.cumsum(lcp < length - o)
        in_left = np.empty(n, np.int64)
        in_left[by_left] = np.cumsum(left_lcp[by_left] < o)
        pair = right[at_o] * (n + 1) + in_left[at_o]
        if n < 1 << 20:
            both = np.sort(pair * n + rank[at_o])  # under 2**63
            c, r = both // n, both % n
        else:
            order = np.lexsort((rank[at_o], pair))
            c, r = pair[order], rank[at_o][order]
        new = np.r_[True, c[1:] != c[:-1]]
        head = same[r][np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = place[r[same[r] > head]]
        rows.append(hit)
        offsets.append(np.full(len(hit), o))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(offsets)


def span_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray, ranges: int = 1) -> pd.DataFrame:
    """Spans, joined where they touch, as one row a document; dealt over ``ranges`` groups by document."""
    if not len(doc):
        return pd.DataFrame([], columns=["part", "run", "doc_id", "spans"])
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.r_[True, doc[1:] != doc[:-1]]
    # Reach so far inside a document: shift each document's numbers beyond the one before.
    shift = (np.cumsum(new) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    head = np.r_[True, (start + shift)[1:] > reach[:-1]] | new
    first = np.flatnonzero(head)
    tail = np.r_[first[1:], len(doc)] - 1
    d, s, e = doc[first], start[first], reach[tail] - shift[tail]
    cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    rows = [(-1 - int(d[a]) % ranges, None, int(d[a]), np.stack([s[a:z], e[a:z]], 1).astype("<i8").tobytes()) for a, z in zip(cut, np.r_[cut[1:], len(d)])]
    return pd.DataFrame(rows, columns=["part", "run", "doc_id", "spans"])


class Sorter:
    """Collects a task's suffixes and puts them out as front-coded runs, with what it could settle itself."""

    def __init__(self, length: int, ranges: int, limit: int):
        self.length, self.ranges, self.limit = length, ranges, limit
        self.form, self.held, self.n = Suffixes(length), [], 0

    def add(self, rows, doc, at, h):
        self.held.append((rows, doc, at, h))
        self.n += len(rows)
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        rows, doc, at, h = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        width, length, left = self.form.width, self.length, self.form.left
        part = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % self.ranges
        text = np.ascontiguousarray(rows).view(f"V{width}").ravel()
        first = np.lexsort((at, doc))
        order = first[np.argsort(text[first], kind="stable")]
        order = order[np.argsort(part[order], kind="stable")]
        rows, doc, at, part = rows[order], doc[order], at[order], part[order]
        again = np.r_[False, (part[1:] == part[:-1])] & (common(rows) == width)
        # Equal to an earlier one of this task: all its windows start earlier too.
        head = np.flatnonzero(~again)[np.cumsum(~again) - 1]
        gone = again & ((doc != doc[head]) | (at != at[head]))
        a, low, high = at[gone], rows[gone, length + left].astype(np.int64), rows[gone, length + left + 1].astype(np.int64)
        yield span_rows(doc[gone], a - high, a - low + length, self.ranges)
        rows, doc, at, part = rows[~again], doc[~again], at[~again], part[~again]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out = [(int(part[a]), front_code(rows[a:z], doc[a:z], at[a:z]), None, None) for a, z in zip(cut, np.r_[cut[1:], len(part)])]
        yield pd.DataFrame(out, columns=["part", "run", "doc_id", "spans"])


def apart(find: Anchors, form: Suffixes, data, first, last):
    """Rows of windows -> every window as a suffix of its own, with a hash of all its bytes."""
    n = last - first + 1
    w = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    return w, form.take(data, w, w, w), find.hasher.spans(find.hasher.prefix(data), w, w + form.length)


def repeated_spans(docs: DataFrame, length: int, width: int, depth: int, limit: int = 150_000, hot: int = 50_000, each: int = 500_000) -> DataFrame:
    """(doc_id, spans): bytes covered by strings that start earlier too, as packed (start, end).

    The number of ranges follows the classes that pass the sketch: the suffixes of one range,
    which a task merges at a time, come of about ``each`` of them.
    """

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, part = Anchors(length), sketch.Partial(width, depth)
        for data, start, end, _, _ in pieces(texts_of(batches), length):
            a, first, last, _, p = find(data, start, end)
            for _, _, h in find.classes(p, a, first, last) if len(a) else ():
                yield from part.add(h)
        yield from part.flush()

    some = docs.where("doc_id is not null and length(text) > 0").select("doc_id", "text")
    passed = sketch.merged(some.mapInPandas(partials, sketch.SCHEMA), width, depth, hot)
    ranges = sketch.ranges(passed.value, depth, each, 4 * partitions(docs.sparkSession))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, keep, out = Anchors(length), sketch.Filter(passed.value, width, depth), Sorter(length, ranges, limit)
        split = sketch.Filter(passed.value, width, depth, "hot")
        for data, start, end, doc, offset in pieces(texts_of(batches), length):
            a, first, last, h, p = find(data, start, end)
            if not len(a):
                continue
            low, high = np.full(len(a), length), np.full(len(a), -1)
            for i, rows, c in find.classes(p, a, first, last):
                b, live, much = i * STEP, keep(c), split(c)
                few, many = rows[live & ~much], rows[much]
                low[few], high[few] = np.minimum(low[few], b), np.maximum(high[few], b + STEP - 1)
                if len(many):
                    w, strings, hw = apart(find, out.form, data, np.maximum(first[many], a[many] - b - STEP + 1), np.minimum(last[many], a[many] - b))
                    o = np.searchsorted(end, w, side="right")
                    yield from out.add(strings, doc[o], w - start[o] + offset[o], hw)
            live = high >= 0
            # Windows of the first to the last class that can be there twice.
            first, last = np.maximum(first, a - high)[live], np.minimum(last, a - low)[live]
            a, h = a[live], h[live]
            if len(a):
                o = np.searchsorted(end, a, side="right")
                yield from out.add(out.form.take(data, a, first, last), doc[o], a - start[o] + offset[o], h)
        yield from out.flush()

    def join(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pdf[["doc_id", "spans"]]
        form = Suffixes(length)
        own = [Run(x, form.width) for x in pdf.run]
        strings, lcp, run, index = merge_runs(own, form.width)
        run, index = np.array(run), np.array(index)
        doc, at = np.empty(len(run), np.int64), np.empty(len(run), np.int64)
        for i, r in enumerate(own):
            mine = run == i
            doc[mine], at[mine] = r.doc[index[mine]], r.at[index[mine]]
        lcp = np.array(lcp)
        # Alone with its first bytes: a hash that only looked repeated.
        near = lcp >= length - form.left
        live = near | np.r_[near[1:], False]
        if not live.any():
            return pdf[["doc_id", "spans"]].iloc[:0]
        rows = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, form.width)[live]
        doc, at, lcp = doc[live], at[live], lcp[live]
        lcp[0] = 0
        r, o = later(rows, lcp, doc, at, length, form.left)
        return span_rows(doc[r], at[r] - o, at[r] - o + length)[["doc_id", "spans"]]

    sent = some.mapInPandas(runs, RUN_SCHEMA)
    return sent.groupBy("part").applyInPandas(join, "doc_id long, spans binary").groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))


def union_of(spans, n: int) -> list[tuple[int, int]]:
    """Packed (start, end) pairs -> maximal runs inside n bytes."""
    if spans is None or not len(spans):
        return []
    s = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in spans])
    s = s[np.argsort(s[:, 0])]
    s = s[s[:, 1] <= n]
    if not len(s):
        return []
    reach = np.maximum.accumulate(s[:, 1])
    head = np.flatnonzero(np.r_[True, s[1:, 0] > reach[:-1]])
    tail = np.r_[head[1:], len(s)] - 1
    return list(zip(s[head, 0].tolist(), reach[tail].tolist()))


def dedup(docs: DataFrame, length: int = 100, width: int | None = None, depth: int = 2, hot: int = 50_000, limit: int = 150_000) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept``, the bytes that stay.

    The sketch's width follows the bytes of the texts unless it is given: about one class of
    windows to two bytes.
    """
    width = sketch.fitting(docs, 0.6, 29) if width is None else width
    doc, spans, done = fresh(docs, "doc", "spans", "done")
    found = repeated_spans(docs.select("doc_id", "text"), length, width, depth, limit, hot).withColumnsRenamed({"doc_id": doc, "spans": spans})

    @F.pandas_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in parts:
            rows = []
            for t, s in zip(texts, spans):
                raw = (t or "").encode()
                gone = union_of(s, len(raw))
                at, kept = 0, []
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in gone), len(gone), b"".join(kept)))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    out = docs.join(found, F.col("doc_id") == F.col(doc), "left").withColumn(done, cut("text", spans)).drop(doc, spans)
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    return without(out, *new).withColumns({c: F.col(f"{done}.{c}") for c in new}).drop(done)


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
