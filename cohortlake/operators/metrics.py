"""Evaluation metrics as distributed aggregations.

Rows are reduced to distinct scores or times before any window sees them.  ``group`` is a
list of columns; metrics that aren't defined (a single class, no comparable pair) are null.
"""

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.prims import col, exact_mean, first_by, materialize, mid_ranks, prefix


def ratio(a, b) -> Column:
    return F.when(col(b) != 0, col(a) / col(b))


def binary_metrics(df: DataFrame, group: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, tn; accuracy, f1, sensitivity, specificity (0 where undefined)."""
    hit = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(pred) == p))
    n = df.groupBy(*group).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return n.withColumns({
        "accuracy": zero(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")),
        "f1": zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        "sensitivity": zero("tp", F.col("tp") + F.col("fn")),
        "specificity": zero("tn", F.col("tn") + F.col("fp")),
    })


def auroc(df: DataFrame, group: list[str], truth: str = "truth", score: str = "score", weight: Column | None = None) -> DataFrame:
    """(group, positives, negatives, auroc): ties count half."""
    w = F.lit(1.0) if weight is None else weight
    p = prefix(df, group, score, {"pos": F.when(F.col(truth) == 1, w).otherwise(0.0), "neg": F.when(F.col(truth) == 0, w).otherwise(0.0)})
    win = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    out = p.groupBy(*group).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), win.alias("_w"))
    return out.withColumn("auroc", ratio("_w", F.col("positives") * F.col("negatives"))).drop("_w")


def auprc(df: DataFrame, group: list[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """Average precision over distinct scores, from the highest."""
    p = prefix(df, group, score, {"pos": (F.col(truth) == 1).cast("double"), "all": F.lit(1.0)}, descending=True)
    return p.groupBy(*group).agg(ratio(F.sum(F.col("pos") * F.col("pos_upto") / F.col("all_upto")), F.sum("pos")).alias("auprc"))


def ovr_metrics(df: DataFrame, classes: list, truth: str = "truth", scores: str = "scores") -> DataFrame:
    """One-vs-rest f1, accuracy, AUROC and AUPRC; scores: one number a class, in order."""
    best = F.array_position(F.col(scores), F.array_max(scores)) - 1
    each = df.select(F.col(truth).alias("_t"), best.alias("_p"), F.posexplode(scores).alias("cls", "score"))
    each = each.withColumns({"truth": (F.col("_t") == F.col("cls")).cast("int"), "pred": (F.col("_p") == F.col("cls")).cast("int")})
    return binary_metrics(each, ["cls"]).select("cls", "f1", "accuracy").join(auroc(each, ["cls"]).select("cls", "auroc"), "cls").join(auprc(each, ["cls"]), "cls")


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred", group: list[str] | None = None) -> DataFrame:
    """(truth, pred, n, share of the truth's row) for the pairs that occur."""
    g = group or []
    n = df.groupBy(*g, truth, pred).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*g, truth)))


def confusion_matrix(df: DataFrame, truth: str = "truth", pred: str = "pred", group: list[str] | None = None) -> DataFrame:
    """``confusion`` with a row for every pair of the group's classes, true or predicted; n 0 for those that don't occur.

    The share of a class that is never true is null.
    """
    g = group or []
    n = confusion(df, truth, pred, g)
    # A group's classes, squared, are the rows of its matrix.
    own = n.groupBy(*g).agg(F.array_union(F.collect_set(truth), F.collect_set(pred)).alias("_c"))
    every = own.select(*g, F.explode("_c").alias(truth), "_c").select(*g, truth, F.explode("_c").alias(pred))
    total = n.groupBy(*g, truth).agg(F.sum("n").alias("_t"))
    out = every.join(n.select(*g, truth, pred, "n"), [*g, truth, pred], "left").join(total, [*g, truth], "left")
    return out.select(*g, truth, pred, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("_t")).alias("share"))


def subgroup_f1(df: DataFrame, group: list[str], least: int, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Macro F1 over the classes of the group, and accuracy, for groups of at least ``least``."""
    c = df.groupBy(*group, truth, pred).agg(F.count("*").alias("n"))
    per = c.select(*group, F.explode(F.array(F.struct(F.col(truth).alias("cls"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col(pred).alias("cls"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("tp")))).alias("s"))
    by = per.groupBy(*group, "s.cls").agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum("s.tp").alias("tp"))
    return by.groupBy(*group).agg(F.sum("t").alias("n"), F.avg(2 * F.col("tp") / (F.col("t") + F.col("p"))).alias("macro_f1"), (F.sum("tp") / F.sum("t")).alias("accuracy")).where(F.col("n") >= least)


def agreement(df: DataFrame, classes: int, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Balanced accuracy, kappa and quadratic kappa; classes are 0 .. classes - 1."""
    c = df.groupBy(F.col(truth).alias("i"), F.col(pred).alias("j")).agg(F.count("*").cast("double").alias("n"))
    rows, cols = c.groupBy("i").agg(F.sum("n").alias("r"), F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0.0)).alias("d")), c.groupBy("j").agg(F.sum("n").alias("c"))
    # Class totals against class totals: as many rows as classes squared.
    w = (F.col("i") - F.col("j")) ** 2 / float((classes - 1) ** 2)
    exp = rows.join(F.broadcast(cols)).agg(F.sum(w * F.col("r") * F.col("c")).alias("we"), F.sum(F.when(F.col("i") == F.col("j"), F.col("r") * F.col("c")).otherwise(0.0)).alias("pe"))
    obs = c.agg(F.sum("n").alias("n"), F.sum(w * F.col("n")).alias("wo"), F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0.0)).alias("po"))
    bal = rows.agg(F.avg(F.col("d") / F.col("r")).alias("balanced_accuracy"))
    one = obs.join(F.broadcast(exp)).join(F.broadcast(bal))
    return one.select("balanced_accuracy", ((F.col("po") / F.col("n") - F.col("pe") / F.col("n") ** 2) / (1 - F.col("pe") / F.col("n") ** 2)).alias("kappa"), (1 - F.col("wo") / F.col("n") / (F.col("we") / F.col("n") ** 2)).alias("quadratic_kappa"))


def topk_acc(df: DataFrame, ks: list[int], truth: str = "truth", scores: str = "scores") -> DataFrame:
    """Share of rows whose true class (0-based) is among the k best scores; equal scores count against it."""
    own = F.element_at(F.col(scores), F.col(truth) + 1)
    rank = F.size(F.filter(scores, lambda s: s >= own))
    return df.agg(*(F.avg((rank <= k).cast("double")).alias(f"top{k}") for k in ks))


def reg_metrics(df: DataFrame, group: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """R2, RMSE, MAE, explained variance in one aggregation."""
    e = F.col(truth) - F.col(pred)
    a = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(truth).alias("v"), F.var_pop(e).alias("ve"))
    return a.select(*group, "n", (1 - ratio("mse", "v")).alias("r2"), F.sqrt("mse").alias("rmse"), "mae", (1 - ratio("ve", "v")).alias("explained"))


def binarised(df: DataFrame, group: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Truth and prediction each cut at its own mean, then binary metrics."""
    mean = df.groupBy(*group).agg(F.avg(truth).alias("_mt"), F.avg(pred).alias("_mp"))
    cut = df.join(mean, group).select(*group, (F.col(truth) > F.col("_mt")).cast("int").alias("truth"), (F.col(pred) > F.col("_mp")).cast("int").alias("pred"))
    return binary_metrics(cut, group)


# --- survival -------------------------------------------------------------------------


def c_index(df: DataFrame, group: list[str], risk: str = "risk", time: str = "duration", event: str = "event", weight: Column | None = None, event_weight: Column | None = None) -> DataFrame:
    """(group, pairs, c_index): higher risk should mean an earlier event; ties in risk count half.

    Counts are reduced to distinct (risk, time) and dealt out by ranges of risk, later times first.
    What an event beats in its own range is counted in the range's task; what it beats in lower
    ranges, over the bits of the range's number in its group: sums by time of sibling halves of a block of ranges
    meet by prefix sums.  So a row is written once, and again only as a time of its range, once for
    each doubling of the ranges; no pair is ever formed.  Later rows of the same risk stand before
    an event and are counted as beaten too; half of these ties is taken off at the end.  A pair
    weighs ``event_weight`` of its event (``weight`` unless given) times ``weight`` of its other row.
    """
    w = F.lit(1.0) if weight is None else weight
    ew = w if event_weight is None else event_weight
    is_event = F.col(event) == 1
    d = df.where(F.col(risk).isNotNull() & F.col(time).isNotNull()).groupBy(*group, F.col(time).alias("t"), F.col(risk).alias("r"))
    d = d.agg(F.sum(F.when(is_event, ew).otherwise(0.0)).cast("double").alias("e"), F.sum(w).cast("double").alias("a"), F.sum(F.when(is_event, 0.0).otherwise(w)).cast("double").alias("c"))
    return of_ranges(in_ranges(d, group), group)


def drawn_c_index(df: DataFrame, group: list[str], key: Column, drawn, risk: str = "risk", time: str = "duration", event: str = "event") -> DataFrame:
    """(group, b, pairs, c_index) of ``c_index`` for each replicate b; ``drawn``: arrays of keys to rows of weights, one a replicate.

    A row goes to its range of risk once, with its key, and gets the weights of all replicates there.
    A range can end between rows of one risk and time, as their keys are part of the order.
    """
    rows = df.where(F.col(risk).isNotNull() & F.col(time).isNotNull()).select(*group, F.col(time).alias("t"), F.col(risk).alias("r"), F.coalesce(F.col(event) == 1, F.lit(False)).alias("_event"), key.alias("_k")).where("_k is not null")
    return of_ranges(in_ranges(rows, group, drawn), [*group, "b"])


#: Rows of a range that a task counts at a time, but for a batch.
RANGE = 2**18


def in_ranges(d: DataFrame, group: list[str], drawn=None) -> DataFrame:
    """Cells, or rows to draw for, dealt out by ranges of risk, later times first, to the sums of ``with_range_sums``, written."""
    order = [*map(F.col, group), F.col("r").asc(), F.col("t").desc(), *([F.col("_k").asc()] if drawn else [])]
    part = F.shiftleft(F.spark_partition_id().cast("long"), 32)
    return materialize(d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", part).mapInArrow(with_range_sums(group, drawn), range_schema(d, group, drawn)))


def of_ranges(d: DataFrame, group: list[str]) -> DataFrame:
    """(group, pairs, c_index) from the sums of ranges.

    Rows with a time alone are the times of a range, those with a risk alone its first and last risks, with the
    pairs counted inside, and those with both its first and last cells, of which a part can be in the ranges beside it.
    """
    number = d.select("_part").distinct().select("_part", F.row_number().over(Window.orderBy("_part")).alias("_range"))
    times = d.where("r is null").join(F.broadcast(number), "_part")
    ends = d.where("r is not null")
    sums = {c: F.col(c) for c in ("e", "a", "c")}
    # Later than an event at t: every later time, and those censored at t.
    later = F.col("e") * (F.col("a_upto") - F.col("a") + F.col("c"))
    pairs = prefix(times, group, "t", sums, descending=True).groupBy(*group).agg(F.sum(later).alias("pairs"))
    # A later part of a cell took events of the earlier one for later rows, and met none of its own with that one's events.
    before = Window.partitionBy(*group, "r", "t").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    same = ends.withColumn("_same", F.when(F.col("t").isNull(), F.col("e") * sum_before("a")).otherwise(-F.col("a") * sum_before("e")))
    inside = same.groupBy(*group).agg(F.sum("beaten").alias("beaten"), (F.sum("tied") + F.sum("_same")).alias("tied"))
    # Level j: ranges p and p' meet where their bits above j agree and bit j is 1 for the event's row, 0 for the other.
    top = times.groupBy(*group).agg(F.min("_range").alias("pmin"), F.max("_range").alias("pmax"))
    level = times.join(top, group) if group else times.crossJoin(F.broadcast(top))
    level = level.withColumn("j", F.explode(F.expr("sequence(0, cast(floor(log2(greatest(pmax - pmin, 1))) as int))")))
    half = F.expr("shiftright(_range - pmin, j)")
    level = level.withColumn("_half", F.shiftright(half, 1)).withColumn("_hi", half % 2)
    lo = F.col("_hi") == 0
    s = {"e": F.when(lo, 0.0).otherwise(F.col("e")), "a": F.when(lo, F.col("a")).otherwise(0.0), "c": F.when(lo, F.col("c")).otherwise(0.0)}
    won = prefix(level, [*group, "j", "_half"], "t", s, descending=True).groupBy(*group).agg(F.sum(later).alias("won"))
    both = pairs.join(inside, group).join(won, group) if group else pairs.crossJoin(inside).crossJoin(won)
    return both.select(*group, "pairs", ratio(F.col("won") + F.col("beaten") - F.col("tied") / 2, "pairs").alias("c_index"))


def range_schema(cells: DataFrame, group: list[str], drawn=None) -> T.StructType:
    number = lambda n: T.StructField(n, T.DoubleType())
    own = [T.StructField(f.name, f.dataType) for f in (*(cells.schema[g] for g in group), cells.schema["r"], cells.schema["t"])]
    own[len(group) : len(group)] = [T.StructField("b", T.IntegerType())] if drawn else []
    return T.StructType([*own, T.StructField("_part", T.LongType()), *map(number, ("e", "a", "c", "beaten", "tied"))])


def with_range_sums(group: list[str], drawn=None):
    """Sorted (group, risk, time) cells to sums of ranges by group and time, and the first and last risk of each group there.

    A task's rows are taken ``RANGE`` or a batch more at a time, as ranges of their own.  With ``drawn`` rows
    become cells here, for each replicate, and the first and last cells come too.
    """

    def run(batches):
        held, n, number = [], 0, 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= RANGE:
                yield from sums_of(pa.Table.from_batches(held), number)
                held, n, number = [], 0, number + 1
        if n:
            yield from sums_of(pa.Table.from_batches(held), number)

    def sums_of(rows, number):
        rows = rows.combine_chunks()
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for g in group:
            at = pc.fill_null(rows[g].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            new[1:] |= at[1:] != at[:-1]
        starts = [*np.flatnonzero(new).tolist(), rows.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            own = rows.slice(lo, hi - lo)
            if drawn:
                a, event = drawn(own["_k"].to_numpy()), own["_event"].to_numpy(zero_copy_only=False)
                e, c = a * event, a * ~event
            else:
                e, a, c = (own[n].to_numpy()[None] for n in ("e", "a", "c"))
            r, t = (own[n].to_numpy() for n in ("r", "t"))
            cells = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1])]))
            if len(cells) < len(r):
                e, a, c = (np.add.reduceat(x, cells, axis=1, dtype=float) for x in (e, a, c))
            r, t = (np.unique(x[cells], return_inverse=True) for x in (r, t))
            first_of_t = np.zeros(len(t[0]), int)
            first_of_t[t[1]] = np.arange(len(cells))
            ends = [0] if r[1][0] == r[1][-1] else [0, len(cells) - 1]
            parts = [] if not drawn else [0] if len(cells) == 1 else [0, len(cells) - 1]
            pick = pa.array(cells[np.concatenate([first_of_t, np.array(ends + parts, int)])])
            kind = np.repeat([0, 1, 2], [len(first_of_t), len(ends), len(parts)])
            take = lambda n: own[n].combine_chunks().take(pick)  # noqa: B023, E731
            null = lambda n, gone: pc.if_else(pa.array(gone), pa.scalar(None, own.schema.field(n).type), take(n))  # noqa: B023, E731
            fixed = [*map(take, group)], [null("r", kind == 0), null("t", kind == 1), pa.array(np.full(len(kind), own["_part"][0].as_py() + number))]
            beaten = beaten_inside(t[1], e, a, c)
            for b, draw in enumerate(zip(e, a, c)):
                sums = [np.concatenate([np.bincount(t[1], x, len(t[0])), [x[r[1] == r[1][i]].sum() for i in ends], x[parts]]).astype(float) for x in draw]
                zeros = lambda v: pa.array(np.where(np.arange(len(kind)) == len(first_of_t), v, 0.0))  # noqa: B023, E731
                columns = [*fixed[0], *([pa.array(np.full(len(kind), b, np.int32))] if drawn else []), *fixed[1], *map(pa.array, sums), zeros(beaten[b]), zeros(tied_inside(r[1], *draw))]
                yield pa.RecordBatch.from_arrays(columns, names=[*group, *(["b"] if drawn else []), "r", "t", "_part", "e", "a", "c", "beaten", "tied"])

    return run


def tied_inside(r, e, a, c) -> float:
    """Events times the later rows of the same risk and those censored at the event's time; later times come first."""
    new = np.concatenate([[True], r[1:] != r[:-1]])
    before = np.cumsum(a, dtype=float) - a
    start = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    return float((e * (before - before[start] + c)).sum())


def beaten_inside(t, e, a, c) -> list[float]:
    """For each row of weights the events times the rows at or before them that have a later time, or are censored at the same one.

    Level by level over the bits of the position: an event in the upper half of a block meets the lower half.
    """
    n = len(t)
    order = np.argsort(-t, kind="stable")
    totals = [float(x.astype(float) @ y) for x, y in zip(e, c)]
    for j in range((n - 1).bit_length()):
        # Every block in order of time, latest first.
        at = order[np.argsort(order >> (j + 1), kind="stable")]
        block, time, low = at >> (j + 1), t[at], (at >> j) & 1 == 0
        i = np.arange(n)
        new = np.concatenate([[True], block[1:] != block[:-1]])
        start = np.maximum.accumulate(np.where(new, i, 0))
        new[1:] |= time[1:] != time[:-1]
        run = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        first, end = run[which], np.concatenate([run[1:], [n]])[which]
        up = np.flatnonzero(~low)
        start, first, end, upper = start[up], first[up], end[up], at[up]
        for b in range(len(totals)):
            ca, cc = (np.concatenate([[0.0], np.cumsum(np.where(low, x[b][at], 0), dtype=float)]) for x in (a, c))
            totals[b] += float(e[b][upper] @ (ca[first] - ca[start] + cc[end] - cc[first]))
    return totals


def ipcw_c_index(df: DataFrame, group: list[str], risk: str = "risk", time: str = "duration", event: str = "event", tau: float | None = None) -> DataFrame:
    """Concordance with pairs weighted by the squared inverse probability of being uncensored at the event's time.

    The censoring curve is that of all rows; events after ``tau`` form no pairs.
    """
    w = ipcw_weights(df, time, event)
    used = F.col("ipcw") ** 2 if tau is None else F.when(F.col(time) <= tau, F.col("ipcw") ** 2).otherwise(0.0)
    return c_index(w, group, risk, time, event, event_weight=used)


def subgroup_cindex(df: DataFrame, group: list[str], least: int, events: int) -> DataFrame:
    ok = df.groupBy(*group).agg(F.count("*").alias("n"), F.sum("event").alias("events")).where((F.col("n") >= least) & (F.col("events") >= events))
    return c_index(df.join(ok.select(*group), group, "left_semi"), group).join(ok, group)


def at_risk(df: DataFrame, group: list[str], time: str = "duration", event: str = "event") -> DataFrame:
    """(group, t, d, c, n): events and censored at a time, and how many are still there."""
    p = prefix(df, group, time, {"d": (F.col(event) == 1).cast("long"), "a": F.lit(1).cast("long")}, descending=True)
    return p.select(*group, F.col(time).alias("t"), "d", (F.col("a") - F.col("d")).alias("c"), F.col("a_upto").alias("n"))


def km(df: DataFrame, group: list[str], time: str = "duration", event: str = "event") -> DataFrame:
    """Kaplan-Meier curve with its at-risk table."""
    last = F.col("d") == F.col("n")
    step = {"_log": F.when(last, 0.0).otherwise(F.log(1 - F.col("d") / F.col("n"))), "_end": last.cast("int")}
    # The table has a row a time, so the sums at a time are that row's own figures.
    p = prefix(at_risk(df, group, time, event), group, "t", {c: F.col(c) for c in ("d", "c", "n")} | step)
    return p.select(*group, "t", "d", "c", "n", F.when(F.col("_end_upto") > 0, 0.0).otherwise(F.exp("_log_upto")).alias("survival"))


def risk_groups(df: DataFrame, how: str = "median", risk: str = "risk") -> DataFrame:
    """``risk_group`` by mean, median, tertile or quartile cuts; a value on a cut is in the lower group."""
    if how == "mean":
        cuts = df.agg(F.array(F.avg(risk)).alias("_cuts"))
    else:
        at = {"median": [0.5], "tertile": [1 / 3, 2 / 3], "quartile": [0.25, 0.5, 0.75]}[how]
        cuts = df.agg(F.percentile(risk, F.array(*map(F.lit, at))).alias("_cuts"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("risk_group", F.size(F.filter("_cuts", lambda c: F.col(risk) > c))).drop("_cuts")


def logrank(df: DataFrame, side: str, group: list[str] | None = None, time: str = "duration", event: str = "event") -> DataFrame:
    """Two-sample test (side is 0 or 1): observed, expected, variance, chi2 and p."""
    g = group or []
    p = prefix(df, g, time, {"d": (F.col(event) == 1).cast("double"), "a": F.lit(1.0), "d1": ((F.col(event) == 1) & (F.col(side) == 1)).cast("double"), "a1": (F.col(side) == 1).cast("double")}, descending=True)
    n, n1, d = F.col("a_upto"), F.col("a1_upto"), F.col("d")
    v = F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).otherwise(0.0)
    out = p.where("d > 0").groupBy(*g).agg(F.sum("d1").alias("observed"), F.sum(d * n1 / n).alias("expected"), F.sum(v).alias("variance"))
    out = out.withColumn("chi2", ratio((F.col("observed") - F.col("expected")) ** 2, "variance"))
    return out.withColumn("p", chi2_p("chi2"))


def logrank_pairwise(df: DataFrame, by: str, time: str = "duration", event: str = "event") -> DataFrame:
    """The two-sample test for every pair of groups: (ga, gb, observed, ..); pairs of groups, never of rows."""
    g = df.select(by).where(F.col(by).isNotNull()).distinct()
    duels = g.select(F.col(by).alias("ga")).join(g.select(F.col(by).alias("gb")), F.col("ga") < F.col("gb"))
    ends = duels.select(F.explode(F.array(F.struct(F.col("ga").alias(by), F.lit(0).alias("_side"), "ga", "gb"), F.struct(F.col("gb").alias(by), F.lit(1).alias("_side"), "ga", "gb"))).alias("s")).select("s.*")
    return logrank(df.select(by, time, event).join(ends, by), "_side", ["ga", "gb"], time, event)


def chi2_p(x) -> Column:
    """Upper tail of chi-square with one degree of freedom, to 1e-7 (rational approximation of erfc)."""
    z = F.sqrt(col(x) / 2)
    t = 1 / (1 + 0.5 * z)
    powers = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    s = F.lit(0.0)
    for c in reversed(powers):
        s = s * t + c
    return t * F.exp(-z * z + s)


def censoring(df: DataFrame, time: str = "duration", event: str = "event") -> DataFrame:
    """(t, left): probability of being uncensored just before each time, over all rows."""
    g = at_risk(df.withColumn("_cens", 1 - F.col(event)), [], time, "_cens")
    # Just before t: the curve at t without t's own factor, which is 1 - d / n.
    p = prefix(g, [], "t", {"_log": F.when(F.col("d") == F.col("n"), 0.0).otherwise(F.log(1 - F.col("d") / F.col("n"))), "_end": (F.col("d") == F.col("n")).cast("int")})
    return p.select("t", F.when(F.col("_end_upto") - F.col("_end") > 0, 0.0).otherwise(F.exp(F.col("_log_upto") - F.col("_log"))).alias("left"))


def ipcw_weights(df: DataFrame, time: str = "duration", event: str = "event") -> DataFrame:
    """Rows with ``ipcw``: 1 / probability of being uncensored just before their time; 0 for censored rows."""
    g = censoring(df, time, event).select(F.col("t").alias(time), F.col("left").alias("_g"))
    return df.join(g, time).withColumn("ipcw", F.when((F.col(event) == 1) & (F.col("_g") > 0), 1 / F.col("_g")).otherwise(0.0)).drop("_g")


def dynamic_auc(df: DataFrame, times: list[float], time: str = "duration", event: str = "event", risk: str = "risk") -> DataFrame:
    """Cumulative / dynamic AUC at given times: weighted events until then against those still there."""
    w = ipcw_weights(df, time, event).withColumn("at", F.explode(F.array(*(F.lit(float(t)) for t in times))))
    case, control = (F.col(time) <= F.col("at")) & (F.col(event) == 1), F.col(time) > F.col("at")
    rows = w.where(case | control).withColumn("truth", case.cast("int"))
    return auroc(rows, ["at"], "truth", risk, F.when(F.col("truth") == 1, F.col("ipcw")).otherwise(1.0)).select("at", "auroc")


# --- segmentation and detection ---------------------------------------------------------


def overlap(df: DataFrame, group: list[str], p: Column, g: Column) -> DataFrame:
    """Dice and IoU from sums over cells (null where both are empty)."""
    s = df.groupBy(*group).agg(F.sum(p * g).alias("both"), F.sum(p).alias("sp"), F.sum(g).alias("sg"))
    return s.select(*group, ratio(2 * F.col("both"), F.col("sp") + F.col("sg")).alias("dice"), ratio("both", F.col("sp") + F.col("sg") - F.col("both")).alias("iou"))


def semseg_metrics(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """mIoU, frequency-weighted IoU, mean accuracy and pixel accuracy."""
    c = df.groupBy(F.col(truth).alias("i"), F.col(pred).alias("j")).agg(F.count("*").alias("n"))
    e = c.select(F.explode(F.array(F.struct(F.col("i").alias("cls"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("j").alias("cls"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("tp")))).alias("s"))
    k = e.groupBy("s.cls").agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum("s.tp").alias("tp"))
    iou = F.col("tp") / (F.col("t") + F.col("p") - F.col("tp"))
    return k.agg(F.avg(iou).alias("miou"), (F.sum(iou * F.col("t")) / F.sum("t")).alias("fwiou"), F.avg(ratio("tp", "t")).alias("macc"), (F.sum("tp") / F.sum("t")).alias("pacc"))


def grounding_metrics(df: DataFrame, key: str, p: Column, g: Column, thresholds: list[float]) -> DataFrame:
    """cIoU, mIoU, cDice, mDice and the share of instances at or over each IoU."""
    s = df.groupBy(key).agg(F.sum(p * g).alias("i"), F.sum(p).alias("p"), F.sum(g).alias("g"))
    u = F.col("p") + F.col("g") - F.col("i")
    iou, dice = F.coalesce(ratio("i", u), F.lit(0.0)), F.coalesce(ratio(2 * F.col("i"), F.col("p") + F.col("g")), F.lit(0.0))
    return s.agg((F.sum("i") / F.sum(u)).alias("ciou"), F.avg(iou).alias("miou"), (2 * F.sum("i") / F.sum(F.col("p") + F.col("g"))).alias("cdice"), F.avg(dice).alias("mdice"), *(F.avg((iou >= t).cast("double")).alias(f"p{int(t * 100)}") for t in thresholds))


def box_iou(a: tuple, b: tuple) -> Column:
    """IoU of two boxes, each (x, y, width, height) as columns; 0 where both are empty."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = (tuple(map(col, x)) for x in (a, b))
    across = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    down = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = across * down
    return F.coalesce(ratio(both, aw * ah + bw * bh - both), F.lit(0.0))


def box_metrics(df: DataFrame, a: tuple, b: tuple, thresholds: list[float]) -> DataFrame:
    """Mean IoU of paired boxes, and the share of pairs at or over each IoU."""
    rows = df.select(box_iou(a, b).alias("_iou"))
    return rows.agg(F.avg("_iou").alias("mbiou"), *(F.avg((F.col("_iou") >= t).cast("double")).alias(f"b{int(t * 100)}") for t in thresholds))


def threshold_sweep(df: DataFrame, score: str, truth: Column, steps: int = 101) -> DataFrame:
    """(threshold, dice) over a regular grid in 0..1, from one histogram of scores."""
    b = F.floor(F.col(score) * (steps - 1) + 1e-9).cast("int")
    hist = df.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.sum(truth).alias("t"))
    grid = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("b"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(hist, "b", "left").fillna(0, ["n", "t"]).withColumns({"pp": F.sum("n").over(w), "tp": F.sum("t").over(w)})
    total = hist.agg(F.sum("t").alias("all"))
    return full.crossJoin(F.broadcast(total)).select((F.col("b") / float(steps - 1)).alias("threshold"), F.coalesce(ratio(2 * F.col("tp"), F.col("pp") + F.col("all")), F.lit(0.0)).alias("dice"))


def best_threshold(df: DataFrame, score: str, truth: Column, steps: int = 101) -> DataFrame:
    """The threshold of the best Dice (ties: the lowest)."""
    s = threshold_sweep(df, score, truth, steps)
    return s.agg(F.max(F.struct("dice", (-F.col("threshold")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("threshold"), F.col("b.dice").alias("dice"))


def at_or_over(df: DataFrame, group: list[str], score: str, thresholds: list[float], what: dict[str, Column], least: bool = False) -> DataFrame:
    """(group, threshold, what...): sums (or minima) over the rows of each group with a score at or over each threshold.

    Rows are counted once, into the histogram of the thresholds' intervals; a threshold's value is
    put together from the intervals above it.  Every group has a row for each threshold, those that
    nothing reaches too (sum 0, minimum null).  A null score reaches none.
    """
    cuts = sorted({float(t) for t in thresholds})
    bin_ = F.size(F.filter(F.lit(cuts), lambda t: t <= F.col(score)))
    how = F.min if least else F.sum
    hist = df.groupBy(*group, bin_.alias("_bin")).agg(*(how(c).alias(n) for n, c in what.items()))
    held = hist.groupBy(*group).agg(F.collect_list(F.struct("_bin", *what)).alias("_h"))
    rows = held.select(*group, F.posexplode(F.lit(cuts)).alias("_k", "threshold"), "_h")
    over = F.filter("_h", lambda x: x["_bin"] > F.col("_k"))
    value = lambda n: F.array_min(F.transform(over, lambda x: x[n])) if least else F.aggregate(F.transform(over, lambda x: x[n].cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return rows.select(*group, "threshold", *(value(n).alias(n) for n in what))


def sens_spec_curve(df: DataFrame, thresholds: list[float], score: str = "score", truth: str = "truth") -> DataFrame:
    """Sensitivity and specificity at thresholds (positive: at or over it)."""
    one = lambda t: (F.col(truth) == t).cast("long")
    over = at_or_over(df, [], score, thresholds, {"_pos": one(1), "_neg": one(0)})
    # Scores that compare with nothing are in no negative's favour.
    all_ = df.agg(F.sum(one(1)).alias("_p"), F.sum(one(0)).alias("_n"), F.sum(F.when(F.col(score).isNull(), one(0)).otherwise(0)).alias("_none"))
    out = over.crossJoin(F.broadcast(all_))
    return out.select("threshold", ratio("_pos", "_p").alias("sensitivity"), ratio(F.col("_n") - F.col("_none") - F.col("_neg"), "_n").alias("specificity"))


def quantile_thresholds(df: DataFrame, q: list[float], score: str = "score") -> list[float]:
    """The scores' own quantiles as thresholds, lowest first, each once."""
    at = df.agg(F.percentile(score, F.array(*(F.lit(float(x)) for x in q)))).first()[0]
    return sorted(set(at or []))


def case_rollup(df: DataFrame, case: list[str], scan: str, score: str = "score", truth: str = "truth") -> DataFrame:
    """Scans by their largest score and label, then a case's mean score and largest label, and its scans."""
    return scan_rollup(df, [*case, scan], score, truth).groupBy(*case).agg(F.max("truth").alias("truth"), F.avg("score").alias("score"), F.count("*").alias("scans"))


def scan_rollup(df: DataFrame, scan: list[str], score: str = "score", truth: str = "truth") -> DataFrame:
    return df.groupBy(*scan).agg(F.max(truth).alias("truth"), F.max(score).alias("score"))


def match_objects(overlaps: DataFrame, sizes_p: DataFrame, sizes_g: DataFrame, group: str, t: float, independent: bool = False) -> DataFrame:
    """(group, tp, fp, fn): predictions take their best object by IoU; one prediction an object unless ``independent``.

    overlaps: (group, p, g, both); sizes: (group, p, size_p) and (group, g, size_g).
    """
    o = overlaps.join(sizes_p, [group, "p"]).join(sizes_g, [group, "g"])
    o = o.withColumn("iou", F.col("both") / (F.col("size_p") + F.col("size_g") - F.col("both")))
    best = first_by(o, [group, "p"], F.desc("iou"), F.col("g")).where(F.col("iou") >= t)
    best = best if independent else first_by(best, [group, "g"], F.desc("iou"), F.col("p"))
    n = best.groupBy(group).agg(F.count("*").alias("tp"), F.count_distinct("g").alias("found"))
    totals = sizes_p.groupBy(group).agg(F.count("*").alias("np")).join(sizes_g.groupBy(group).agg(F.count("*").alias("ng")), group, "full_outer").join(n, group, "left").fillna(0)
    return totals.select(group, "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("found")).alias("fn"))


def lesion_curve(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, fp, tp): false detections and distinct lesions at or over each threshold.

    A lesion counts from its best detection down, so each is one score, and each detection that
    hits none is another: two histograms, no row is repeated for a threshold.
    """
    first = df.where(F.col("lesion").isNotNull()).groupBy("lesion").agg(F.max("score").alias("score")).select("score", F.lit(1).alias("_tp"), F.lit(0).alias("_fp"))
    wrong = df.where(F.col("lesion").isNull()).select("score", F.lit(0).alias("_tp"), F.lit(1).alias("_fp"))
    # A table without detections still has its thresholds.
    none = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("score"), F.lit(0).alias("_tp"), F.lit(0).alias("_fp"))
    return at_or_over(first.unionByName(wrong).unionByName(none), [], "score", thresholds, {"fp": F.col("_fp"), "tp": F.col("_tp")})


def froc(df: DataFrame, thresholds: list[float], scans: int, lesions: int) -> DataFrame:
    """Detections (score, hit lesion or null) -> false positives a scan and sensitivity, at every threshold."""
    return lesion_curve(df, thresholds).select("threshold", (F.col("fp") / scans).alias("fp_per_scan"), (F.col("tp") / lesions).alias("sensitivity"))


def lesion_pr(df: DataFrame, thresholds: list[float], lesions: int) -> DataFrame:
    """(threshold, precision, recall) of detections (score, hit lesion or null): found lesions against them and the false ones.

    A threshold that no detection reaches has precision 1 and recall 0.
    """
    return lesion_curve(df, thresholds).select("threshold", F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"), (F.col("tp") / lesions).alias("recall"))


def volumes(df: DataFrame, group: list[str], p: str, voxel: float) -> DataFrame:
    return df.groupBy(*group).agg((F.sum(p) * voxel).alias("volume"))


def propagate_max(df: DataFrame, case: str, label: str, negative: Column) -> DataFrame:
    """The case's largest label on all its rows; a negative case without labels gets 0."""
    w = Window.partitionBy(case)
    return df.withColumn("case_label", F.coalesce(F.max(label).over(w), F.when(negative, 0))).withColumn("labelled", F.count(label).over(w))


def join_labels(a: DataFrame, b: DataFrame, key: str, allowed: list) -> DataFrame:
    """(key, problem): keys of ``a`` whose label in ``b`` is missing, double or out of range."""
    n = b.groupBy(key).agg(F.count("*").alias("n"), F.min("label").alias("label"))
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "double").when(~F.col("label").isin(allowed), "range")
    return a.select(key).distinct().join(n, key, "left").select(key, kind.alias("problem")).where("problem is not null")


def recall_table(df: DataFrame, group: list[str], inner: str, thresholds: list[float]) -> DataFrame:
    """Recall of each inner unit at thresholds, then its median and quartiles by group."""
    n = df.where(F.col("score").isNotNull()).groupBy(*group, inner).agg(F.count("*").alias("_all"))
    over = at_or_over(df, [*group, inner], "score", thresholds, {"_n": F.lit(1)})
    r = over.join(n, [*group, inner], "left").withColumn("recall", F.col("_n") / F.col("_all"))
    return r.groupBy(*group, "threshold").agg(F.count("*").alias("units"), *(F.percentile("recall", F.lit(q)).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))


def noc(clicks: DataFrame, item: str, thresholds: list[float], cap: int) -> DataFrame:
    """First click to reach an IoU, else the cap."""
    over = at_or_over(clicks, [item], "iou", thresholds, {"_c": F.col("click")}, least=True)
    return over.select(item, "threshold", F.coalesce("_c", F.lit(cap)).alias("clicks"))


def mutual_nearest(pairs: DataFrame, a: str, b: str, d: str) -> DataFrame:
    """Pairs that are each other's nearest."""
    x = first_by(pairs, [a], F.col(d), F.col(b)).select(a, b, d)
    y = first_by(pairs, [b], F.col(d), F.col(a)).select(a, b)
    return x.join(y, [a, b], "left_semi")


def detection_f1(matched: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn and f1 of one-to-one matched detections: tp / (tp + fp / 2 + fn / 2)."""
    n = matched.agg(F.count("*").alias("tp")).crossJoin(pred.agg(F.count("*").alias("_p"))).crossJoin(truth.agg(F.count("*").alias("_t")))
    n = n.select("tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_t") - F.col("tp")).alias("fn"))
    return n.withColumn("f1", F.coalesce(ratio("tp", F.col("tp") + (F.col("fp") + F.col("fn")) / 2), F.lit(0.0)))


def topj_pool(df: DataFrame, slide: str, js: list[int]) -> DataFrame:
    """Mean of the best j scores of a class, then the best class (ties: the smaller)."""
    w = Window.partitionBy(slide, "cls").orderBy(F.desc("score"))
    r = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(js)).withColumn("j", F.explode(F.array(*map(F.lit, js)))).where("_r <= j")
    return first_by(r.groupBy(slide, "j", "cls").agg(F.avg("score").alias("score")), [slide, "j"], F.desc("score"), F.col("cls"))


def resolve_classes(cells: DataFrame, image: str, cell: list[str], share: float) -> DataFrame:
    """Cells with a score over 0.5: the best class; classes of under ``share`` of the image's cells go unless most confident there.

    Confidence is the mean score, summed exactly and taken to nine digits: classes of equal means all stay.
    """
    live = cells.where("score > 0.5")
    cls = live.groupBy(image, "cls").agg(F.count("*").alias("area"), F.round(exact_mean("score"), 9).alias("mean"))
    w = Window.partitionBy(image)
    ok = cls.withColumn("keep", (F.col("area") >= share * F.sum("area").over(w)) | (F.col("mean") == F.max("mean").over(w))).where("keep").select(image, "cls")
    return first_by(live.join(ok, [image, "cls"], "left_semi"), [image, *cell], F.desc("score"), F.col("cls"))


# --- text answers -----------------------------------------------------------------------


def tokens(c) -> Column:
    """Lower-case words without punctuation and articles."""
    return F.filter(F.split(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}\s]", ""), r"\s+"), lambda w: (w != "") & ~w.isin("a", "an", "the"))


def shared(a, b) -> Column:
    """How many words two arrays share, repeats counted; their words pass in order, first those of ``a`` of each."""
    side = lambda c, n: F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda w: F.struct(w.alias("w"), F.lit(n).alias("of")))

    def step(s: Column, x: Column) -> Column:
        same = s["w"] == x["w"]
        met = (x["of"] == 1) & same & (s["left"] > 0)
        left = F.when(met, s["left"] - 1).when(x["of"] == 0, F.when(same, s["left"] + 1).otherwise(1)).otherwise(0)
        return F.struct(x["w"].alias("w"), left.alias("left"), (s["n"] + met.cast("int")).alias("n"))

    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("left"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(F.concat(side(a, 0), side(b, 1))), start, step, lambda s: s["n"])


def with_scores(df: DataFrame) -> DataFrame:
    """df with exact match, token precision, recall and F1 of the words ``_a`` and ``_t``, worked out in the row."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    part = lambda n, of: F.coalesce(ratio(n, of), F.lit(0.0))
    both = F.col("_both")
    exact = (F.array_join("_a", " ") == F.array_join("_t", " ")).cast("int")
    scores = {"exact": exact, "precision": part(both, size("_a")), "recall": part(both, size("_t")), "f1": part(2 * both, size("_a") + size("_t"))}
    return df.withColumn("_both", shared("_a", "_t")).withColumns(scores)


def answer_scores(df: DataFrame, key: str, answer: str, truth: str) -> DataFrame:
    """Exact match, token precision, recall and F1 over multisets of words."""
    return with_scores(df.select(key, tokens(answer).alias("_a"), tokens(truth).alias("_t"))).select(key, "exact", "precision", "recall", "f1")


def with_bleu(df: DataFrame, n: int) -> DataFrame:
    """df with the BLEU of the words ``_a`` against ``_t``, worked out in the row."""
    grams = lambda c, k: F.when(F.size(c) >= k, F.transform(F.sequence(F.lit(1), F.size(c) - k + 1), lambda i: F.array_join(F.slice(c, i, F.lit(k)), " ")))
    out = df.withColumns({f"_m{k}": shared(grams("_a", k), grams("_t", k)) for k in range(1, n + 1)})
    every = reduce(and_, (F.col(f"_m{k}") > 0 for k in range(1, n + 1)))
    logs = sum(F.log(F.col(f"_m{k}") / (F.size("_a") - k + 1)) for k in range(1, n + 1))
    short = F.when(F.size("_a") >= F.size("_t"), 1.0).otherwise(F.exp(1 - F.size("_t") / F.size("_a")))
    return out.withColumn("bleu", F.when(every, short * F.exp(logs / n)).otherwise(0.0))


def bleu(df: DataFrame, key: str, answer: str, truth: str, n: int = 4) -> DataFrame:
    """BLEU of one reference with clipped n-gram counts and the brevity penalty; 0 without matches."""
    return with_bleu(df.select(key, tokens(answer).alias("_a"), tokens(truth).alias("_t")), n).select(key, "bleu")


def best_candidates(answers: DataFrame, key: str, answer: str, candidates: DataFrame, cand: str, text: str) -> DataFrame:
    """(key, cand): for each answer the candidate that shares the most distinct words with it (ties: the first).

    Answers become sets of the numbers of words that candidates have, rarest first, equal sets
    once.  Round by round the next words of a set meet the candidates that have them, as narrow
    rows that add up to shared words so far; with m words left no candidate not met shares more
    than m, and one met only m more.  Candidates that can't win any more are dropped, and a set is
    done when one is left that no candidate not met can reach.  A set's last, most common word
    isn't joined with all its candidates: those still in are asked for it, and of the others only
    the first can win, which the word's own row names.  Words that every candidate has decide
    nothing and are left out.
    """
    spark = answers.sparkSession
    own = materialize(candidates.select(F.col(cand).alias("c"), F.array_distinct(tokens(text)).alias("cw")))
    total = own.agg(F.count("*").alias("nc"), F.min("c").alias("least"))
    posts = own.select("c", F.explode("cw").alias("w")).distinct()
    word = posts.groupBy("w").agg(F.count("*").alias("n"), F.min("c").alias("first"))
    word = materialize(word.withColumn("i", F.monotonically_increasing_id()))
    posts = materialize(posts.join(word, "w").select("i", "c"))
    said = answers.select(F.col(key).alias("k"), F.explode(F.array_distinct(tokens(answer))).alias("w")).join(word, "w").crossJoin(F.broadcast(total))
    common = F.col("n") == F.col("nc")
    sets = said.groupBy("k").agg(F.array_sort(F.collect_list(F.when(~common, F.struct("n", "i", "first")))).alias("s"), F.min(F.when(common, F.col("least"))).alias("any"))
    sets = materialize(sets.select("k", "any", F.transform("s", lambda x: x["i"]).alias("ws"), F.get("s", F.size("s") - 1)["first"].alias("first")))
    todo = materialize(sets.where(F.size("ws") > 0).select("ws", "first").distinct().withColumn("id", F.monotonically_increasing_id()))
    ids, live = todo.select("ws", "id"), todo.select("id", "ws", F.size("ws").alias("m"), "first")
    hits = spark.createDataFrame([], f"id long, c {own.schema['c'].dataType.simpleString()}, h long")
    done, probed, step = [], 0, 4
    while not live.isEmpty():
        probe = live.select("id", F.explode(F.slice("ws", F.lit(probed + 1), F.greatest(F.least(F.lit(step), F.col("m") - 1 - probed), F.lit(0)))).alias("i"))
        met = probe.join(posts, "i").groupBy("id", "c").agg(F.count("*").alias("h"))
        probed, step = probed + step, 4 * step
        met = materialize(met.unionByName(hits).groupBy("id", "c").agg(F.sum("h").alias("h")))
        best = met.groupBy("id").agg(F.max("h").alias("top"))
        rest = F.greatest(F.col("m") - probed, F.lit(1))  # words of the set not yet probed, its last among them
        still = met.join(live.select("id", rest.alias("rest"), F.element_at("ws", -1).alias("last")).join(best, "id"), "id").where(F.col("h") + F.col("rest") >= F.col("top"))
        met = materialize(still.select("id", "c", "h", "top", "rest", "last"))
        n = met.groupBy("id").agg(F.count("*").alias("left"), F.first("top").alias("top"))
        now = live.join(n, "id", "left").withColumn("settled", (F.col("m") - 1 <= probed) | (F.coalesce("left", F.lit(0)) == 1) & (F.col("top") > rest))
        now = materialize(now.select("id", "ws", "m", "first", "settled"))
        out = met.join(now.where("settled").select("id"), "id", "left_semi")
        # One of several that are still in can be ahead by the last word alone.
        last = out.join(posts.select(F.col("i").alias("last"), "c", F.lit(1).alias("one")), ["last", "c"], "left")
        ends = last.select("id", F.struct((-F.col("h") - F.coalesce("one", F.lit(0))).alias("o"), "c").alias("b"))
        own_last = now.where("settled").select("id", F.struct(F.lit(-1).cast("long").alias("o"), F.col("first").alias("c")).alias("b"))
        done.append(materialize(ends.unionByName(own_last).groupBy("id").agg(F.min("b").alias("b")).select("id", "b.c")))
        live = now.where("not settled").select("id", "ws", "m", "first")
        hits = met.join(live.select("id"), "id", "left_semi").select("id", "c", "h")
    out = spark.createDataFrame([], sets.select("k", F.col("any").alias("c")).schema)
    for part in done:
        out = out.unionByName(sets.join(ids.join(part, "id"), "ws").select("k", "c"))
    out = out.unionByName(sets.where((F.size("ws") == 0) & F.col("any").isNotNull()).select("k", F.col("any").alias("c")))
    return out.select(F.col("k").alias(key), F.col("c").alias(cand))


def vqa_accuracy(df: DataFrame, key: str, answer: str, truth: str, candidates: DataFrame, cand: str, text: str, group: list[str]) -> DataFrame:
    """Closed questions: the candidate of ``best_candidates`` is the choice; an answer that shares no word with any is wrong."""
    choice = best_candidates(df, key, answer, candidates, cand, text).select(key, F.col(cand).alias("_c"))
    hit = F.coalesce((F.col("_c") == F.col(truth)).cast("double"), F.lit(0.0))
    return df.join(choice, key, "left").groupBy(*group).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


#: Buckets of words that are counted, and sent to every task, where candidates are filed.
BUCKETS = 2**20


def word_bits(words) -> Column:
    """248 bits of a set of words in four numbers: those of a set hold the bits of every set inside it."""
    at = F.transform(col(words), lambda w: F.pmod(F.xxhash64(w), F.lit(248)))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (b % 62).cast("int"))
    part = lambda at, i: F.aggregate(at, F.lit(0).cast("long"), lambda s, b: F.when(F.floor(b / 62) == i, s.bitwiseOR(one(b))).otherwise(s))
    return F.transform(F.array(at), lambda at: F.array(*(part(at, i) for i in range(4))))[0]


def held_candidates(answers: DataFrame, key: str, answer: str, candidates: DataFrame, text: str, least: Column | None = None) -> DataFrame:
    """(key, text, n): candidate texts, normalised, whose n distinct words all stand in the answer.

    ``least``: only candidates of so many words or more.

    A candidate is filed under one of its words that few answers have, by the words' counts in
    ``BUCKETS`` buckets, and meets those answers only; one with a word in an empty bucket meets
    none.  They meet by the bits of their words, so that neither texts nor answers are copied for
    each of their words; whole sets confirm those that pass.
    """
    words = F.array_distinct(F.split("text", " "))
    said = answers.select(key, F.array_distinct(tokens(answer)).alias("_aw"), (F.lit(0) if least is None else least).alias("_least"))
    bucket, bit = F.pmod(F.xxhash64("_w"), F.lit(BUCKETS)).alias("_b"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash("_w"), F.lit(64)))
    count = said.select(F.explode("_aw").alias("_w")).groupBy(bucket).agg(F.count("*").alias("_f"))
    own = candidates.select(F.array_join(tokens(text), " ").alias("text")).distinct().where("text <> ''")
    # The least count and the word's place in one number: plain minima by text need no sort and no second shuffle.
    rare = F.min(F.shiftleft(F.least("_f", F.lit(2**38)), 24) + F.col("pos")).alias("_r")
    filed = own.select("text", F.posexplode(words).alias("pos", "_w")).withColumn("_b", bucket).join(F.broadcast(count), "_b").groupBy("text").agg(F.count("*").alias("n"), rare)
    filed = filed.where(F.col("n") == F.size(words)).select("text", "n", F.get(words, F.col("_r").bitwiseAND(2**24 - 1).cast("int")).alias("_w"), word_bits(words).alias("_cb"))
    filed = materialize(filed)
    used = filed.groupBy(bucket).agg(F.bit_or(bit).alias("_used"))
    one = said.select(key, "_least", "_aw", word_bits("_aw").alias("_ab")).select(key, "_least", "_ab", F.explode("_aw").alias("_w"))
    one = one.withColumn("_b", bucket).join(F.broadcast(used), "_b").where(F.col("_used").bitwiseAND(bit) != 0).select(key, "_least", "_ab", "_w")
    inside = reduce(and_, (F.col("_cb")[i].bitwiseAND(F.col("_ab")[i]) == F.col("_cb")[i] for i in range(4)), F.col("n") >= F.col("_least"))
    passed = one.join(filed, "_w").where(inside).select(key, "text", "n")
    met = passed.join(said.select(key, "_aw"), key).where(F.size(F.array_except(words, "_aw")) == 0)
    return met.select(key, "text", F.col("n").cast("int").alias("n"))


def open_accuracy(df: DataFrame, key: str, answer: str, truth: str, candidates: DataFrame, text: str, group: list[str], n: int = 4) -> DataFrame:
    """Open questions by group: exact matches, mean token precision, recall and F1, mean BLEU, and ``hit``.

    A hit is an answer that holds the truth and no other candidate longer than it: of the
    candidate texts whose words all stand in the answer, the one of most words is the truth.
    So only answers that hold their truth meet candidates, of its number of words or more.
    """
    rows = df.select(key, *group, answer, tokens(answer).alias("_a"), tokens(truth).alias("_t"))
    holds = (F.size("_t") > 0) & (F.size(F.array_except("_t", "_a")) == 0)
    asked = materialize(rows.where(holds).select(key, *group, answer, F.array_join("_t", " ").alias("_truth"), F.size(F.array_distinct("_t")).alias("_n")))
    held = held_candidates(asked, key, answer, candidates, text, F.col("_n"))
    most = first_by(held, [key], F.desc("n"), F.col("text")).select(key, F.col("text").alias("_best"))
    hits = asked.join(most, key).where("_best = _truth").select(*group, F.lit(0).alias("_one"), F.lit(1).alias("_hit"))
    scores = ("exact", "precision", "recall", "f1", "bleu")
    every = with_bleu(with_scores(rows), n).select(*group, *scores, F.lit(1).alias("_one"), F.lit(0).alias("_hit"))
    means = [F.avg(c).alias(c) for c in scores]
    return every.unionByName(hits, allowMissingColumns=True).groupBy(*group).agg(F.sum("_one").alias("n"), *means, (F.sum("_hit") / F.sum("_one")).alias("hit"))
