"""Neighbourhoods and graphs as node and edge tables."""

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.prims import corr, dot, elements, forget, gather, h, l2, materialize, prefix

from .annotations import near_pairs


#: Rows of a block of an index's cell.
BLOCK = 2048
#: Rows of the largest block: two of them, as matrices, fit a task's memory many times over.
LARGEST = 65_536
#: Blocks of a table before these grow: their pairs are dealt to the square of it in tasks.
BLOCKS = 12
#: Rows and columns of the products that a task works out at a time.
TILE = 1024, 4096
#: Parts of a bracket in the search for a median, and the most values that come back one by one.
BINS = 65_536


def numbered(df: DataFrame, key: str, name: str, rows: int = 1024) -> tuple[DataFrame, int]:
    """df with a block number by its key's hash, and how many blocks there are.

    A row is sent once for each block of the other side: from ``BLOCKS`` of ``rows`` rows on it is
    the blocks that grow with the table, not their number, up to ``LARGEST`` rows each.
    """
    n = df.count()
    n = max(1, min(-(-n // rows), BLOCKS), -(-n // LARGEST))
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def met_blocks(a: DataFrame, b: DataFrame, na: int, nb: int, run, schema: str, once: bool = False) -> DataFrame:
    """Every block of ``a`` (column _a) with every block of ``b`` (column _b), a task each, as matrices.

    Rows are sent once for each block of the other side; products stay inside the tasks.  ``once``:
    of two blocks of one table only the pair with _a <= _b.
    """
    every = lambda lo, hi: F.explode(F.sequence(lo, hi))
    left = a.withColumn("_b", every(F.col("_a") if once else F.lit(0), F.lit(nb - 1)))
    right = b.withColumn("_a", every(F.lit(0), F.col("_b") if once else F.lit(na - 1)))
    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(run, schema)


def tiles(n: int, size: int):
    return (slice(at, at + size) for at in range(0, n, size))


def block_best(left: pd.DataFrame, right: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The k best (q, r, similarity) of each query (q, v) among references (r, v), as matrix products.

    References come in order of r, a tile at a time: after a query has k, only those above its
    least one can still change them, as of equal ones the first r stay.
    """
    if not len(left) or not len(right):
        return pd.DataFrame({"q": left.q[:0], "r": right.r[:0], "similarity": np.zeros(0)})
    right = right.sort_values("r", kind="stable")
    ids, others, x, y = left.q.to_numpy(), right.r.to_numpy(), np.stack(left.v), np.stack(right.v)
    out = []
    for a in tiles(len(x), TILE[0]):
        mine = ids[a]
        least = np.full(len(mine), -np.inf)
        i, j, best = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for b in tiles(len(y), TILE[1]):
            s = x[a] @ y[b].T
            if not same:
                lo, hi = np.searchsorted(others[b], mine), np.searchsorted(others[b], mine, "right")
                for row in np.flatnonzero(lo < hi):
                    s[row, lo[row] : hi[row]] = -np.inf
            # Rounded similarities decide, so what is within a rounding of the k-th stays.
            if b.start == 0 and s.shape[1] > k:
                new_i, new_j = np.nonzero((s >= np.partition(s, s.shape[1] - k, axis=1)[:, -k, None] - 1e-9) & (s > -np.inf))
            else:
                new_i, new_j = np.nonzero(s > least[:, None])
            if not len(new_i):
                continue
            i, j, best = np.append(i, new_i), np.append(j, new_j + b.start), np.append(best, np.round(s[new_i, new_j], 9))
            order = np.lexsort((j, -best, i))
            i, j, best = i[order], j[order], best[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, best, place = (z[place < k] for z in (i, j, best, place))
            least[i[place == k - 1]] = best[place == k - 1]
        out.append(pd.DataFrame({"q": mine[i], "r": others[j], "similarity": best}))
    return pd.concat(out)


def placed(best: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of all blocks: (key, neighbour, similarity, place)."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "r"))
    return best.withColumn("place", place).where(F.col("place") <= k).select(F.col("q").alias(key), F.col("r").alias("neighbour"), "similarity", "place")


def knn(query: DataFrame, ref: DataFrame, key: str, vector: str, k: int, same: bool = False, unit: bool = False) -> DataFrame:
    """Exact cosine top k: (key, neighbour, similarity, place); equal similarities by neighbour.

    ``same``: a row may be its own neighbour.  ``unit``: vectors are taken as they are.

    Blocks of queries meet blocks of references as matrices; a pair of blocks sends on the k
    best of each query, and these are put together.
    """
    v = F.col(vector) if unit else l2(vector)
    q, nq = numbered(query.select(F.col(key).alias("q"), v.alias("v")), "q", "_a")
    r, nr = numbered(ref.select(F.col(key).alias("r"), v.alias("v")), "r", "_b")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return block_best(left, right, k, same)

    kind = query.schema[key].dataType.simpleString()
    best = met_blocks(q, r, nq, nr, run, f"q {kind}, r {kind}, similarity double")
    return placed(best, key, k)


def knn_distance(nn: DataFrame, key: str) -> DataFrame:
    return nn.groupBy(key).agg(F.avg(1 - F.col("similarity")).alias("distance"))


def percentile_of(values: DataFrame, ref: DataFrame, value: str, centred: bool = False, mid: bool = False) -> DataFrame:
    """Share of reference values at or under each value; ``centred``: (p - 0.5) * sqrt(12).

    ``mid``: half a rank less, and kept half a rank away from 0 and 1, for transformations that need it.
    """
    both = values.select(value, F.lit(0).alias("_r")).unionByName(ref.select(value, F.lit(1).alias("_r")))
    n = prefix(both, [], value, {"_c": F.col("_r")}).select(value, "_c_upto").crossJoin(F.broadcast(ref.agg(F.count("*").alias("_n"))))
    share = F.col("_c_upto") / F.col("_n")
    if mid:
        half = 0.5 / F.col("_n")
        share = F.least(F.greatest(share - half, half), 1 - half)
    out = values.join(n.select(value, share.alias("percentile")), value)
    return out.withColumn("percentile", (F.col("percentile") - 0.5) * F.sqrt(F.lit(12.0))) if centred else out


def hubness(nn: DataFrame) -> DataFrame:
    """How often a row is a neighbour."""
    return nn.groupBy("neighbour").agg(F.count("*").alias("times"))


def neighbour_diagnostics(nn: DataFrame, ref: DataFrame, key: str, vector: str, eps: float = 1e-8) -> DataFrame:
    """One row: spread of the mean neighbour distances, (q95 - q05) / q50 as their concentration, how
    often rows are neighbours (0 counts), and reference rows without a direction."""
    nn = materialize(nn)  # read twice
    d = knn_distance(nn, key)
    q = d.agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("sd"), *(F.percentile("distance", F.lit(x)).alias(n) for x, n in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))))
    often = ref.select(F.col(key).alias("neighbour")).join(hubness(nn), "neighbour", "left").agg(F.percentile(F.coalesce("times", F.lit(0)), F.lit(0.5)).alias("median_times"), F.max("times").alias("max_times"))
    none = ref.agg(F.count("*").alias("n"), F.count_if(F.sqrt(dot(vector, vector)) <= eps).alias("zero_norms"))
    one = q.crossJoin(often).crossJoin(none)
    return one.withColumn("concentration", (F.col("q95") - F.col("q05")) / F.greatest(F.abs("q50"), F.lit(eps)))


def recalls(nn: DataFrame, query: DataFrame, ref: DataFrame, key: str, label: str, ks: list[int]) -> DataFrame:
    """Share of queries with a neighbour of their own label among the first k."""
    j = nn.join(query.select(key, label), key).join(ref.select(F.col(key).alias("neighbour"), F.col(label).alias("_l")), "neighbour")
    hit = F.col(label) == F.col("_l")
    best = j.groupBy(key).agg(F.min(F.when(hit, F.col("place"))).alias("_first"))
    return best.agg(*(F.avg((F.coalesce("_first", F.lit(1 << 30)) <= k).cast("double")).alias(f"r{k}") for k in ks))


def retrieval(images: DataFrame, texts: DataFrame, key: str, vector: str, label: str, ks: list[int], second: str | None = None) -> DataFrame:
    """Recall in both directions: tr (texts for an image), ir (images for a text), and ``irtr``, the sum at the first k.

    ``second``: another vector of the images; the mean of both cosines then ranks.  As a cosine
    is linear in the unit vector, that is the product with the mean of the two unit vectors.
    """
    unit = l2(vector)
    if second:
        unit = F.transform(F.zip_with(l2(vector), l2(second), lambda x, y: (x + y) / 2), lambda x: x)
    i, t = images.select(key, label, unit.alias("_v")), texts.select(key, label, l2(vector).alias("_v"))
    tr = recalls(knn(i, t, key, "_v", max(ks), same=True, unit=True), i, t, key, label, ks)
    ir = recalls(knn(t, i, key, "_v", max(ks), same=True, unit=True), t, i, key, label, ks)
    both = tr.select(*(F.col(f"r{k}").alias(f"tr{k}") for k in ks)).crossJoin(ir.select(*(F.col(f"r{k}").alias(f"ir{k}") for k in ks)))
    return both.withColumn("irtr", F.col(f"tr{ks[0]}") + F.col(f"ir{ks[0]}"))


def radius_edges(points: DataFrame, radius: float, lambda_d: float, lambda_f: float) -> DataFrame:
    """(src, dst, weight): 1 - exp(-lf * f) * exp(-ld * d) for pairs within a radius; f: feature distance."""
    p = near_pairs(points.select("key", "cx", "cy", "features"), radius)
    d = F.sqrt((F.col("cx") - F.col("n_cx")) ** 2 + (F.col("cy") - F.col("n_cy")) ** 2)
    diff = F.zip_with("features", "n_features", lambda a, b: a - b)
    return p.select(F.least("key", "n_key").alias("src"), F.greatest("key", "n_key").alias("dst"), (1 - F.exp(-lambda_f * F.sqrt(dot(diff, diff))) * F.exp(-lambda_d * d)).alias("weight"))


def cluster_nodes(points: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean features and rounded centroids of clusters."""
    m = gather(elements(points, [cluster], vector, {"v": "mean"}), [cluster], "v", "features")
    return m.join(points.groupBy(cluster).agg(F.round(F.avg("cx")).alias("cx"), F.round(F.avg("cy")).alias("cy")), cluster)


def edges_above(pairs: DataFrame, t: float) -> DataFrame:
    return pairs.where(F.col("weight") > t).select("src", "dst")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, each once.  Edges go from the lower degree up, so no hub's pairs are formed."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    deg = e.select("u").union(e.select("v")).groupBy("u").agg(F.count("*").alias("d"))
    o = e.join(deg.withColumnRenamed("d", "du"), "u").join(deg.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    o = o.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("y"))
    two = o.select("x", F.col("y").alias("p")).join(o.select("x", F.col("y").alias("q")), "x").where("p < q")
    closed = two.join(e.select(F.col("u").alias("p"), F.col("v").alias("q")), ["p", "q"], "left_semi")
    s = F.array_sort(F.array("x", "p", "q"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def subgraph(nodes: DataFrame, edges: DataFrame, lo: int, hi: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of a class range and the edges among them; nothing for fewer than two nodes or no edge."""
    n = nodes.where(F.col("cls").between(lo, hi))
    e = edges.join(n.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_semi").join(n.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_semi")
    ok = n.groupBy("graph_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("graph_id").join(e.select("graph_id").distinct(), "graph_id", "left_semi")
    return n.join(ok, "graph_id", "left_semi"), e.join(ok, "graph_id", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select("graph_id", "src").union(edges.select("graph_id", F.col("dst").alias("src")))
    return both.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, mean degree and degree assortativity (null where degrees don't vary)."""
    deg = degrees(edges)
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("nodes")).join(edges.groupBy("graph_id").agg(F.count("*").alias("edges")), "graph_id", "left").fillna(0)
    sym = edges.select("graph_id", "src", "dst").union(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = sym.join(deg.select("graph_id", F.col("node_id").alias("src"), F.col("degree").alias("ds")), ["graph_id", "src"]).join(deg.select("graph_id", F.col("node_id").alias("dst"), F.col("degree").alias("dd")), ["graph_id", "dst"])
    a = e.groupBy("graph_id").agg(F.avg("dd").alias("neighbour_degree"), corr("ds", "dd").alias("assortativity"))
    return n.join(a, "graph_id", "left")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): least id reachable, by large-star and small-star rounds of aggregations."""
    now = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        small = materialize(small.where("u <> v").distinct())
        forget(now, large)
        now = small
        # Done when all are stars: nobody has two parents, and no parent has one.
        roles = now.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(now.select("v", F.lit(0), F.lit(1)))
        if roles.groupBy("id").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or child = 1 and parent = 1").isEmpty():
            break
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
    if nodes is None:
        return out
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def voxel_components(voxels: DataFrame, reach: int = 1, min_size: int = 1, largest: int | None = None) -> DataFrame:
    """(scan, x, y) set cells -> component sizes by scan; neighbours within ``reach`` cells, by equi-joins on shifted cells."""
    v = voxels.select("scan", "x", "y").distinct().withColumn("id", F.xxhash64("scan", "x", "y"))
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (a, b) > (0, 0)]
    to = F.explode(F.array(*(F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in steps)))
    e = v.select("scan", F.col("id").alias("src"), to.alias("t")).select("scan", "src", "t.x", "t.y").join(v.select("scan", "x", "y", F.col("id").alias("dst")), ["scan", "x", "y"]).select("src", "dst")
    c = v.join(components(e, v), "id")
    size = c.groupBy("scan", "component").agg(F.count("*").alias("size"), F.min(F.struct("x", "y")).alias("first")).where(F.col("size") >= min_size)
    if largest:
        w = Window.partitionBy("scan").orderBy(F.desc("size"), "first")
        size = size.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= largest).drop("_r")
    return size.select("scan", F.col("first.x").alias("x"), F.col("first.y").alias("y"), "size")


def msf(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest (src, dst, weight) by contraction; equal weights go by their ends.

    Each round every node takes its least edge, the groups so joined become the nodes of the next
    round, and of the edges between two groups only the least stays.  At least half of the nodes
    with edges go in a round, so the graph shrinks until nothing is left of it.
    """
    named = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    own = named.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    live = materialize(own.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("weight", "src", "dst").alias("e")))
    taken = []
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("n"), "e", "a", "b").unionByName(live.select(F.col("b").alias("n"), "e", "a", "b"))
        best = materialize(ends.groupBy("n").agg(F.min_by(F.struct("e", "a", "b"), "e").alias("x")).select("x.e", "x.a", "x.b").distinct())
        taken.append(best)
        group = materialize(components(best.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        at = lambda end: group.select(F.col("id").alias(end), F.col("component").alias(f"_{end}"))  # noqa: B023, E731
        moved = live.join(at("a"), "a").join(at("b"), "b").where("_a <> _b")
        least = moved.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("e").alias("e"))
        before, live = live, materialize(least)
        forget(before, group)
    out = live.select("e.*")
    for best in taken:
        out = out.unionByName(best.select("e.*"))
    return out.select("src", "dst", "weight")


def degree_histogram(edges: DataFrame, bins: int) -> DataFrame:
    """(graph_id, bin, share) of node degrees, the last bin open."""
    d = degrees(edges).groupBy("graph_id", F.least(F.col("degree"), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("graph_id"))).drop("n")


def clustering_histogram(edges: DataFrame, bins: int) -> DataFrame:
    """(graph_id, bin, share) of nodes by local clustering coefficient (closed pairs of neighbours), in equal bins of 0..1."""
    e = edges.where("src <> dst").select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    at = lambda c: F.struct("graph_id", F.col(c).alias("node_id"))
    closed = triangles(e.select(at("src").alias("src"), at("dst").alias("dst"))).select(F.explode(F.array("a", "b", "c")).alias("n"))
    closed = closed.groupBy("n.graph_id", "n.node_id").agg(F.count("*").alias("closed"))
    d = degrees(e).join(closed, ["graph_id", "node_id"], "left")
    c = F.when(F.col("degree") > 1, 2 * F.coalesce("closed", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    n = d.groupBy("graph_id", F.least(F.floor(c * bins).cast("int"), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("graph_id"))).drop("n")


def graph_mmd(hist: DataFrame, side: DataFrame, bins: int, sigma: float) -> DataFrame:
    """Discrepancy of two sets of graphs under a Gaussian of total variation; side: (graph_id, side 0/1).

    The pair table is of graphs, by intent: two stated sets of them, met in blocks.
    """
    v = hist.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "share"))).alias("m")).join(side, "graph_id")
    v = v.select("graph_id", "side", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b.cast("long")), F.lit(0.0))).alias("h"))

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        tv = sum(np.abs(a[:, i, None] - b[None, :, i]) for i in range(a.shape[1])) / 2
        return np.exp(-(tv**2) / (2 * sigma * sigma))

    return _mmd(v, "graph_id", kernel)


def _mmd(v: DataFrame, key: str, kernel) -> DataFrame:
    """Mean kernel inside both sides less twice that across; blocks meet as matrices and send on their sums.

    The kernel is symmetric, so two blocks meet once.
    """
    one = lambda: v.select(F.col(key).alias("_k"), F.col("side").cast("int").alias("side"), F.col("h").alias("h"))
    (a, n), (b, _) = numbered(one(), "_k", "_a"), numbered(one(), "_k", "_b")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        twice = len(left) and len(right) and left["_a"].iloc[0] != left["_b"].iloc[0]
        for (i, x), (j, y) in product(left.groupby("side"), right.groupby("side")):
            x, y = np.stack(x.h).astype(float), np.stack(y.h).astype(float)
            total = sum(float(kernel(x[p], y[q]).sum()) for p in tiles(len(x), TILE[0]) for q in tiles(len(y), TILE[1]))
            rows += [(i, j, total, len(x) * len(y)), (j, i, total, len(x) * len(y))][: 1 + twice]
        return pd.DataFrame(rows, columns=["i", "j", "k", "n"])

    k = met_blocks(a, b, n, n, run, "i int, j int, k double, n long", once=True).groupBy("i", "j").agg((F.sum("k") / F.sum("n")).alias("k"))
    return k.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("k")).otherwise(-F.col("k"))).alias("mmd2"))


def median_distance(a: DataFrame, key: str, side: str, vector: str) -> float:
    """Median distance between vectors of the two sides, over all their pairs; of two middle ones the mean.

    Blocks of the sides meet in rounds.  A round counts the squared distances below a bracket and in each of
    ``BINS`` parts of it, with the least and the most there: the part with the middle rank is the next bracket.
    With ``BINS`` or fewer left, each value is its own part.  A round goes by its own counts alone.
    """
    rows = a.select(F.col(key).alias("_k"), F.col(side).cast("int").alias("side"), F.col(vector).alias("h"))
    size = rows.where("side in (0, 1)").groupBy("side").agg(F.count("*").alias("n"), F.sqrt(F.max(dot("h", "h"))).alias("norm")).collect()
    if len(size) < 2:
        return 1.0
    n, most = size[0].n * size[1].n, (size[0].norm + size[1].norm) ** 2 * (1 + 1e-9)
    if not np.isfinite(most) or not most:
        return most * 0.0
    (x, nx), (y, ny) = (numbered(rows.where(F.col("side") == i).drop("side"), "_k", name) for i, name in ((0, "_a"), (1, "_b")))

    def met(brackets: list) -> DataFrame:
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            # In order of the key, so that a pair's distance comes out alike in every round.
            u, v = (np.stack(z.sort_values("_k", kind="stable").h).astype(float) if len(z) else [] for z in (left, right))
            return counted((squared(u[p], v[q]).ravel() for p in tiles(len(u), TILE[0]) for q in tiles(len(v), TILE[1])), brackets, BINS)

        return met_blocks(x, y, nx, ny, run, "i int, at double, n long, lo double, hi double")

    todo, found = {r: (0.0, most, n) for r in {(n - 1) // 2, n // 2}}, {}
    while todo:
        brackets = sorted(set(todo.values()))
        got = met(brackets).groupBy("i", "at").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()
        for r, b in list(todo.items()):
            own = got[got.i == brackets.index(b)].sort_values("at")
            place = np.searchsorted(own.n.cumsum().to_numpy(), r, "right")
            part = own.iloc[place] if place < len(own) else None
            if part is None or part["at"] == -np.inf:
                todo[r] = (0.0, most, n)
            elif part.lo == part.hi:
                found[r] = part.lo
                del todo[r]
            else:
                todo[r] = (part.lo, part.hi, int(part.n))
    return float(np.mean([np.sqrt(q) for q in found.values()]))


def counted(parts, brackets: list[tuple[float, float, int]], bins: int) -> pd.DataFrame:
    """Values by bracket (lo, hi, how many it holds) and part of it: their number, the least and the most."""
    below = np.zeros(len(brackets), int)
    n, lo, hi = (np.full((len(brackets), bins), z) for z in (0, np.inf, -np.inf))
    few = [[] for _ in brackets]
    for q in parts:
        for i, (least, most, held) in enumerate(brackets):
            below[i] += np.count_nonzero(q < least)
            own = q[(q >= least) & (q <= most)]
            if held <= bins:
                few[i].append(own)
                continue
            at = np.minimum(((own - least) / (most - least) * bins).astype(np.int64), bins - 1)
            n[i] += np.bincount(at, minlength=bins)
            np.minimum.at(lo[i], at, own)
            np.maximum.at(hi[i], at, own)
    out = [pd.DataFrame({"i": np.arange(len(brackets)), "at": -np.inf, "n": below, "lo": -np.inf, "hi": -np.inf})]
    for i, own in enumerate(few):
        value, times = np.unique(np.concatenate([*own, []]), return_counts=True)
        out.append(pd.DataFrame({"i": i, "at": value, "n": times, "lo": value, "hi": value}))
        at = np.flatnonzero(n[i])
        out.append(pd.DataFrame({"i": i, "at": at.astype(float), "n": n[i][at], "lo": lo[i][at], "hi": hi[i][at]}))
    return pd.concat(out)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of every row of one matrix to every row of the other."""
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T)


def mmd(a: DataFrame, key: str, side: str, vector: str, sigmas: list[float] | None = None) -> DataFrame:
    """Two-sample discrepancy of vectors, mean of RBF kernels; without ``sigmas`` half, one and two times the median distance."""
    if sigmas is None:
        m = median_distance(a, key, side, vector) or 1.0
        sigmas = [m / 2, m, 2 * m]

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        q = squared(x, y)
        return sum(np.exp(-q / (2 * s * s)) for s in sigmas) / len(sigmas)

    return _mmd(a.select(F.col(key), F.col(side).alias("side"), F.col(vector).alias("h")), key, kernel)


def concat_graphs(nodes: DataFrame, edges: DataFrame, window: str) -> tuple[DataFrame, DataFrame]:
    """Parts (graph_id) of a window as one graph: node ids are shifted by the parts before."""
    n = nodes.groupBy(window, "graph_id").agg((F.max("node_id") + 1).alias("_n"))
    w = Window.partitionBy(window).orderBy("graph_id").rowsBetween(Window.unboundedPreceding, -1)
    off = n.select(window, "graph_id", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"))
    nn = nodes.join(off, [window, "graph_id"]).withColumn("node_id", F.col("node_id") + F.col("_o")).drop("_o")
    ee = edges.join(off, [window, "graph_id"]).withColumns({"src": F.col("src") + F.col("_o"), "dst": F.col("dst") + F.col("_o")}).drop("_o")
    return nn, ee


def khop_sample(nodes: DataFrame, edges: DataFrame, rate: float, k: int, seed: int, small: int) -> DataFrame:
    """Nodes of a graph within k steps of seeded starts (the floor(n * rate) of least hash); small graphs whole."""
    w = Window.partitionBy("graph_id")
    n = nodes.select("graph_id", "node_id").withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(h("node_id", seed), "node_id")))
    front = n.where((F.col("_n") <= small) | (F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * rate)))).select("graph_id", "node_id")
    sym = edges.select("graph_id", "src", "dst").union(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    for _ in range(k):
        step = front.withColumnRenamed("node_id", "src").join(sym, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node_id"))
        front = front.union(step).distinct()
    return front


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are among the nodes (graph_id, node_id), with the ends renumbered from 0 inside their graph."""
    n = nodes.select("graph_id", "node_id").distinct().withColumn("_i", F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1)
    end = lambda c: n.select("graph_id", F.col("node_id").alias(c), F.col("_i").alias(f"new_{c}"))
    return edges.select("graph_id", "src", "dst").join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"]).select("graph_id", "src", "dst", "new_src", "new_dst")


def prototypes(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Class means of unit vectors, scaled to length 1."""
    m = elements(df.select(label, l2(vector).alias("_u")), [label], "_u", {"v": "mean"})
    return gather(m, [label], "v", "prototype").withColumn("prototype", l2("prototype"))


def nearest_prototype(df: DataFrame, key: str, vector: str, protos: DataFrame, label: str) -> DataFrame:
    """The prototype of the largest cosine (ties: the lower class); one row a class is broadcast."""
    s = df.select(key, l2(vector).alias("_u")).join(F.broadcast(protos.select(F.col(label).alias("_c"), "prototype"))).select(key, "_c", F.round(dot("_u", "prototype"), 9).alias("similarity"))
    return s.groupBy(key).agg(F.max(F.struct("similarity", (-F.col("_c")).alias("m"))).alias("b")).select(key, (-F.col("b.m")).alias("nearest"), F.col("b.similarity").alias("similarity"))
