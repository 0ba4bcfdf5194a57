"""Annotation tables: geometry as coordinate arrays with bounds, properties as JSON text.

A row is (key, geom_type, coords array<struct<x,y>>, min_x, min_y, max_x, max_y, cx, cy, area,
properties).  Regions and properties are columns, so filters reach the scan.

Geometries of several parts or with holes have ``parts`` as well: parts of rings of points, open at
the end.  Of a polygon's rings the first is the outer one, the others are holes; a line or a point
is a part of one ring.  ``coords`` is then the first ring (of a MultiPoint all points).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.prims import cell, col

COORDS = "array<struct<x:double,y:double>>"
PARTS = f"array<array<{COORDS}>>"


def shoelace(coords) -> Column:
    """Area of a ring, whichever way round; 0 for fewer than three points."""
    c = col(coords)
    turned = F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1))
    cross = F.zip_with(c, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(c) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def with_bounds(df: DataFrame) -> DataFrame:
    """Adds bounds, centre and area computed from ``coords``."""
    xs, ys = F.transform("coords", lambda p: p["x"]), F.transform("coords", lambda p: p["y"])
    df = df.withColumns({"min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys)})
    return df.withColumns({"cx": (F.col("min_x") + F.col("max_x")) / 2, "cy": (F.col("min_y") + F.col("max_y")) / 2, "area": shoelace("coords")})


def with_geometry(df: DataFrame) -> DataFrame:
    """Adds coords, bounds, centre and area computed from ``parts``: areas of outer rings less those of holes.

    Lines and points have area 0; a row without parts, or with empty ones, has null bounds and area.
    """
    rings, areal = F.flatten("parts"), F.col("geom_type").isin("Polygon", "MultiPolygon")
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    signed = lambda part: F.aggregate(F.transform(part, lambda r, i: F.when(i == 0, shoelace(r)).otherwise(-shoelace(r))), F.lit(0.0), lambda s, v: s + v)
    area = F.when(areal, F.aggregate(F.transform("parts", signed), F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)
    df = df.withColumns({"coords": F.when(F.col("geom_type") == "MultiPoint", points).otherwise(F.get(rings, F.lit(0))), "min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys)})
    return df.withColumns({"cx": (F.col("min_x") + F.col("max_x")) / 2, "cy": (F.col("min_y") + F.col("max_y")) / 2, "area": F.when(F.col("min_x").isNotNull(), area)})


def holds(parts, x, y) -> Column:
    """Even-odd test of a point against all rings of a geometry column: in a hole is outside."""
    x, y = col(x), col(y)

    def crossed(r: Column) -> Column:
        turned = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
        cut = lambda p, q: p["x"] + (y - p["y"]) * ((q["x"] - p["x"]) / (q["y"] - p["y"]))
        hit = F.zip_with(r, turned, lambda p, q: F.when((p["y"] > y) != (q["y"] > y), F.when(x < cut(p, q), 1).otherwise(0)).otherwise(0))
        return F.aggregate(hit, F.lit(0), lambda s, v: s + v)

    return F.aggregate(F.transform(F.flatten(col(parts)), crossed), F.lit(0), lambda s, v: s + v) % 2 == 1


def points_in(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(key, n_key): each point (by its centre) with each polygon or multi-polygon around it."""
    areal = shapes.where(F.col("geom_type").isin("Polygon", "MultiPolygon"))
    met = box_pairs(points.withColumns({"min_x": F.col("cx"), "max_x": F.col("cx"), "min_y": F.col("cy"), "max_y": F.col("cy")}), areal, n_carry=("parts",))
    return met.where(holds("n_parts", "min_x", "min_y")).select("key", "n_key")


def box_coords(min_x, min_y, max_x, max_y) -> Column:
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a, b, c, d = map(col, (min_x, min_y, max_x, max_y))
    return F.array(at(a, b), at(c, b), at(c, d), at(a, d))


def with_box(df: DataFrame, min_x, min_y, max_x, max_y) -> DataFrame:
    """Adds the ring of a box, with bounds, centre and area straight from its sides."""
    a, b, c, d = (col(x).cast("double") for x in (min_x, min_y, max_x, max_y))
    df = df.withColumns({"coords": box_coords(a, b, c, d), "min_x": a, "max_x": c, "min_y": b, "max_y": d})
    return df.withColumns({"cx": (F.col("min_x") + F.col("max_x")) / 2, "cy": (F.col("min_y") + F.col("max_y")) / 2, "area": (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))})


def from_table(df: DataFrame, key: str, x: str, y: str, props: list[str]) -> DataFrame:
    """Points with the named columns as properties."""
    point = F.array(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    return with_bounds(df.select(F.col(key).cast("string").alias("key"), F.lit("Point").alias("geom_type"), point.alias("coords"), F.to_json(F.struct(*props)).alias("properties")))


def to_table(df: DataFrame, props: dict[str, str]) -> DataFrame:
    """Properties become columns: {name: type}."""
    got = F.from_json("properties", ", ".join(f"{n} {t}" for n, t in props.items()))
    return df.withColumn("_p", got).select("key", "geom_type", "cx", "cy", *(F.col(f"_p.{n}").alias(n) for n in props))


def label_types(df: DataFrame, types: dict, column: str = "type", default: str | None = None) -> DataFrame:
    """Numbered types to names."""
    names = F.create_map(*(F.lit(x) for kv in types.items() for x in kv))
    return df.withColumn(column, F.coalesce(F.try_element_at(names, F.col(column)), F.lit(default).cast("string")))


def transform_coords(df: DataFrame, a: float, b: float, c: float, d: float, tx: float, ty: float) -> DataFrame:
    """Affine map of all coordinates: x' = a x + b y + tx, y' = c x + d y + ty; bounds follow."""
    move = lambda p: F.struct((p["x"] * a + p["y"] * b + tx).alias("x"), (p["x"] * c + p["y"] * d + ty).alias("y"))
    return moved(df, move)


def moved(df: DataFrame, move) -> DataFrame:
    """df with ``move`` done to every point of its geometries; bounds and area follow."""
    if "parts" in df.columns:
        return with_geometry(df.withColumn("parts", F.transform("parts", lambda p: F.transform(p, lambda r: F.transform(r, move)))))
    return with_bounds(df.withColumn("coords", F.transform("coords", move)))


# --- properties -----------------------------------------------------------------------


def prop(path: str, kind: str = "string") -> Column:
    """A property by path, e.g. ``a.b[0]``."""
    return F.get_json_object("properties", f"$.{path}").cast(kind)


def has_key(path: str) -> Column:
    return F.get_json_object("properties", f"$.{path}").isNotNull()


def get(path: str, default, kind: str = "string") -> Column:
    return F.coalesce(prop(path, kind), F.lit(default))


def list_sum(path: str) -> Column:
    values = F.from_json(F.get_json_object("properties", f"$.{path}"), "array<double>")
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def list_contains(path: str, value, kind: str = "double") -> Column:
    return F.array_contains(F.from_json(F.get_json_object("properties", f"$.{path}"), f"array<{kind}>"), F.lit(value).cast(kind))


def regexp(pattern: str, path: str, ignore_case: bool = False) -> Column:
    return prop(path).rlike(("(?i)" if ignore_case else "") + pattern)


def floor_div(a, b) -> Column:
    return F.floor(col(a) / col(b))


def pquery(df: DataFrame, paths: list[str], where: Column | None = None, unique: bool = True) -> DataFrame:
    """Values of properties: distinct (path, value) rows, or the values of every key."""
    df = df if where is None else df.where(where)
    if not unique:
        return df.select("key", *(prop(p).alias(p) for p in paths))
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), prop(p).alias("value")) for p in paths)))
    return df.select(pairs.alias("s")).select("s.path", "s.value").distinct()


# --- keyed changes --------------------------------------------------------------------


def append(df: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """-> (rows of both, keys that would be there twice; none of them if all is well)."""
    both = df.unionByName(new)
    return both, both.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def patch(df: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, x, y, props map): a change's geometry replaces, its properties are merged in; unknown keys are added."""
    c = changes.select("key", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("props").alias("_p"))
    none = F.create_map().cast("map<string,string>")
    merged = F.map_concat(F.map_filter(F.coalesce("props", none), lambda k, _: ~F.map_contains_key(F.coalesce("_p", none), k)), F.coalesce("_p", none))
    return df.join(c, "key", "full_outer").select("key", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"), merged.alias("props"))


def remove(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select("key"), "key", "left_anti")


def set_default(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """Stored rows, and those defaults whose key isn't stored."""
    return df.unionByName(defaults.join(df.select("key"), "key", "left_anti"))


# --- space ----------------------------------------------------------------------------


def in_box(min_x, min_y, max_x, max_y) -> Column:
    """Bounds overlap (edges included): four range predicates."""
    return (F.col("min_x") <= max_x) & (F.col("max_x") >= min_x) & (F.col("min_y") <= max_y) & (F.col("max_y") >= min_y)


def bquery(df: DataFrame, box, where: Column | None = None) -> DataFrame:
    out = df.where(in_box(*box))
    out = out if where is None else out.where(where)
    return out.select("key", "min_x", "min_y", "max_x", "max_y")


def inside(polygon: list[tuple[float, float]], x="cx", y="cy") -> Column:
    """Even-odd test of a point against a polygon given by its corners."""
    x, y, crossed = col(x), col(y), F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        if y1 != y2:
            cut = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossed = crossed + F.when(((y1 > y) != (y2 > y)) & (x < cut), 1).otherwise(0)
    return crossed % 2 == 1


def query(df: DataFrame, region, predicate: str = "bbox_intersects", distance: float = 0.0, where: Column | None = None, min_area: float | None = None) -> DataFrame:
    """Rows of a region: a box, or a polygon for ``within`` / ``disjoint`` of points."""
    out = df if where is None else df.where(where)
    if min_area is not None:
        out = out.where(F.col("area") > min_area)
    if predicate == "bbox_intersects":
        return out.where(in_box(*region))
    if predicate == "centers_within_k":
        x0, y0 = (region[0] + region[2]) / 2, (region[1] + region[3]) / 2
        near = F.col("cx").between(x0 - distance, x0 + distance) & F.col("cy").between(y0 - distance, y0 + distance)
        return out.where(near & ((F.col("cx") - x0) ** 2 + (F.col("cy") - y0) ** 2 <= distance**2))
    xs, ys = zip(*region)
    hit = in_box(min(xs), min(ys), max(xs), max(ys)) & inside(list(region))
    return out.where(~hit if predicate == "disjoint" else hit)


def neighbours(left: DataFrame, right: DataFrame, distance: float, mode: str = "centre") -> DataFrame:
    """Pairs (key, n_key) within a distance, by grid cells: an equi-join, no cross join.

    ``centre``: of centres, closed ball; cells of that size.  ``box``: bounds grown by the distance
    overlap; see ``box_pairs``.
    """
    d = float(distance)
    if mode == "box":
        return box_pairs(left, right, d).select("key", "n_key")
    l = left.select("key", "cx", "cy")  # noqa: E741
    r = right.select(F.col("key").alias("n_key"), *(F.col(c).alias(f"n_{c}") for c in ("cx", "cy")))
    l = l.withColumn("gx", cell("cx", d)).withColumn("gy", cell("cy", d))  # noqa: E741
    around = lambda c: F.sequence(cell(c, d) - 1, cell(c, d) + 1)
    r = r.withColumn("gx", F.explode(around("n_cx"))).withColumn("gy", F.explode(around("n_cy")))
    return l.join(r, ["gx", "gy"]).where((F.col("cx") - F.col("n_cx")) ** 2 + (F.col("cy") - F.col("n_cy")) ** 2 <= d * d).select("key", "n_key")


def near_pairs(df: DataFrame, distance: float) -> DataFrame:
    """Pairs of rows of one table (key, cx, cy, ..) with centres within a distance, each once: its columns, and those
    of the other row with n_.  Rows with the same key make no pair.

    One side is filed in its own cell, the other in it and in four of the eight around: of two cells
    side by side one looks into the other.
    """
    d = float(distance)
    l = df.withColumn("gx", cell("cx", d)).withColumn("gy", cell("cy", d))  # noqa: E741
    ahead = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    r = l.select(*(F.col(c).alias(f"n_{c}") for c in df.columns), "gx", "gy", F.explode(ahead).alias("_to"))
    r = r.withColumns({"gx": F.col("gx") + F.col("_to.x"), "gy": F.col("gy") + F.col("_to.y"), "_own": (F.col("_to.x") == 0) & (F.col("_to.y") == 0)}).drop("_to")
    within = (F.col("cx") - F.col("n_cx")) ** 2 + (F.col("cy") - F.col("n_cy")) ** 2 <= d * d
    once = F.when(F.col("_own"), F.col("key") < F.col("n_key")).otherwise(F.col("key") != F.col("n_key"))
    return l.join(r, ["gx", "gy"]).where(within & once).drop("gx", "gy", "_own")


BOUNDS = ("min_x", "min_y", "max_x", "max_y")


def filed(df: DataFrame, levels: list[int], keep: bool) -> DataFrame:
    """Boxes in the cells of their own level (``home``) and, as visitors, of every coarser one of ``levels``.

    A level's cells are 4 ** level wide, at least as wide as the boxes at home there, so that a box
    lies in four cells of a level at most.
    """
    listed = F.lit(levels).cast("array<int>")
    up = df.withColumn("_level", F.explode(F.filter(listed, lambda x: x >= F.col("_home"))))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(4.0), F.col("_level").cast("double"))).cast("long")
    up = up.withColumn("_gx", F.explode(F.sequence(at("min_x"), at("max_x")))).withColumn("_gy", F.explode(F.sequence(at("min_y"), at("max_y"))))
    return up if keep else up.drop("_home")


def box_pairs(left: DataFrame, right: DataFrame, distance: float = 0.0, carry: tuple[str, ...] = (), n_carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of boxes that overlap, edges included, once the right ones are grown by ``distance``:
    (key, n_key, both bounds, the carried columns; of the right side all with n_).  Null bounds meet nothing.

    Every box is filed at the level of its own extent, the grown right ones too, and a pair meets at
    the coarser of both levels, where one of the two is at home.  It is kept in one of the cells that
    both share: that of the lower corner of what they have in common.  So nothing is found twice, and
    no box, however large among small ones, is cut into more than four cells a level.
    """
    d = float(distance)
    home = F.ceil(F.log(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(1e-9))) / F.log(F.lit(4.0)) + 1e-9).cast("int")
    whole = lambda df: df.where(F.col("min_x").isNotNull() & F.col("min_y").isNotNull() & F.col("max_x").isNotNull() & F.col("max_y").isNotNull())
    l = whole(left.select("key", *BOUNDS, *carry)).withColumn("_home", home)  # noqa: E741
    grown = {c: F.col(c) + (d if c.startswith("max") else -d) for c in BOUNDS}
    r = whole(right.select("key", *(grown[c].alias(c) for c in BOUNDS), *n_carry)).withColumn("_home", home)
    # As many levels as there are powers of four among the extents: a few numbers, whatever the rows.
    have = [{x["_home"] for x in side.select("_home").distinct().collect()} for side in (l, r)]
    # A box visits a level only if one of the other side is at home there.
    l_in, r_in = filed(l, sorted(have[0] | have[1]), True), filed(r, sorted(have[0] | have[1]), True)
    visits = lambda mine: (F.col("_level") == F.col("_home")) | F.col("_level").isin(sorted(mine))
    l_in, r_in = l_in.where(visits(have[1])), r_in.where(visits(have[0]))
    names = {c: f"n_{c}" for c in ("key", *BOUNDS, "_home", *n_carry)}
    r_in = r_in.withColumnsRenamed(names)
    low = {c: F.greatest(F.col(f"min_{c}"), F.col(f"n_min_{c}")) for c in "xy"}
    size = F.pow(F.lit(4.0), F.col("_level").cast("double"))
    touch = (low["x"] <= F.least("max_x", "n_max_x")) & (low["y"] <= F.least("max_y", "n_max_y"))
    here = (F.floor(low["x"] / size) == F.col("_gx")) & (F.floor(low["y"] / size) == F.col("_gy"))
    at_home = F.greatest("_home", "n__home") == F.col("_level")
    # A merge join: estimates from before the cells were made would broadcast a side of any size.
    out = l_in.hint("merge").join(r_in, ["_level", "_gx", "_gy"]).where(touch & here & at_home)
    back = [(F.col(f"n_{c}") - (d if c.startswith("max") else -d)).alias(f"n_{c}") for c in BOUNDS]
    return out.select("key", "n_key", *BOUNDS, *back, *carry, *(f"n_{c}" for c in n_carry))


def box_coverage(tiles: DataFrame, masks: DataFrame) -> DataFrame:
    """(key, covered): the share of each tile's area that mask boxes cover, which don't overlap each other; 0 for none."""
    p = box_pairs(tiles, masks)
    w = F.least("max_x", "n_max_x") - F.greatest("min_x", "n_min_x")
    h = F.least("max_y", "n_max_y") - F.greatest("min_y", "n_min_y")
    part = p.groupBy("key").agg(F.sum(w * h).alias("_area"))
    size = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return tiles.select("key", size.alias("_size")).join(part, "key", "left").select("key", F.coalesce(F.col("_area") / F.nullif("_size", F.lit(0.0)), F.lit(0.0)).alias("covered"))


def nquery(df: DataFrame, where: Column, n_where: Column, distance: float, mode: str = "centre", include_self: bool = True) -> DataFrame:
    """Keys with at least one neighbour, and how many; of boxes, keys that stand on several rows count once."""
    pairs = neighbours(df.where(where), df.where(n_where), distance, mode)
    pairs = pairs if include_self else pairs.where("key <> n_key")
    count = F.count_distinct("n_key") if mode == "box" else F.count("*")
    return pairs.groupBy("key").agg(count.alias("neighbours"))


def tile_grid(images: DataFrame, size: int, stride: int, within: bool = True) -> DataFrame:
    """(image, width, height) -> tiles by stride; ``within`` drops those that stick out."""
    xs = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("width") - 1), F.lit(stride)))
    out = images.withColumn("x", xs).withColumn("y", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("height") - 1), F.lit(stride))))
    return out.where((F.col("x") + size <= F.col("width")) & (F.col("y") + size <= F.col("height"))) if within else out


def tile_counts(points: DataFrame, size: float, kind: str) -> DataFrame:
    """Boxes that lie inside one tile of a regular grid, by tile and type."""
    low = points.withColumn("tx", cell("min_x", size)).withColumn("ty", cell("min_y", size))
    return low.where((cell("max_x", size) == F.col("tx")) & (cell("max_y", size) == F.col("ty"))).groupBy("tx", "ty", kind).agg(F.count("*").alias("n"))


def filter_tiles(tiles: DataFrame, mask: DataFrame, size: int, min_ratio: float) -> DataFrame:
    """Tiles (tx, ty) whose share of mask cells (x, y) is over ``min_ratio`` (at 1: all of them)."""
    cover = mask.select("x", "y").distinct().groupBy(cell("x", size).alias("tx"), cell("y", size).alias("ty")).agg(F.count("*").alias("cells"))
    share = F.col("cells") / float(size * size)
    return tiles.join(cover, ["tx", "ty"]).where((share > min_ratio) | (share == 1.0))


def merge_tiles(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score of a cell over overlapping tiles, then the best class (ties: the smaller)."""
    mean = pred.groupBy(*keys, "cls").agg(F.avg("score").alias("score"))
    return mean.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("cls")).alias("m"))).alias("b")).select(*keys, (-F.col("b.m")).alias("cls"), F.col("b.score").alias("score"))


def dedupe_seams(instances: DataFrame, size: float, margin: float) -> DataFrame:
    """Detections that don't touch the margin of their tile (tx, ty)."""
    low_x, low_y = F.col("tx") * size, F.col("ty") * size
    ok = (F.col("min_x") >= low_x + margin) & (F.col("max_x") <= low_x + size - margin) & (F.col("min_y") >= low_y + margin) & (F.col("max_y") <= low_y + size - margin)
    return instances.where(ok)


def label_nodes(members: DataFrame, scores: DataFrame, on: list[str]) -> DataFrame:
    """Node label: the class of the best mean score over its member points (ties: the smaller)."""
    mean = members.join(scores, on).groupBy("node", "cls").agg(F.avg("score").alias("score"))
    return mean.groupBy("node").agg(F.max(F.struct("score", (-F.col("cls")).alias("m"))).alias("b")).select("node", (-F.col("b.m")).alias("label"), F.col("b.score").alias("score"))
