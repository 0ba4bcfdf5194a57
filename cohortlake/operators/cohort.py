"""Cohort curation: inclusion rules, matching across modalities, indexes, counts, splits."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.prims import col, first_by, h, hash_rank


def include_series(headers: DataFrame, group: str, text: str, stop: list[str]) -> DataFrame:
    """Groups none of whose rows has a stop word."""
    bad = F.lower(F.coalesce(F.col(text), F.lit(""))).rlike("|".join(stop))
    return headers.groupBy(group).agg(F.bool_and(~bad).alias("ok")).where("ok").select(group)


def split_status(df: DataFrame, cond: Column) -> DataFrame:
    return df.withColumn("status", F.when(cond, "included").otherwise("excluded"))


def keep_singletons(df: DataFrame, group: str) -> DataFrame:
    """Rows alone in their group; larger groups go whole."""
    one = df.groupBy(group).agg(F.count("*").alias("_n")).where("_n = 1").select(group)
    return df.join(one, group, "left_semi")


def subject_id(c, kind: str = "long") -> Column:
    """Subject of a sample or file name: the first 12 (``long``) or 9 (``short``) characters, or the anchored pattern."""
    c = col(c)
    return F.substring(c, 1, 12) if kind == "long" else F.substring(c, 1, 9) if kind == "short" else F.regexp_extract(c, "^([A-Za-z]+#[0-9]+)", 1)


def match_subjects(subjects: DataFrame, left: DataFrame, right: DataFrame, projects: DataFrame) -> DataFrame:
    """Subjects of a known project with items on both sides; items in order of their date.

    left and right: (subject, date, item); projects: (project).
    """
    lists = lambda df, name: df.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "item"))), lambda x: x["item"]).alias(name))
    known = subjects.join(projects, "project", "left_semi")
    return known.join(lists(left, "left_items"), "subject").join(lists(right, "right_items"), "subject")


def pre_event(df: DataFrame, date: str, ref_year: str) -> DataFrame:
    """Rows whose year is before the reference year, with the gap; rows without a reference year go."""
    gap = F.col(ref_year) - F.year(date)
    return df.where(F.col(ref_year).isNotNull()).withColumn("year_gap", gap).where("year_gap > 0")


def not_single(df: DataFrame, key: str, c: str) -> DataFrame:
    """Keys with several values of a column that should have one: (key, n)."""
    return df.groupBy(key).agg(F.count_distinct(c).alias("n")).where("n > 1")


def site_counts(subjects: DataFrame, sites: DataFrame, on: str) -> DataFrame:
    """(site, subjects, items), most subjects first."""
    by = subjects.join(sites, on).groupBy("site").agg(F.count_distinct("subject").alias("subjects"), F.sum("items").alias("items"))
    return by.orderBy(F.desc("subjects"), "site")


def series_index(rows: DataFrame, keep: Column, subject: str, series: str, *order: Column) -> DataFrame:
    """One row a series (the first), then a list of series for each subject."""
    first = first_by(rows.where(keep), [subject, series], *order)
    return first.groupBy(subject).agg(F.array_sort(F.collect_list(series)).alias("series"))


def catalogue(paths: DataFrame, c: str, sites: dict[str, str], template: str) -> DataFrame:
    """Site and section from a path's segments, a text from a template, and the label's path."""
    seg = F.split(F.col(c), "/")
    names = F.create_map(*(F.lit(x) for kv in sites.items() for x in kv))
    host = F.element_at(F.split(seg[2], r"\."), -1)
    out = paths.withColumn("site", F.try_element_at(names, host)).withColumn("section", F.try_element_at(seg, F.lit(4))).where("site is not null")
    return out.withColumn("prompt", F.format_string(template, "section", "site")).withColumn("label_path", F.regexp_replace(c, "^[a-z]+://", "labels/"))


def pair_files(left: DataFrame, right: DataFrame, name: str, stem: str = r"\.[^.]*$") -> DataFrame:
    """Files of both sides with one normalised stem: an equi-join in place of all pairs."""
    key = F.lower(F.regexp_replace(F.col(name), stem, ""))
    return left.withColumn("stem", key).join(right.withColumn("stem", key).withColumnRenamed(name, f"{name}_right"), "stem")


def split_runs(slices: DataFrame, group: str, z: str, factor: float, *tie: str) -> DataFrame:
    """A new run where a gap is more than ``factor`` times the group's median gap."""
    w = Window.partitionBy(group).orderBy(z, *tie)
    gaps = slices.withColumn("_gap", F.col(z) - F.lag(z).over(w))
    mid = gaps.groupBy(group).agg(F.percentile("_gap", F.lit(0.5)).alias("_mid"))
    new = F.when(F.col("_gap") > factor * F.col("_mid"), 1).otherwise(0)
    return gaps.join(mid, group).withColumn("run", F.sum(new).over(w)).drop("_gap", "_mid")


def best_run(runs: DataFrame, group: str, *score: Column) -> DataFrame:
    return first_by(runs, [group], *score)


def majority(df: DataFrame, group: str, c: str) -> DataFrame:
    """The most frequent value (ties: the smallest)."""
    n = df.groupBy(group, c).agg(F.count("*").alias("n"))
    return first_by(n, [group], F.desc("n"), F.col(c))


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256), 1, 16)


def flatten_cases(cases: DataFrame) -> DataFrame:
    """(case, follow_ups array<struct<days,recurred>>, diagnoses array) -> last follow-up, first recurrence, first diagnosis."""
    days = F.transform("follow_ups", lambda f: f["days"])
    again = F.transform(F.filter("follow_ups", lambda f: f["recurred"]), lambda f: f["days"])
    return cases.select("case", F.array_max(days).alias("last_follow_up"), F.array_min(again).alias("recurrence"), F.try_element_at("diagnoses", F.lit(1)).alias("diagnosis"))


def audit_masks(voxels: DataFrame, file: str, v: str) -> DataFrame:
    """How many files are empty, all zero, of one voxel, or usable."""
    n = voxels.groupBy(file).agg(F.count(v).alias("n"), F.count_if(F.col(v) != 0).alias("set"))
    kind = F.when(F.col("n") == 0, "empty").when(F.col("set") == 0, "zero").when(F.col("set") == 1, "single").otherwise("usable")
    return n.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"))


def dense(df: DataFrame, order: list[str], name: str, buckets: int = 4096) -> DataFrame:
    """Distinct rows of ``order`` with numbers 1, 2, ..: by ranges of a hash of theirs, then in order."""
    k = F.pmod(F.xxhash64(*order), F.lit(buckets))
    rows = df.select(*order).distinct().withColumn("_b", k)
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    # As many rows as there are buckets, whatever the table.
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return rows.withColumn("_i", inner).join(F.broadcast(before), "_b").select(*order, (F.col("_before") + F.col("_i")).alias(name))


def build_index(masks: DataFrame, templates: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(image, category, mask) rows with area -> images, annotations, sentences.

    Images and annotations have dense ids (1, 2, ..), in no stated order; ``ann`` is an
    annotation's number inside its image.
    """
    live = masks.where("area > 0")
    # An image's annotations are numbered on from those of the images before: only images are put in order.
    images = live.groupBy("image").agg(F.count("image").alias("_n")).withColumn("_b", F.pmod(F.xxhash64("image"), F.lit(4096)))
    upto = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = images.groupBy("_b").agg(F.count("*").alias("_i"), F.sum("_n").alias("_s")).select("_b", upto("_i").alias("_i"), upto("_s").alias("_s"))
    own = Window.partitionBy("_b").orderBy("image")
    inner = images.withColumns({"_r": F.row_number().over(own), "_u": F.sum("_n").over(own) - F.col("_n")})
    ids = inner.join(F.broadcast(before), "_b").select("image", (F.col("_i") + F.col("_r")).alias("image_id"), (F.col("_s") + F.col("_u")).alias("_first"))
    w = Window.partitionBy("image").orderBy("category", "mask")
    anns = live.join(ids, "image").withColumn("ann", F.row_number().over(w)).withColumn("ann_id", F.col("_first") + F.col("ann")).drop("_first")
    ids = ids.drop("_first")
    texts = F.posexplode(F.array(*(F.format_string(t, "category", "image") for t in templates))).alias("sent_id", "raw")
    return ids, anns, anns.select("image", "ann", "ann_id", texts)


def select_refs(refs: DataFrame, anns: DataFrame, categories: list[str], split: str) -> DataFrame:
    return refs.where(F.col("split") == split).join(anns.where(F.col("category").isin(categories)), "ann", "left_semi")


def ratio_split(df: DataFrame, key: str, ratio: float, seed: int = 1, group: str | None = None) -> DataFrame:
    """``train`` for the floor(n * ratio) keys of the least hash, in each group; ``test`` for the rest."""
    g = [group] if group else []
    keys = hash_rank(df.select(*g, key).distinct().withColumn("_h", h(key, seed)), g, "_h", key, name="_r")
    sizes = keys.groupBy(*g).agg(F.floor(F.count("*") * ratio).alias("_cut"))
    keys = keys.join(F.broadcast(sizes), g) if g else keys.crossJoin(F.broadcast(sizes))
    return df.join(keys.select(*g, key, F.when(F.col("_r") <= F.col("_cut"), "train").otherwise("test").alias("split")), [*g, key])


def split_drift(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose split differs, or that one side lacks."""
    both = a.select(key, F.col("split").alias("split_a")).join(b.select(key, F.col("split").alias("split_b")), key, "full_outer")
    return both.where(~F.col("split_a").eqNullSafe(F.col("split_b")))


def priority_label(votes: DataFrame, cell: list[str], order: list[str], need: Column) -> DataFrame:
    """Of the classes with enough votes in a cell, the first in order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("cls"))
    held = votes.groupBy(*cell, "cls").agg(F.sum("vote").alias("votes"), F.count("*").alias("raters")).where(need)
    return held.groupBy(*cell).agg(F.min_by("cls", rank).alias("label"))


def class_presence(labels: DataFrame, scan: list[str], classes: list[str], label: str = "label") -> DataFrame:
    """A row a scan, with 1 or 0 for every class that any of its cells has."""
    return labels.groupBy(*scan).agg(*(F.max((F.col(label) == c).cast("int")).alias(c) for c in classes)).fillna(0, classes)


def keep_usable(parents: DataFrame, children: DataFrame, key: str, cond: Column) -> DataFrame:
    """Parents with at least one usable child."""
    return parents.join(children.where(cond), key, "left_semi")


def mixture(df: DataFrame, source: str, key: str, how: str, n: int, seed: int = 1) -> DataFrame:
    """n rows in shares by source (proportional, equal, sqrt); small sources repeat, in hash order."""
    sizes = df.groupBy(source).agg(F.count("*").alias("_size"))
    weight = {"proportional": F.col("_size"), "equal": F.lit(1.0), "sqrt": F.sqrt("_size")}[how]
    total = sizes.agg(F.sum(weight).alias("_w"))
    quota = sizes.join(F.broadcast(total)).withColumn("_quota", F.round(n * weight / F.col("_w")).cast("long")).drop("_w")
    ranked = hash_rank(df.withColumn("_h", h(key, seed)), [source], "_h", key, name="_rank").drop("_h")
    times = F.floor((F.col("_quota") - F.col("_rank")) / F.col("_size")) + 1
    taken = ranked.join(quota, source).where(F.col("_rank") <= F.col("_quota")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return taken.drop("_rank", "_size", "_quota")
