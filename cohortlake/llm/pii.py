"""Personal data: base patterns plus information-theoretic sanitisation, native Spark.

Base spans come from four patterns.  The method then asks which *terms* give a found
entity away: over all distinct texts, the words beside an entity anywhere in its texts
are counted (words inside base spans aside), and a term whose pointwise mutual information
with the entity reaches ``alpha`` of the entity's own information content discloses it.
Such terms are generalised in every document that holds the entity.

Nulls and empties: a null text counts as empty and has no spans; a null doc_id is kept;
repeated rows each get their own result.  Extra columns are passed through, whatever their
names; of ``annotate`` those named like the added ones give way to them.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, without

KINDS = ["email", "ip", "card", "phone", "term"]

# The contract's patterns in possessive form: same leftmost matches, no backtracking over
# long runs.  \G stands for "where the match before ended".
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that has to hold before a pattern is tried at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
SPANS = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern, keep=lambda value: F.lit(True)) -> Column:
    """The matches whose value is to be kept, as structs (start, end, value), in code points, left to right.

    A match that is dropped only moves the place on, so that a text of very many numbers takes linear time.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("p"), found.alias("m"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        more = F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"))))
        return F.struct(end.alias("at"), F.when(keep(x["m"]), more).otherwise(a["out"]).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits, right to left."""
    total = F.aggregate(
        F.zip_with(
            F.split(F.reverse(digits), ""),
            F.sequence(F.lit(0), F.length(digits)),
            lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")),
        ),
        F.lit(0),
        lambda a, x: a
        + F.when(x["d"].isNull(), 0)
        .when(x["i"] % 2 == 0, x["d"])
        .otherwise(x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``found``: the valid base matches as (start, kind, end, value), sorted."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    docs = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    for kind, pattern in PATTERNS.items():
        docs = docs.withColumn(f"_{kind}", F.when(F.col("_t").rlike(HINTS[kind]), matches(F.col("_t"), pattern, lambda v, kind=kind: valid(kind, v))).otherwise(empty))

    def rows(k: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    return docs.withColumn("found", F.array_sort(F.concat(*(rows(k, kind) for k, kind in enumerate(PATTERNS))))).drop("_t", *(f"_{k}" for k in PATTERNS))


TERM = r"\p{L}{3,}"


def text_sets(found: DataFrame) -> DataFrame:
    """One row a distinct text: its hash, distinct entities, and distinct terms outside its base spans."""
    text = F.coalesce("text", F.lit(""))
    terms = F.array_distinct(F.regexp_extract_all(F.lower(redact(text, F.col("found"), [" "] * len(KINDS))), F.lit(TERM), F.lit(0)))
    entities = F.array_distinct(F.transform("found", lambda m: F.concat_ws(":", m["kind"], F.lower(m["value"]))))
    rows = found.select(F.sha2(text, 256).alias("_sha"), F.struct(entities.alias("entities"), terms.alias("terms")).alias("s"))
    return rows.groupBy("_sha").agg(F.first("s").alias("s")).select("_sha", "s.entities", "s.terms")


def disclosing_terms(sets: DataFrame, alpha: float, support: int) -> DataFrame:
    """(entity, term) pairs whose mutual information reaches ``alpha`` of the entity's information.

    Counts are of distinct texts, so that copies of one document are no evidence.  Entities
    and terms in fewer than ``support`` texts can have no such pair and go first.
    """
    n = sets.agg(F.count("*").alias("n"))
    entity = sets.where(F.size("entities") > 0).select("_sha", F.explode("entities").alias("entity"))
    often = entity.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    hits = entity.join(often, "entity").groupBy("_sha").agg(F.collect_list(F.struct("entity", "n_e")).alias("hits"))
    # Rows by entity and term, so that a hot entity is dealt out by its terms.
    joint = (
        sets.where(F.size("entities") > 0)
        .join(hits, "_sha")
        .select("terms", F.explode("hits").alias("hit"))
        .select("hit.entity", "hit.n_e", F.explode("terms").alias("term"))
        .groupBy("entity", "n_e", "term")
        .agg(F.count("*").alias("n_te"))
        .where(F.col("n_te") >= support)
    )
    terms = sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= support)
    pmi = F.log(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e")))
    content = F.log(F.col("n") / F.col("n_e"))
    return joint.join(terms, "term").join(F.broadcast(n)).where((content > 0) & (pmi >= alpha * content)).select("entity", "term")


def own_terms(sets: DataFrame, leaks: DataFrame) -> DataFrame:
    """(_sha, _terms): a text's own terms that disclose one of its entities, as one pattern, longest first.

    Terms are joined with their entity, so a text is told its own terms alone, and an entity's
    texts are dealt out by term.
    """
    leaky = leaks.select("entity").distinct()
    mine = sets.where(F.size("entities") > 0).select("_sha", "terms", F.explode("entities").alias("entity")).join(leaky, "entity", "left_semi")
    mine = mine.select("_sha", "entity", F.explode("terms").alias("term")).join(leaks, ["entity", "term"])
    return mine.groupBy("_sha").agg(F.array_join(F.sort_array(F.collect_set("term"), asc=False), "|").alias("_terms"))


def spanned(docs: DataFrame, alpha: float, support: int) -> DataFrame:
    """(row, text, found, spans): the rows of ``docs`` as structs, so that no column of theirs clashes."""
    found = base_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text"))
    sets = materialize(text_sets(found), "sets")
    leaks = materialize(disclosing_terms(sets, alpha, support), "leaks")
    held = own_terms(sets, leaks)
    # Only rows that hold an entity go through the join; the rest are passed by.
    some, none = found.where(F.size("found") > 0), found.where(F.size("found") == 0)
    some = some.withColumn("_sha", F.sha2("text", 256)).join(held, "_sha", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("_terms"), F.lit(r")(?!\p{L})"))
    term = F.when(F.col("_terms").isNull(), F.array().cast("array<struct<start:int,end:int,value:string>>")).otherwise(matches(F.col("text"), pattern))
    base = F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    terms = F.transform(term, lambda m: F.struct(m["start"].alias("start"), F.lit(4).alias("kind"), m["end"].alias("end")))
    some = some.withColumn("_terms_found", terms).withColumn("spans", F.array_sort(F.concat(base, F.col("_terms_found"))))
    return some.select("row", "text", "found", "spans").unionByName(none.select("row", "text", "found", F.array().cast(SPANS).alias("spans")))


def annotate(docs: DataFrame, alpha: float = 0.9, support: int = 3) -> DataFrame:
    """``docs`` with ``found`` (base spans) and ``spans`` (base and term spans, sorted)."""
    docs = without(docs, "found", "spans")
    return spanned(docs, alpha, support).select(*(F.col(f"row.`{c}`") for c in docs.columns), "found", "spans")


def labels(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, kinds=tuple(f"[{k.upper()}]" for k in KINDS)) -> Column:
    """Text with each span put as its general kind; overlapping spans become the first's kind."""
    names = F.array(*(F.lit(k) for k in kinds))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        spans,
        state,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"])
            .otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1)))
            .alias("out"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, alpha: float = 0.9, support: int = 3) -> DataFrame:
    """Documents with personal data generalised; same columns."""
    clean = redact(F.col("text"), F.col("spans")).alias("text")
    return spanned(docs, alpha, support).select(*(clean if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda m: m["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    return spans.select("doc_id", *(count(k) for k in range(4)), F.sha2(labels(base), 256).alias("base_sha256"), labels(F.col("spans")).alias("spans"))
