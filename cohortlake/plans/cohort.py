"""Queries for cohort curation and outcome tables."""

from pyspark.sql import functions as F

from cohortlake.functions.prims import h, h_sql, key_number, key_number_sql, table
from cohortlake.operators import cohort as B
from cohortlake.operators import outcomes as C

from .registry import query


@query("b01_included_customers", "SELECT c_custkey // 10 AS grp FROM customer GROUP BY 1 HAVING bool_and(NOT regexp_matches(lower(coalesce(c_mktsegment, '')), 'furni')) ")
def b01(spark, d):
    c = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 10).alias("grp"), "c_mktsegment")
    return B.include_series(c, "grp", "c_mktsegment", ["furni"])


@query("b02_status_counts", "SELECT CASE WHEN c_acctbal > 0 THEN 'included' ELSE 'excluded' END AS status, count(*) AS n FROM customer GROUP BY 1")
def b02(spark, d):
    return B.split_status(table(spark, d, "customer"), F.col("c_acctbal") > 0).groupBy("status").agg(F.count("*").alias("n"))


@query("b03_singletons", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1)")
def b03(spark, d):
    return B.keep_singletons(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey")


@query("b04_matched_subjects", """WITH l AS (SELECT o_custkey AS subject, count(*) AS n, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS left_items FROM orders GROUP BY 1),
 r AS (SELECT user_id AS subject, array_to_string(list(event_id ORDER BY ts, event_id), ',') AS right_items FROM events GROUP BY 1)
 SELECT c_custkey AS subject, left_items, right_items FROM customer JOIN l ON l.subject = c_custkey JOIN r ON r.subject = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")
def b04(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("project"))
    left = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("item"))
    right = table(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("ts").alias("date"), F.col("event_id").alias("item"))
    out = B.match_subjects(c, left, right, table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("project")))
    return out.select("subject", F.array_join("left_items", ",").alias("left_items"), F.array_join("right_items", ",").alias("right_items"))


@query("b05_subject_ids", "SELECT substr(c_name, 1, 12) AS long_id, substr(c_name, 1, 9) AS short_id, regexp_extract(c_name, '^([A-Za-z]+#[0-9]+)', 1) AS pattern_id, count(*) AS n FROM customer GROUP BY 1, 2, 3")
def b05(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy(B.subject_id("c_name").alias("long_id"), B.subject_id("c_name", "short").alias("short_id"), B.subject_id("c_name", "pattern").alias("pattern_id")).agg(F.count("*").alias("n"))


@query("b06_before_event", """WITH r AS (SELECT c_custkey, 1993 + c_custkey % 8 AS y FROM customer WHERE c_custkey % 5 <> 0)
 SELECT o_orderkey, (y - year(o_orderdate))::BIGINT AS year_gap FROM orders JOIN r ON c_custkey = o_custkey WHERE y - year(o_orderdate) > 0""")
def b06(spark, d):
    r = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, 1993 + F.col("c_custkey") % 8).alias("y"))
    return B.pre_event(table(spark, d, "orders").join(r, F.col("c_custkey") == F.col("o_custkey")), "o_orderdate", "y").select("o_orderkey", "year_gap")


@query("b07_not_single", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def b07(spark, d):
    return B.not_single(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("b08_site_counts", "SELECT n_name AS site, count(DISTINCT c_custkey) AS subjects, count(*) AS items FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def b08(spark, d):
    items = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.count("*").alias("items"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("project"))
    sites = table(spark, d, "nation").select(F.col("n_nationkey").alias("project"), F.col("n_name").alias("site"))
    return B.site_counts(c.join(items, "subject"), sites, "project")


@query("b09_series_index", """SELECT subject, array_to_string(list(series ORDER BY series), ',') AS series FROM (SELECT DISTINCT user_id AS subject, event_type || '-' || (event_id % 4) AS series FROM events
 WHERE value > 20 AND event_type IN ('click', 'view')) GROUP BY 1""")
def b09(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), F.concat_ws("-", "event_type", F.col("event_id") % 4).alias("series"), "event_type", "value", "ts", "event_id")
    return B.series_index(e, (F.col("value") > 20) & F.col("event_type").isin("click", "view"), "subject", "series", F.col("ts"), F.col("event_id")).select("subject", F.array_join("series", ",").alias("series"))


@query("b10_catalogue", r"""WITH p AS (SELECT page_id, url, string_split(url, '/') AS s FROM pages), q AS (SELECT page_id, url, CASE list_last(string_split(s[3], '.')) WHEN 'com' THEN 'commerce' WHEN 'org' THEN 'society' END AS site, s[4] AS section FROM p)
 SELECT page_id, site, section, 'pages on ' || section || ' of ' || site AS prompt, regexp_replace(url, '^[a-z]+://', 'labels/') AS label_path FROM q WHERE site IS NOT NULL""")
def b10(spark, d):
    return B.catalogue(table(spark, d, "pages").select("page_id", "url"), "url", {"com": "commerce", "org": "society"}, "pages on %s of %s").drop("url")


@query("b11_paired_files", """WITH l AS (SELECT c_custkey AS a, lower(c_mktsegment) || '_' || c_custkey AS stem FROM customer), r AS (SELECT s_suppkey * 7 AS b, s_suppkey FROM supplier)
 SELECT a, s_suppkey AS b FROM l JOIN r ON a = b""")
def b11(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.concat(F.lit("Slide_"), "c_custkey", F.lit(".svs")).alias("name"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("b"), F.concat(F.lit("SLIDE_"), F.col("s_suppkey") * 7, F.lit(".json")).alias("name"))
    return B.pair_files(left, right, "name").select("a", "b")


@query("b12_runs", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS z FROM events), g AS (SELECT *, z - lag(z) OVER (PARTITION BY user_id ORDER BY z, event_id) AS gap FROM e),
 m AS (SELECT user_id, quantile_cont(gap, 0.5) AS mid FROM g GROUP BY 1), r AS (SELECT user_id, event_id, sum(CASE WHEN gap > 3 * mid THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY z, event_id) AS run FROM g JOIN m USING (user_id))
 SELECT user_id, run::BIGINT AS run, count(*) AS n FROM r GROUP BY 1, 2""")
def b12(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("z"))
    return B.split_runs(e, "user_id", "z", 3.0, "event_id").groupBy("user_id", "run").agg(F.count("*").alias("n"))


@query("b13_best_run", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def b13(spark, d):
    o = table(spark, d, "orders")
    return B.best_run(o, "o_custkey", (F.col("o_orderstatus") == "F").desc(), F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("b14_majority", "SELECT o_custkey, first(o_orderpriority ORDER BY n DESC, o_orderpriority) AS o_orderpriority, max(n) AS n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def b14(spark, d):
    return B.majority(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("b15_fingerprints", "SELECT substr(sha256(concat_ws('|', text, lang)), 1, 16) AS fp, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def b15(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(B.fingerprint(docs, ["text", "lang"]).alias("fp")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("b16_flat_cases", "SELECT user_id AS case, max(event_id) AS last_follow_up, min(CASE WHEN event_type = 'error' THEN event_id END) AS recurrence, first(event_type ORDER BY ts, event_id) AS diagnosis FROM events GROUP BY 1")
def b16(spark, d):
    e = table(spark, d, "events")
    nested = e.groupBy(F.col("user_id").alias("case")).agg(
        F.collect_list(F.struct(F.col("event_id").alias("days"), (F.col("event_type") == "error").alias("recurred"))).alias("follow_ups"),
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("diagnoses"),
    )
    return B.flatten_cases(nested)


@query("b17_mask_audit", """SELECT CASE WHEN n = 0 THEN 'empty' WHEN s = 0 THEN 'zero' WHEN s = 1 THEN 'single' ELSE 'usable' END AS kind, count(*) AS files FROM
 (SELECT l_orderkey, count(CASE WHEN l_linenumber > 1 THEN l_tax END) AS n, count(*) FILTER (l_linenumber > 1 AND l_tax <> 0) AS s FROM lineitem GROUP BY 1) GROUP BY 1""")
def b17(spark, d):
    v = table(spark, d, "lineitem").withColumn("v", F.when(F.col("l_linenumber") > 1, F.col("l_tax")))
    return B.audit_masks(v, "l_orderkey", "v")


@query("b18_sentences", """WITH a AS (SELECT l_orderkey AS image, l_returnflag AS category, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey) AS ann FROM lineitem WHERE l_tax > 0)
 SELECT category, ann, sent_id::INT AS sent_id, count(*) AS n, min(CASE sent_id WHEN 0 THEN category || ' in ' || image ELSE 'find ' || category END) AS raw FROM a, (VALUES (0), (1)) t(sent_id) GROUP BY 1, 2, 3""")
def b18(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("category"), F.struct("l_linenumber", "l_partkey").alias("mask"), F.col("l_tax").alias("area"))
    _, anns, sents = B.build_index(m, ["%s in %s", "find %s"])
    return sents.join(anns.select("image", "ann", "category"), ["image", "ann"]).groupBy("category", F.col("ann"), "sent_id").agg(F.count("*").alias("n"), F.min("raw").alias("raw"))


@query("b18_dense_ids", """WITH a AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey) AS ann FROM lineitem WHERE l_tax > 0)
 SELECT count(DISTINCT image) AS images, count(DISTINCT image) AS last_image, count(*) AS anns, count(*) AS last_ann, 1::BIGINT AS first_image, 1::BIGINT AS first_ann FROM a""")
def b18d(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("category"), F.struct("l_linenumber", "l_partkey").alias("mask"), F.col("l_tax").alias("area"))
    ids, anns, _ = B.build_index(m, ["%s in %s"])
    i = ids.agg(F.count_distinct("image_id").alias("images"), F.max("image_id").alias("last_image"), F.min("image_id").alias("first_image"))
    return i.crossJoin(anns.agg(F.count_distinct("ann_id").alias("anns"), F.max("ann_id").alias("last_ann"), F.min("ann_id").alias("first_ann")))


@query("b22_class_presence", """WITH v AS (SELECT l_suppkey AS scan, l_partkey, l_returnflag AS cls, sum((l_linestatus = 'F')::INT) AS votes, count(*) AS raters FROM lineitem GROUP BY 1, 2, 3), l AS (SELECT scan, l_partkey, min_by(cls, CASE cls WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS label FROM v WHERE votes * 2 >= raters GROUP BY 1, 2)
 SELECT scan, max((label = 'R')::INT) AS "R", max((label = 'A')::INT) AS "A", max((label = 'N')::INT) AS "N" FROM l GROUP BY 1""")
def b22p(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("scan"), "l_partkey", F.col("l_returnflag").alias("cls"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("vote"))
    return B.class_presence(B.priority_label(v, ["scan", "l_partkey"], ["R", "A", "N"], F.col("votes") * 2 >= F.col("raters")), ["scan"], ["R", "A", "N"])


@query("b19_selected_refs", "SELECT o_orderkey AS ann FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')")
def b19(spark, d):
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("ann"), F.col("o_orderpriority").alias("split"))
    anns = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("ann"), F.col("l_returnflag").alias("category"))
    return B.select_refs(refs, anns, ["R"], "1-URGENT").select("ann")


@query("b20_ratio_split", f"""SELECT split, c_nationkey, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM (SELECT c_custkey, c_nationkey, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY {h_sql('c_custkey', 5)}, c_custkey) <= floor(count(*) OVER (PARTITION BY c_nationkey) * 0.8)
 THEN 'train' ELSE 'test' END AS split FROM customer) GROUP BY 1, 2""")
def b20(spark, d):
    s = B.ratio_split(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 0.8, 5, "c_nationkey")
    return s.groupBy("split", "c_nationkey").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("b21_split_drift", f"""WITH a AS (SELECT c_name, CASE WHEN {h_sql('c_custkey', 1)} % 10 < 8 THEN 'train' ELSE 'test' END AS s FROM customer WHERE c_custkey % 11 <> 0), b AS (SELECT c_name, CASE WHEN {h_sql(key_number_sql('c_name'), 2)} % 10 < 8 THEN 'train' ELSE 'test' END AS s FROM customer WHERE c_custkey % 13 <> 0)
 SELECT coalesce(a.c_name, b.c_name) AS c_name, a.s AS split_a, b.s AS split_b FROM a FULL JOIN b ON a.c_name = b.c_name WHERE a.s IS DISTINCT FROM b.s""")
def b21(spark, d):
    c = table(spark, d, "customer")
    a = c.where("c_custkey % 11 <> 0").select("c_name", F.when(h("c_custkey", 1) % 10 < 8, "train").otherwise("test").alias("split"))
    b = c.where("c_custkey % 13 <> 0").select("c_name", F.when(h(key_number("c_name"), 2) % 10 < 8, "train").otherwise("test").alias("split"))
    return B.split_drift(a, b, "c_name")


@query("b22_priority_labels", """WITH v AS (SELECT l_partkey, l_returnflag AS cls, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS votes, count(*) AS raters FROM lineitem GROUP BY 1, 2)
 SELECT l_partkey, min_by(cls, CASE cls WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS label FROM v WHERE votes * 2 >= raters GROUP BY 1""")
def b22(spark, d):
    v = table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("cls"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("vote"))
    return B.priority_label(v, ["l_partkey"], ["R", "A", "N"], F.col("votes") * 2 >= F.col("raters"))


@query("b23_usable_parents", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def b23(spark, d):
    kids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return B.keep_usable(table(spark, d, "orders").select("o_orderkey"), kids, "o_orderkey", F.col("l_quantity") > 40)


@query("b24_mixture", f"""WITH s AS (SELECT o_orderpriority, count(*) AS size FROM orders GROUP BY 1), q AS (SELECT o_orderpriority, size, round(3000 * sqrt(size) / (SELECT sum(sqrt(size)) FROM s))::BIGINT AS quota FROM s),
 r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {h_sql('o_orderkey', 3)}, o_orderkey) AS rk FROM orders)
 SELECT o_orderpriority, sum(floor((quota - rk) / size) + 1)::BIGINT AS n, count(*) AS different, sum(o_orderkey)::BIGINT AS keys FROM r JOIN q USING (o_orderpriority) WHERE rk <= quota GROUP BY 1""")
def b24(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    m = B.mixture(o, "o_orderpriority", "o_orderkey", "sqrt", 3000, 3)
    return m.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("different"), F.sum(F.when(F.col("copy") == 1, F.col("o_orderkey"))).alias("keys"))


# --- outcomes ---------------------------------------------------------------------------

SURV = """(SELECT o_orderkey AS subject, (o_orderstatus = 'F')::INT AS event, 1 + abs(date_diff('day', o_orderdate::DATE, ship::DATE)) AS duration, o_orderpriority AS grp, o_totalprice AS risk
 FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def survival(spark, d):
    """(subject, event, duration, grp, risk) from orders and the earliest shipping date."""
    ship = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ship"))
    orders = table(spark, d, "orders")
    rows = orders.join(ship, "o_orderkey").withColumn("_d", 1 + F.abs(F.datediff(F.to_date("ship"), F.to_date("o_orderdate"))))
    t = C.survival_table(rows, "o_orderkey", F.col("o_orderstatus") == "F", F.col("_d"), F.col("o_orderpriority"), F.col("o_totalprice"))
    return t.join(orders.select(F.col("o_orderkey").alias("subject"), F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("risk")), "subject")


@query("c01_survival_table", f"SELECT subject, event, duration::BIGINT AS duration FROM {SURV}")
def c01(spark, d):
    return survival(spark, d).select("subject", "event", F.col("duration").cast("long"))


@query("c02_durations", "SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN value END, user_id) AS a, CASE WHEN (event_id % 3) <> 0 THEN event_id % 3 ELSE user_id END AS b FROM events")
def c02(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", C.duration(F.when(F.col("event_type") == "error", F.col("value")), F.col("user_id")).alias("a"), C.duration(F.col("event_id") % 3, F.col("user_id"), True).alias("b"))


@query("c03_min_class", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 60)")
def c03(spark, d):
    return C.min_class(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 60).select("c_custkey")


@query("c04_codes", "WITH f AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY min(c_custkey)) - 1 AS code FROM customer GROUP BY 1) SELECT c_mktsegment, code::INT AS code, count(*) AS n FROM customer JOIN f USING (c_mktsegment) GROUP BY 1, 2")
def c04(spark, d):
    return C.factorize(table(spark, d, "customer"), "c_mktsegment", "c_custkey").groupBy("c_mktsegment", "code").agg(F.count("*").alias("n"))


@query("c05_class_info", "SELECT p_brand, count(DISTINCT p_type) AS names, min(p_type) AS name, count(DISTINCT p_type) = 1 AS one_to_one FROM part GROUP BY 1")
def c05(spark, d):
    return C.class_info(table(spark, d, "part"), "p_brand", "p_type")


@query("c06_pooled", "SELECT o_custkey, round(avg(o_totalprice) * 0.01, 9) AS o_totalprice FROM orders GROUP BY 1")
def c06(spark, d):
    return C.pool(table(spark, d, "orders"), "o_custkey", ["o_totalprice"], "mean", 0.01).select("o_custkey", F.round("o_totalprice", 9).alias("o_totalprice"))


@query("c07_features_with_values", "WITH l AS (SELECT user_id, event_type AS feature, CASE WHEN value > 60 THEN value END AS v FROM events) SELECT feature, count(*) AS n, round(sum(v), 3) AS tot FROM l WHERE feature IN (SELECT feature FROM l GROUP BY 1 HAVING count(v) >= 100) GROUP BY 1")
def c07(spark, d):
    long = table(spark, d, "events").select("user_id", F.col("event_type").alias("feature"), F.when(F.col("value") > 60, F.col("value")).alias("v"))
    return C.min_nonnull(long, "feature", "v", 100).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("tot"))


@query("c07_prefixed_columns", "SELECT c_custkey, c_nationkey AS x_c_nationkey, c_mktsegment AS x_c_mktsegment FROM customer")
def c07p(spark, d):
    return C.prefix_columns(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "x_", ["c_custkey"])


@query("c08_merged_outcomes", """SELECT k, round(a, 4) AS a, b, c FROM (SELECT o_custkey AS k, avg(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) FULL JOIN (SELECT user_id AS k, count(*) AS b FROM events GROUP BY 1) USING (k)
 FULL JOIN (SELECT c_custkey AS k, c_mktsegment AS c FROM customer WHERE c_acctbal > 3000) USING (k) WHERE k IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)""")
def c08(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.avg("o_totalprice"), 4).alias("a"))
    b = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("b"))
    c = table(spark, d, "customer")
    return C.merge_outcomes([a, b, c.where("c_acctbal > 3000").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("c"))], "k", c.where("c_nationkey < 12").select(F.col("c_custkey").alias("k")))


@query("c09_class_balance", "SELECT p_brand, count(*) AS n, count(*) >= 85 AS kept FROM part GROUP BY 1")
def c09(spark, d):
    return C.class_balance(table(spark, d, "part"), "p_brand", 85)


FOLDS = f"""(WITH k AS (SELECT c_custkey, {h_sql('c_custkey', 2)} AS hh FROM customer), o AS (SELECT *, (row_number() OVER (PARTITION BY hh % 1000 ORDER BY hh, c_custkey) + hh % 1000) % 5 AS own FROM k)
 SELECT fold, CASE WHEN own = fold THEN 'test' WHEN {h_sql('(hh + fold)', 3)} % 1000 < 100 THEN 'valid' ELSE 'train' END AS role, c_custkey FROM o, (VALUES (0), (1), (2), (3), (4)) t(fold))"""


def folds(spark, d):
    return C.kfold(table(spark, d, "customer"), "c_custkey", 5, 0.1, 2)


@query("c10_folds", f"SELECT * FROM {FOLDS}")
def c10(spark, d):
    return folds(spark, d)


@query("c11_attached", f"SELECT fold, role, count(*) AS n, round(avg(a), 3) AS a FROM {FOLDS} JOIN (SELECT o_custkey AS c_custkey, max(o_totalprice) AS a FROM orders GROUP BY 1) USING (c_custkey) GROUP BY 1, 2")
def c11(spark, d):
    y = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("a"))
    return C.attach(folds(spark, d), y, "c_custkey").groupBy("fold", "role").agg(F.count("*").alias("n"), F.round(F.avg("a"), 3).alias("a"))


@query("c12_out_of_fold", f"SELECT c_custkey, fold, fold * 1000 + c_nationkey AS prediction, 1::BIGINT AS times FROM {FOLDS} JOIN customer USING (c_custkey) WHERE role = 'test'")
def c12(spark, d):
    p = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"), "c_nationkey").withColumn("prediction", F.col("fold") * 1000 + F.col("c_nationkey"))
    return C.oof(p.drop("c_nationkey"), folds(spark, d), "c_custkey")


@query("c13_common_subjects", "SELECT user_id FROM events WHERE value > 100 GROUP BY 1 HAVING count(DISTINCT event_type) = 5")
def c13(spark, d):
    return C.common_subjects(table(spark, d, "events").where("value > 100"), "user_id", "event_type", 5)
