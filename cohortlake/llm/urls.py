"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a row of a table, as many as one likes: a domain rule (host and start of the path) or
a regular expression over ``host + path``, with the literal tokens that a fitting URL must hold.
The tokens are counted over all distinct URLs, and every rule is filed under its rarest one.
URLs meet the index in a join on their own tokens; only the rules so fetched are tried, and
only those with a pattern run a regular expression.

Nulls and empties: a null URL, or one without ``://``, has an empty host and path and gets
the default verdict.  Repeated rows each get their verdict.  A rule without a literal token
is an error.  Input columns named like the added ones give way to them.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, table, without

DOMAIN_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: (action, pattern over the lower-cased host and path, literal tokens that it needs)
PATTERN_RULES = [
    ("block", r"(^|[./_-])ads[./_-]", ["ads"]),
    ("block", r"(^|[./_-])adserver[./_-]", ["adserver"]),
    ("block", r"(^|[./_-])casino([./_-]|$)", ["casino"]),
    ("block", r"(^|[./_-])poker([./_-]|$)", ["poker"]),
    ("block", r"(^|[./_-])porn([./_-]|$)", ["porn"]),
    ("block", r"(^|[./_-])xxx([./_-]|$)", ["xxx"]),
    ("block", r"(^|[./_-])warez([./_-]|$)", ["warez"]),
    ("block", r"/wp-login\.php$", ["wp", "login", "php"]),
    ("block", r"/cgi-bin/", ["cgi", "bin"]),
    ("block", r"(^|[./_-])torrent([./_-]|$)", ["torrent"]),
]
TOKENS = r"[^a-z0-9]+"


def host_path() -> tuple[Column, Column]:
    """Host and path of column ``url``."""
    url = F.col("url")
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


RULES = "id long, action string, rule string, host string, path string, pattern string, tokens array<string>"


def compile_rules(domain_rules=DOMAIN_RULES, pattern_rules=PATTERN_RULES) -> list[tuple]:
    """Rows of a rule table; a domain rule fits its host, all subdomains and paths that start with its own."""
    rules = []
    for action, rule in domain_rules:
        host, _, path = rule.partition("/")
        path = f"/{path}"
        # The last piece of the path may go on in the URL, so it is no token of its own there.
        literal = re.split(TOKENS, host.lower()) + re.split(TOKENS, path.lower())[:-1]
        rules.append((action, rule, host.lower(), path, None, [t for t in literal if t]))
    for action, pattern, tokens in pattern_rules:
        rules.append((action, None, None, None, f"(?i){pattern}", tokens))
    if any(not r[-1] for r in rules):
        raise ValueError("a rule needs a literal token")
    return [(i, *r) for i, r in enumerate(rules)]


def index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rules with ``token``, the rarest of theirs in ``tokens`` (url, token)."""
    own = rules.select("id", F.explode("tokens").alias("token"))
    seen = tokens.join(own.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = own.join(seen, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("t"))
    return rules.join(rarest.select("id", "t.token"), "id")


def judge(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule (the longest fitting domain rule), verdict and ``fired`` (rule ids)."""
    rules = pages.sparkSession.createDataFrame(compile_rules(), RULES) if rules is None else rules
    pages = without(pages, "host", "path", "rule", "verdict", "fired")
    host, path = host_path()
    urls = pages.select("url").where("url is not null").distinct().withColumn("h", host).withColumn("p", path).withColumn("key", F.concat("h", "p"))
    tokens = urls.select("url", "h", "p", "key", F.explode(F.array_distinct(F.split(F.lower("key"), TOKENS))).alias("token")).where("token <> ''")
    met = tokens.join(index(rules, tokens.select("url", "token")), "token")
    domain = ((F.col("h") == F.col("host")) | F.endswith("h", F.concat(F.lit("."), "host"))) & F.startswith("p", F.col("path"))
    fits = met.where(F.when(F.col("pattern").isNull(), domain).otherwise(F.call_function("rlike", F.col("key"), F.col("pattern"))))
    named = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("rank"), "rule", "action"))
    best = fits.groupBy(F.col("url").alias("_url")).agg(F.max(named).alias("_best"), F.bool_or(F.col("rule").isNull() & (F.col("action") == "block")).alias("_blocked"), F.array_sort(F.collect_set("id")).alias("_fired"))
    u, b, bl, f = fresh(pages, "u", "best", "blocked", "hits")
    out = pages.join(best.withColumnsRenamed({"_url": u, "_best": b, "_blocked": bl, "_fired": f}), F.col("url") == F.col(u), "left")
    verdict = F.when(F.col(b).isNotNull(), F.col(f"{b}.action")).when(F.col(bl), "block").otherwise("allow")
    return out.select(*(F.col(f"`{c}`") for c in pages.columns), host.alias("host"), path.alias("path"), F.col(f"{b}.rule").alias("rule"), verdict.alias("verdict"), F.coalesce(f, F.array().cast("array<long>")).alias("fired"))


def op3_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(action, rule, rhost, rpath) AS (VALUES ('block','net/','net','/'), ('allow','example.net/en/','example.net','/en/'), ('block','example.com/de/','example.com','/de/'), ('allow','org/fr/','org','/fr/')),
m AS (SELECT page_id, arg_max(action, length(rule)) AS action, arg_max(rule, length(rule)) AS rule
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
p(pat) AS (VALUES ('(^|[./_-])ads[./_-]'), ('(^|[./_-])adserver[./_-]'), ('(^|[./_-])casino([./_-]|$)'), ('(^|[./_-])poker([./_-]|$)'),
  ('(^|[./_-])porn([./_-]|$)'), ('(^|[./_-])xxx([./_-]|$)'), ('(^|[./_-])warez([./_-]|$)'), ('/wp-login\.php$'), ('/cgi-bin/'), ('(^|[./_-])torrent([./_-]|$)')),
b AS (SELECT DISTINCT page_id FROM h JOIN p ON regexp_matches(host || path, '(?i)' || pat))
SELECT h.page_id, host, path, rule, coalesce(action, CASE WHEN b.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m USING (page_id) LEFT JOIN b ON b.page_id = h.page_id
"""
