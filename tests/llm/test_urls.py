import random
import re

import duckdb
import pytest

from cohortlake.llm import urls

URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x", "http://example.net", "http://net/", "http://notnet/x", "https://a.b.org/fr/y?q=1", "https://org/FR/",
    "http://x.example.com/de/", "http://x.example.com/de", "http://x.example.com:80/de/", "ftp://h/cgi-bin/z", "http://h/CASINO/", "http://h/a?casino", "://net/#", "http://casinos.com/", "http://ads.x.fr/",
]


def test_rules(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x")], "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, urls.op3_url(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(urls.OP3_SQL).fetchall())
    con.execute("SET threads=1")
    assert sorted(set(map(str, got))) == sorted(set(map(str, want)))
    by = {r[0]: r for r in got}
    assert by[3][1:] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[4][3:] == (None, "allow") and by[5][3:] == ("net/", "block") and by[6][3] is None
    assert by[12][4] == "block" and by[13][4] == "block" and by[14][4] == "allow" and by[16][4] == "allow"


def test_rule_is_filed_under_its_rarest_token(spark):
    df = spark.createDataFrame([(1, "http://a/cgi-bin/x")], "page_id long, url string")
    rows = urls.judge(df).collect()
    assert rows[0].fired == [12]
    assert urls.judge(df.limit(0)).count() == 0
    rules = spark.createDataFrame(urls.compile_rules([], [("block", "/cgi-bin/", ["cgi", "bin"])]), urls.RULES)
    tokens = spark.createDataFrame([("u", "cgi"), ("v", "cgi"), ("v", "bin")], "url string, token string")
    assert [r.token for r in urls.index(rules, tokens).collect()] == ["bin"]
    with pytest.raises(ValueError):
        urls.compile_rules([], [("block", ".*", [])])


def test_many_rules_against_brute_force(spark):
    """Twenty thousand rules: the plan stays one join, and verdicts are those of trying every rule."""
    rng = random.Random(6)
    hosts = [f"h{i}.t{i % 50}" for i in range(2000)]
    domain = list({f"{rng.choice([h, h.split('.')[1]])}/{rng.choice(['', 'a/', 'b/c/'])}": rng.choice(["block", "allow"]) for h in hosts * 5}.items())
    domain = [(action, rule) for rule, action in domain]
    pattern = [("block", rf"(^|/)w{i}/", [f"w{i}"]) for i in range(18000)]
    pages = [f"http://{rng.choice(['', 'x.'])}{rng.choice(hosts)}/{rng.choice(['', 'a/', 'b/', 'b/c/d'])}{rng.choice(['', f'w{rng.randrange(20000)}/'])}" for _ in range(1500)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(pages)], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, spark.createDataFrame(urls.compile_rules(domain, pattern), urls.RULES)).collect()}
    for i, u in enumerate(pages):
        host, _, path = u[7:].partition("/")
        fit = [(len(r), r, a) for a, r in domain if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and ("/" + path).startswith(r[r.index("/") :])]
        blocked = any(w in ("/" + path) and int(w[2:-1]) < 18000 for w in re.findall(r"/w\d+/", "/" + path))
        best = max(fit, default=None)
        assert got[i] == ((best[1], best[2]) if best else (None, "block" if blocked else "allow")), u
