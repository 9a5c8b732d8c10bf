"""Verdicts against every rule tried on every url, and against the check SQL."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from tagloom.llm import urlfilter as u
from tagloom.llm.queries import PATTERN_RULES, QUERIES, SITE_RULES, URL_SQL

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    m = re.fullmatch(r"(?s)([^/?#]*)([^?#]*)(.*)", url.split("://", 1)[1])
    return m[1].translate(UP), m[2], m[3]


def slow(url, sites, patterns):
    host, path, rest = parts(url)
    fits = [
        (len(h + p), a, h + p) for a, h, p in sites
        if url and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fits:
        _, action, rule = max(fits)
        return host, path, rule, action, None
    key = ("//" + host + path + rest).translate(UP) if host or path else None
    found = []
    for action, p in patterns:
        rx = "".join(".*" if c == "*" else "(?:[^a-z0-9]|$)" if c == "^" else re.escape(c) for c in p.lower())
        if key is not None and re.search(rx, key, re.S):
            found.append((len(p), action == "allow", p))
    if found:
        _, allowed, p = max(found)
        return host, path, None, "allow" if allowed else "block", p
    return host, path, None, "allow", None


SITES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
PATTERNS = [("block", p) for p in ("^spam-farm^", "^cheap-pills^", "^casino^", "^xxx^", "/ads/*.js^")]


def test_random_urls(spark):
    rng = random.Random(1)
    hosts = ["example.org", "a.Example.ORG", "xexample.org", "org", "x.com", "com", "spam-farm.net", "www.cheap-pills.de", "CASINO.net", "casinos.net", "", "h:80", "u@x.org"]
    ends = ["", "/", "/es/", "/ES/", "/es", "/en/1", "/en/12?q=1", "/fr/x", "/de/", "/de", "?a=/de/", "#/fr/", "/ads/x/y.js", "/ads/.jsx", "/x?xxx", "/a\nb", "//casino", "/é-casino"]
    urls = [s + h + e for s in ("http://", "", "a://b://") for h in hosts for e in ends] + [None, "", "://", "no scheme", "HTTP://spam-farm"]
    rows = list(enumerate(urls)) + [(7, rng.choice(urls)) for _ in range(40)] + [(None, urls[3])]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("token", F.lit("clash"))
    got = sorted((tuple(r) for r in u.judged(df, SITE_RULES + PATTERN_RULES).select("page_id", "url", "host", "path", "rule", "verdict", "pattern").collect()), key=str)
    assert got == sorted(((k, x, *slow(x, SITES, PATTERNS)) for k, x in rows), key=str)
    assert u.judged(df.limit(0), SITE_RULES).collect() == []


def test_tokens_are_whole_in_every_match():
    assert u.site_rule("block", "example.org", "/en/1").tokens == ("example", "org", "en")
    assert u.pattern_rule("block", "ad*server^x").tokens == ()
    assert u.pattern_rule("block", "^Ad-Server^x").tokens == ("ad", "server")


def test_rules_without_token_ties_and_no_rules(spark):
    rules = [u.pattern_rule("block", "mid"), u.pattern_rule("allow", "dle"), u.pattern_rule("block", "ddl"), u.pattern_rule("block", "*.gif^")]
    df = spark.createDataFrame([(1, "h://middle.net"), (2, "h://x.net/a.GIF"), (3, "h://x.net/a.gifs"), (4, "h://amid.net")], "id int, url string")
    got = {r.id: (r.verdict, r.pattern) for r in u.judged(df, rules).collect()}
    assert got == {1: ("allow", "dle"), 2: ("block", "*.gif^"), 3: ("allow", None), 4: ("block", "mid")}
    assert {r.verdict for r in u.judged(df, []).collect()} == {"allow"}


def test_rules_are_listed_under_their_rarest_token(spark):
    tokens = spark.createDataFrame([("common",)] * 5 + [("rare",)], "token string")
    rules = [u.pattern_rule("block", "^common^rare^"), u.pattern_rule("block", "^common^never^")]
    assert {r.rule: r.token for r in u.listed(spark, rules, tokens).collect()} == {"^common^rare^": "rare", "^common^never^": "never"}


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op3_url_filters"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, pattern, verdict FROM ({URL_SQL})").fetchall()
    got = [tuple(r) for r in QUERIES["op3_url_filters"](spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({r[5] for r in got}) == 2
