"""Host keys, suffix rules, verdicts by every level, and the rule columns against SQL."""

import duckdb
from pyspark.sql import functions as F

from tallyrow.llm import reputation

HOSTS = {
    "a.example.co.uk:8443": ("a.example.co.uk", "example.co.uk", "co.uk"),
    "user:pw@good.org": ("good.org", "good.org", "org"),
    "10.0.0.1:80": ("10.0.0.1", "10.0.0.1", "10.0.0.1"),
    "[::1]:80": ("[::1]", "[::1]", "[::1]"),
    "bad.org.": ("bad.org", "bad.org", "org"),
    "x.y.blog.io": ("x.y.blog.io", "blog.io", "io"),
    "localhost": ("localhost", "localhost", "localhost"),
    "co.uk": ("co.uk", "co.uk", "co.uk"),
    "": ("", "", ""),
}
LISTED = {
    "a.b.github.io": ("b.github.io", "github.io"),
    "x.shop.foo.ck": ("shop.foo.ck", "foo.ck"),
    "a.www.ck": ("www.ck", "ck"),
    "a.b.zz": ("b.zz", "zz"),
    "github.io": ("github.io", "github.io"),
    "10.0.0.1": ("10.0.0.1", "10.0.0.1"),
}


def test_keys_and_levels(spark):
    rows = spark.createDataFrame([(h,) for h in HOSTS], "host string").withColumn("key", reputation.key_of(F.col("host")))
    found = {r.host: (r.key, r.domain, r.suffix) for r in reputation.with_levels(rows).collect()}
    assert found == HOSTS


def test_listed_suffixes(spark):
    rules = spark.createDataFrame([(s,) for s in ("io", "GitHub.io", "ck", "*.ck", "!www.ck", None, "", "io")], "suffix string")
    keys = spark.createDataFrame([(h,) for h in LISTED], "key string")
    assert {r.key: (r.domain, r.suffix) for r in reputation.with_levels(keys, rules).collect()} == LISTED


def test_blocked_by_host_domain_and_suffix(spark):
    outcomes = [("h.mixed.org:80", 1)] * 50 + [(f"h{i}.mixed.org", 0) for i in range(50)]
    outcomes += [(f"h{i}.spam.info", 1) for i in range(40)] + [(f"s{i}.bad", 1) for i in range(60)] + [("fine.net", 0)] * 80 + [(None, 1), ("", 1), ("fine.net", None)]
    urls = ["http://h.mixed.org./a", "http://new.mixed.org", "http://me@new.spam.info:1/a", "http://new.bad/", "http://fine.net", "http://new.net", "no url", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = reputation.judge(pages, spark.createDataFrame(outcomes, "host string, bad int"), rules=())
    found = {r.page_id: r for r in rows.collect()}
    assert [found[i].verdict for i in range(8)] == ["block", "allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert found[0].host == "h.mixed.org." and found[2].host == "me@new.spam.info:1"


RULES_SQL = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, top, below) AS (VALUES ('com/', 'com', '/'), ('example.com/en/', 'example.com', '/en/'), ('www.example.com/en/', 'www.example.com', '/en/'),
  ('net/es/', 'net', '/es/'), ('net/fr/', 'net', '/fr/'))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule
FROM h LEFT JOIN r ON (host = top OR ends_with(host, '.' || top)) AND starts_with(path, below) GROUP BY ALL
"""


def test_rules_equal_sql(spark, sf_dir):
    rows = reputation.op6_url_reputation(spark, sf_dir).select("page_id", "host", "path", "rule").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    assert sorted(map(tuple, rows), key=repr) == sorted(con.execute(RULES_SQL).fetchall(), key=repr)
