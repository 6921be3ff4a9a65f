"""Host reputation: rules and parts against Python, shrinkage on planted hosts."""

import re

import pytest
from cases import SF, table
from pyspark.sql import functions as F

from poicraft.llm import urlrep as U
from poicraft.llm.queries import ORACLE_SQL, QUERIES


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_query(spark):
    rows = {r.page_id: r for r in QUERIES["op7_host_reputation"](spark, SF).collect()}
    pages = table("pages")
    assert len(rows) == len(pages)
    for page_id, url in zip(pages.page_id, pages.url):
        r, (host, path) = rows[page_id], parts(url)
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name) and r.verdict in ("allow", "block")
        assert name is None or r.verdict == verdict


@pytest.mark.parametrize("url", [
    "http://A.B.example.COM/de/x?y#z", "https://net", "https://net/", "x://example.net/en/", "x://example.net/en", "x://notexample.net/en/a",
    "https://org/fr/", "ftp://u:p@h.org:80/fr/?", "http://?q", "http://#", "no scheme", "", None, "a://b://c/d", "http://É.org/fr/É", "http://h.org\n/fr/"])
def test_hard_urls(spark, url):
    df = spark.createDataFrame([(1, url)], "page_id int, url string")
    host, path = U.host_path(F.col("url"))
    r = df.select(host.alias("h"), path.alias("p")).select("h", "p", U.fitting_rule(F.col("h"), F.col("p"))[0].alias("r")).first()
    assert (r.h, r.p) == parts(url) and r.r == rule(*parts(url))[0]


def test_shrinkage(spark):
    """Bad hosts are blocked, a host with one bad page is not, an unseen host follows its domain."""
    rows = [(f"http://bad{i % 3}.spam.com/{i}", 1) for i in range(90)] + [(f"http://site{i % 30}.good.com/{i}", int(i % 20 == 0)) for i in range(600)]
    rows += [("http://site99.good.com/", 1), ("http://new.spam.com/", None), ("http://new.good.com/", None), ("http://other.org/", None)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id int, url string")
    outcomes = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)] + [(0, 0), (None, 1)], "page_id int, bad int")
    got = {r.host: r for r in U.judge_urls(pages, outcomes, rules=()).collect()}
    assert all(got[f"bad{i}.spam.com"].verdict == "block" for i in range(3))
    assert got["site99.good.com"].verdict == "allow" and 0.05 < got["site99.good.com"].rate < 0.9
    assert got["new.spam.com"].rate > 0.5 > got["other.org"].rate > got["new.good.com"].rate
    assert all(r.low <= r.rate <= r.high for r in got.values())
    assert got["bad0.spam.com"].n_labelled == 30 and got["bad0.spam.com"].n_bad == 30


def test_odd_rows_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "http://a.net/"), (3, "http://x.com/" + "y" * 200_000)],
                                  "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("bad", F.lit(1)).withColumn("n", F.lit(2))
    outcomes = spark.createDataFrame([(1, None), (2, 1)], "page_id bigint, bad int")
    rows = U.judge_urls(pages, outcomes).collect()
    assert len(rows) == 5 and sorted((r.host, r.verdict) for r in rows)[-2:] == [("a.net", "block"), ("x.com", "allow")]
    assert len(U.judge_urls(pages, outcomes.limit(0)).collect()) == 5
    assert U.judge_urls(pages.limit(0), outcomes).count() == 0


def test_oracle_sql(spark):
    import duckdb
    for sf in (SF, "/root/testdata/sf0.1"):
        con = duckdb.connect()
        for t in ("pages", "labels"):
            con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
        want = con.execute(ORACLE_SQL["op7_host_reputation"])
        names = [d[0] for d in want.description]
        got = [tuple(r[n] for n in names) for r in QUERIES["op7_host_reputation"](spark, sf).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("host, domain, suffix", [
    ("bad.com:8004", "bad.com", "com"), ("u:p@a.bad.com:80", "bad.com", "com"), ("a.bad.com.", "bad.com", "com"), ("x.shop.co.uk", "shop.co.uk", "co.uk"),
    ("co.uk", "co.uk", "co.uk"), ("a.b.example.com.br:1", "example.com.br", "com.br"), ("10.0.0.1:8080", "10.0.0.1", "ip"), ("[::1]:80", "[::1]", "ip"),
    ("localhost", "localhost", "localhost"), ("", "", "")])
def test_domains_and_suffixes(spark, host, domain, suffix):
    site = U.site_of(F.col("h"))
    r = spark.createDataFrame([(host,)], "h string").select(U.domain_of(site).alias("d"), U.suffix_of(site).alias("s")).first()
    assert (r.d, r.s) == (domain, suffix)


def test_ports_share_evidence_and_neighbours_under_a_suffix_do_not(spark):
    rows = [(f"http://bad.com:{8000 + i % 5}/{i}", 1) for i in range(60)] + [(f"http://spam.co.uk/{i}", 1) for i in range(60)]
    rows += [(f"http://good{i % 9}.co.uk/{i}", 0) for i in range(90)] + [("http://www.bad.com/", None), ("http://new.co.uk/", None)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id int, url string")
    outcomes = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "page_id int, bad int")
    got = {r.host: r for r in U.judge_urls(pages, outcomes, rules=()).collect()}
    assert got["www.bad.com"].rate > 0.8 and got["new.co.uk"].rate < 0.6 < got["spam.co.uk"].rate
