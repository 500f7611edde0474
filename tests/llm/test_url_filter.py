import duckdb
import pandas as pd
import pytest

from tessitura.llm import url_filter as U

URLS = [
    (1, "http://a.net/x"), (2, "https://EXAMPLE.net/en/1?q"), (3, "https://b.example.net/enx"), (4, "http://example.com/de/1"), (5, "http://example.com/den"),
    (6, "http://x.org/fr/"), (7, "http://net"), (8, None), (9, "no scheme"), (10, "http://a.com/xxx"), (11, "http://a.com/xxxx"), (12, "http://ads-track.com/"),
    (13, "http://ads.com/ads"), (14, "http://sub.example.com:80/de/"), (15, "ftp://u@h/p#f"), (16, "://"), (17, "http://notexample.com/de/"), (18, ""), (18, ""),
]


def test_rules_and_terms(spark):
    out = {r["page_id"]: r for r in U.url_verdicts(spark.createDataFrame(URLS, "page_id bigint, url string")).collect()}
    assert (out[2]["host"], out[2]["path"], out[2]["rule"], out[2]["verdict"]) == ("example.net", "/en/1", "example.net/en/", "allow")
    assert out[1]["rule"] == "net/" and out[1]["verdict"] == "block"
    assert out[3]["rule"] == "net/" and out[4]["verdict"] == "block" and out[5]["rule"] is None
    assert out[6]["rule"] == "org/fr/" and out[7]["rule"] is None  # an empty path doesn't begin with /
    assert (out[8]["host"], out[8]["path"], out[8]["verdict"]) == ("", "", "allow")
    assert out[10]["verdict"] == "block" and out[11]["verdict"] == "allow"
    assert out[12]["verdict"] == "block" and out[13]["verdict"] == "allow"  # one term counts once
    assert out[14]["rule"] is None and out[14]["host"] == "sub.example.com:80"
    assert out[17]["rule"] is None


def test_equals_sql(spark):
    got = U.url_verdicts(spark.createDataFrame(URLS, "page_id bigint, url string")).select("page_id", "host", "path", "rule", "verdict").toPandas()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(URLS, columns=["page_id", "url"]))
    want = con.execute(U.oracle()).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.astype(object).where(got.notna(), None).values.tolist())) == sorted(map(key, want))


def test_filter_keeps_columns_and_empty_input(spark):
    df = spark.createDataFrame([(1, "http://a.com/", "clash")], "page_id bigint, url string, verdict string")
    assert U.allowed_pages(df).collect() == df.collect()
    assert U.url_verdicts(df.limit(0)).count() == 0


@pytest.mark.parametrize("url,blocked", [("http://a.b/?q=porn", True), ("http://a.b/spornx", False), ("http://PORN.b/", True), ("xxx", True)])
def test_boundaries(spark, url, blocked):
    assert (U.url_verdicts(spark.createDataFrame([(1, url)], "page_id int, url string")).first()["verdict"] == "block") == blocked


def test_vocabulary_of_a_table(spark):
    terms = spark.createDataFrame([("bad", None), ("mild", 1), ("worse", 2), ("worse", 2), ("", 1)], "term string, weight int")
    found = U.vocabulary(terms)
    assert found == {"strict": ["bad"], "soft": {"mild": 1, "worse": 2}}
    df = spark.createDataFrame([(1, "http://a.b/bad"), (2, "http://a.b/mild"), (3, "http://a.b/mild/worse"), (4, "http://a.b/worse-worse")], "page_id int, url string")
    out = {r["page_id"]: r["verdict"] for r in U.url_verdicts(df, soft_limit=3, **found).collect()}
    assert out == {1: "block", 2: "allow", 3: "block", 4: "allow"}
    with pytest.raises(ValueError):
        U.vocabulary(terms, most=2)


def test_vocabulary_of_odd_rows(spark):
    """Capitals, several weights, strict and soft at once, nulls; and what the terms then do."""
    terms = spark.createDataFrame([("Casino", None), ("bet", 1), ("BET", 3), ("both", 2), ("Both", None), (None, 1), (None, None), ("", None), ("\u00c4b", 1)], "term string, weight int")
    found = U.vocabulary(terms)
    assert found == {"strict": ["both", "casino"], "soft": {"bet": 3, "\u00c4b": 1}}
    df = spark.createDataFrame([(1, "http://casino.com"), (2, "http://a.b/bet"), (3, "http://a.b/BOTH"), (4, "http://a.b/")], "page_id int, url string")
    out = {r["page_id"]: r["verdict"] for r in U.url_verdicts(df, soft_limit=3, **found).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "allow"}
    assert U.vocabulary(terms.limit(0)) == {"strict": [], "soft": {}}


def test_long_urls(spark):
    long = "http://" + "a." * 100_000 + "net/" + "x" * 100_000 + "/porn"
    r = U.url_verdicts(spark.createDataFrame([(1, long)], "page_id int, url string")).first()
    assert (r["rule"], r["verdict"], r["n_strict"], len(r["host"])) == ("net/", "block", 1, 200_003)
