import re

from pyspark.sql import functions as F

from cartograph.llm.queries import URL_RULES, op7_urls
from cartograph.llm.url_filter import judge_urls


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [
        (rule, verdict) for rule, verdict in URL_RULES
        if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])
    ]
    rule, verdict = max(fit, key=lambda r: len(r[0]), default=(None, None))
    return host, path, rule, verdict


def test_rules(spark, sf):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op7_urls(spark, sf).collect():
        want = expected(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == want[:3] and r["verdict"] == (want[3] or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG", "http://Example.ORG/ES/x", "http://example.org/es/x?y#z", "http://notexample.org/es/",
        "http://a.example.org/en/12", "x://com/fr/", "http://foo.com/de/1", "a://b://c/d", "http://ÀB.org/", "http://h?q/../", "http://h#f", "http://org", "http://h.net/a\nb",
    ]
    df = spark.createDataFrame([(k, u, "own") for k, u in enumerate(urls * 2)], "page_id long, url string, verdict string")
    for r in judge_urls(df, URL_RULES).collect():
        want = expected(r["url"])
        assert (r["host"], r["path"], r["rule"]) == want[:3] and r["verdict"] == (want[3] or r["verdict"])
    assert judge_urls(df.where("page_id < 0"), URL_RULES).count() == 0
    assert {r["verdict"] for r in judge_urls(df, []).collect()} == {"allow"}


def test_models_follow_their_samples(spark):
    good = [(f"http://news.site{k}.net/story/{k}", 1) for k in range(60)]
    bad = [(f"http://win-cash{k}.biz/casino?bonus={k}", 0) for k in range(60)]
    labelled = spark.createDataFrame(good + bad, "url string, label int")
    asked = spark.createDataFrame([(0, "http://news.site999.net/story/1"), (1, "http://win-cash777.biz/casino?bonus=5")], "page_id long, url string")
    assert [r["verdict"] for r in judge_urls(asked, [], labelled=labelled).orderBy("page_id").collect()] == ["allow", "block"]


def test_very_long_and_empty(spark):
    """A url of a million characters is read whole; an empty path fits no rule."""
    long = "http://x.org/" + "a/b" * 350_000
    df = spark.createDataFrame([(1, long), (2, "http://x.org?q"), (3, "http://y.com/fr/1"), (4, "http://y.com/de/2")], "page_id long, url string")
    rows = {r["page_id"]: r for r in judge_urls(df.withColumn("rule", F.lit("own")), URL_RULES).collect()}
    assert rows[1]["path"] == long[12:] and rows[1]["rule"] == "org/" and (rows[2]["path"], rows[2]["rule"]) == ("", None)
    assert judge_urls(df.where("page_id < 0"), URL_RULES).count() == 0
