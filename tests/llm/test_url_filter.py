import numpy as np
import pytest
from pyspark.sql import functions as F

from tableloom.llm.bloom import BlockedBloom
from tableloom.llm.url_filter import Rule, judge_urls

RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"))
URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/Page.html?x=1#y", "https://example.com/Page", "a://b.net",
    "a://b.net/", "a://sub.example.net/en/x", "a://badexample.net/en/x", "a://example.net/en", "x://m.example.com/de/1",
    "x://example.com:80/de/1", "x://host?query/path", "x://host#frag", "two://first/://second/", "x://Ünï.org/ß",
    "line\nbreak://h.org/p", "x://h.org/" + "p" * 100_000,
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    end = min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:end] if end > cut else ""


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_verdicts(spark, max_bytes):
    pages = spark.createDataFrame([(i, u, "h", "c") for i, u in enumerate(URLS)], "page_id long, url string, host string, canonical string")
    listed = spark.createDataFrame([("example.com/Page",), ("h.org/p",), ("example.com/Page",), (None,)], "canonical string")
    found = judge_urls(pages, listed, RULES, max_filter_bytes=max_bytes).collect()
    assert len(found) == len(URLS)
    for r in found:
        host, path = plain(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        fits = [x for x in RULES if ("." + host).endswith("." + x.host) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.name), default=None)
        assert r.rule == (rule.name if rule else None)
        hit = URLS[r.page_id] and host.removeprefix("www.") + path.removesuffix(".html") in ("example.com/Page", "h.org/p")
        assert r.verdict == (rule.verdict if rule else "block" if hit else "allow")


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    listed = spark.createDataFrame([], "canonical string")
    assert judge_urls(pages, listed, RULES).collect() == []
    one = spark.createDataFrame([(None, "a://b.org/")], "page_id long, url string")
    assert [tuple(r)[3:5] for r in judge_urls(one, listed, RULES).collect()] == [(None, "allow")]


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("host/"), "id").alias("canonical"))
    bloom = BlockedBloom.build(listed, "canonical")
    keys = spark.range(40_000).select("id", F.concat(F.lit("host/"), "id").alias("c"))
    rows = keys.select("id", F.xxhash64("c").alias("p"), F.xxhash64(F.lit(1), "c").alias("b")).toPandas()
    held = bloom.may_hold(rows["p"].to_numpy(), rows["b"].to_numpy())
    inside = rows["id"].to_numpy() < 20_000
    assert held[inside].all() and np.mean(held[~inside]) < 0.01
