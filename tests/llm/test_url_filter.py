from __future__ import annotations

import random

import pytest

from sparkwell.llm.url_filter import filter_urls

LIST = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("Example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")]


def verdicts(spark, urls, listed=LIST, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = filter_urls(pages, spark.createDataFrame(listed, "host string, path string, verdict string"), **options)
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out.orderBy("page_id").collect()]


def brute(url, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
    path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in ((h.lower(), p, v) for h, p, v in listed if h) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[3:] if fits else (None, "allow"))


@pytest.mark.parametrize("limit", [0, 1000])
def test_same_as_brute_force(spark, limit):
    rng = random.Random(4)
    urls = [None, "", "no scheme", "http://", "http://ORG", "x://a.org?q://b.com/de/", "https://xorg/", "http://Ümlaut.ORG/é", "a://b://c.com/de/"]
    urls += [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'www.', 'a.b.', 'my'])}{rng.choice(['example.org', 'example.com', 'org', 'com', 'EXAMPLE.net'])}{rng.choice(['', '/', '/es/', '/es', '/en/1', '/en/12/x', '/en/2', '/fr/a', '/de/b?x#y', '?/de/', '#a'])}" for _ in range(300)]
    assert verdicts(spark, urls, broadcast_rows=limit) == [brute(u, LIST) for u in urls]


def test_hostile_urls(spark):
    """A host of very many labels has no more candidates than the list has forms."""
    urls = ["http://" + "a." * 50_000 + "com/de/x", "http://" + "." * 5_000, "http://" + "x" * 100_000 + ".org/" + "y" * 100_000, "http://.org/", "http://org./", "http://a..com/fr/"]
    for limit in (0, 1000):
        assert verdicts(spark, urls, broadcast_rows=limit) == [brute(u, LIST) for u in urls]


def test_pages_without_a_possible_hit_stay(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.com/de/")], "page_id long, url string")
    plan = filter_urls(pages, spark.createDataFrame(LIST, "host string, path string, verdict string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_filter_full_of_bits_is_still_exact(spark):
    urls = [f"http://h{i}.com/p" for i in range(50)]
    listed = [(f"h{i}.com", "/p", "block") for i in range(0, 50, 2)]
    assert [v[3] for v in verdicts(spark, urls, listed, filter_bytes=1, bits_per_url=0.1)] == ["block", "allow"] * 25


def test_no_pages_no_list_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(empty, spark.createDataFrame(LIST, "host string, path string, verdict string")).count() == 0
    odd = spark.createDataFrame([(1, "http://a.org/x", "old", "key", "q")] * 3, "page_id long, url string, verdict string, key string, `a.b` string")
    out = filter_urls(odd, spark.createDataFrame(LIST, "host string, path string, verdict string"))
    assert out.columns == ["page_id", "url", "key", "a.b", "host", "path", "rule", "verdict"]
    assert [(r["verdict"], r["rule"], r["key"]) for r in out.collect()] == [("allow", "org/", "key")] * 3


def test_empty_list_allows_everything(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    out = filter_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).first()
    assert (out["host"], out["path"], out["rule"], out["verdict"]) == ("a.org", "/x", None, "allow")
