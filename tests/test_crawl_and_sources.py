from __future__ import annotations

import json
from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F

from sparkwell.operators.crawl import crawl, extract_links
from sparkwell.sources import readers, sinks


def page(*links: str, article: str = "", canonical: str = "") -> str:
    return (f'<link rel="canonical" href="{canonical}">' if canonical else "") + "".join(f'<a href="{x}">x</a>' for x in links) + (f"<article>{article}</article>" if article else "")


WEB = {
    "https://x.com/s": page("/s/a", "/s/b", "/other", "https://y.com/s/z", "/s/file.pdf", article="root"),
    "https://x.com/s/a": page("/s/c", "/s", article="A", canonical="C1"),
    "https://x.com/s/b": page("/s/d", article="B", canonical="C1"),
    "https://x.com/s/c": page("/s/e", article="root"),
    "https://x.com/s/d": page(article="D"),
    "https://x.com/s/e": page(article="E"),
}


def saved(spark, **options):
    seeds = spark.createDataFrame([("http://www.x.com/s/", "/s/", "gov")], "url string, path_prefix string, source_authority string")
    pages = spark.createDataFrame(list(WEB.items()), "url string, html string")
    return {(r["url"].removeprefix("https://x.com"), r["depth"]): r for r in crawl(seeds, pages, **options).collect()}


def test_duplicates_neither_count_nor_expand(spark):
    got = saved(spark)
    assert set(got) == {("/s", 0), ("/s/a", 1)}  # b repeats a's canonical link, c the root's article
    assert got["/s/a", 1]["parent_url"] == "https://x.com/s" and got["/s", 0]["source_authority"] == "gov"


def test_limits(spark):
    assert set(saved(spark, max_pages=1)) == {("/s", 0)}
    assert set(saved(spark, max_depth=0)) == {("/s", 0)}
    assert set(saved(spark, robots=lambda u: ~u.endswith("/a"))) == {("/s", 0), ("/s/b", 1), ("/s/d", 2)}


def test_live_crawl(spark, tmp_path):
    """Only pages of the levels reached are asked for, once each, and robots rules hold."""
    log = str(tmp_path / "log")

    def get(url, timeout):
        with open(log, "a") as f:
            f.write(url + "\n")
        if url.endswith("/robots.txt"):
            return 200, "text/plain", b"User-agent: *\nDisallow: /s/d\n"
        return (200, "text/html", WEB[url].encode()) if url in WEB else (404, "text/html", b"")

    seeds = spark.createDataFrame([("https://x.com/s", "/s/"), ("https://www.x.com/s/b", "/s/")], "url string, path_prefix string")
    robots = readers.robots_by_host(["https://x.com/s"], fetcher=get)
    rows = crawl(seeds, readers.live(get, delay=0.0), robots=robots).collect()
    assert {(r["seed_url"][13:], r["url"][13:], r["depth"]) for r in rows} == {("/s", "/s", 0), ("/s", "/s/a", 1), ("/s/b", "/s/b", 0)}
    asked = open(log).read().split()
    assert sorted(asked) == sorted(f"https://x.com{p}" for p in ("/robots.txt", "/s", "/s/a", "/s/b", "/s/b", "/s/c"))


def test_one_of_pages_with_one_url(spark):
    seeds = spark.createDataFrame([("https://x.com/s",)], "url string")
    pages = [("https://www.x.com/s/", page(article="second")), ("https://x.com/s", page(article="third")), ("https://www.x.com/s", page(article="first"))]
    for order in (pages, pages[::-1]):
        assert "first" in crawl(seeds, spark.createDataFrame(order, "url string, html string").repartition(3)).first()["html"]


def test_links(spark):
    df = spark.createDataFrame([("https://example.com/page", '<a href="/a">1</a><a href="/a#x">2</a><a href="https://example.com/b/">3</a><a href="#f">4</a><a href="tel:1">5</a>')], "url string, html string")
    assert [r["link"] for r in extract_links(df).orderBy("pos").collect()] == ["https://example.com/a", "https://example.com/b"]


def test_fetch(spark):
    def fetcher(url, timeout):
        if "bad" in url:
            raise TimeoutError("slow")
        return (200, "text/html; charset=utf-8", b"<p>hi</p>") if "page" in url else (200, "image/png", b"")

    urls = spark.createDataFrame([("https://a/page",), ("https://a/img",), ("https://a/bad",)], "url string")
    rows = {r["url"][10:]: r for r in readers.fetch(urls, fetcher=fetcher).collect()}
    assert rows["page"]["html"] == "<p>hi</p>" and rows["img"]["html"] is None and "slow" in rows["bad"]["error"]


@pytest.mark.parametrize(("answer", "want"), [((200, "", b"User-agent: *\nDisallow: /private"), (True, False)), ((404, "", b""), (True, True)), ((403, "", b""), (False, False)), (TimeoutError(), (False, False)), (HTTPError("", 404, "", None, None), (True, True))])
def test_robots(spark, answer, want):
    def fetcher(url, timeout):
        if isinstance(answer, Exception):
            raise answer
        return answer

    rules = readers.robots_rules("https://x.com/s", fetcher)
    got = spark.createDataFrame([("https://x.com/a",), ("https://x.com/private/b",)], "u string").select(readers.allowed(F.col("u"), rules).alias("ok")).collect()
    assert tuple(r["ok"] for r in got) == want


def test_files(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.html").write_bytes(b"<p>caf\xc3\xa9 \xff</p>")
    (tmp_path / "h/b.txt").write_text("no")
    assert [r["html"] for r in readers.read_html(spark, str(tmp_path / "h")).collect()] == ["<p>café </p>"]
    df = spark.createDataFrame([("a\nb", 'say "hi", you', ""), ("", None, "x")], "p string, q string, r string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "csv")).collect())) == [("", "", "x"), ("a\nb", 'say "hi", you', "")]
    (tmp_path / "q.json").write_text(json.dumps([{"query": "one", "relevant": [1, 2]}, {"query": "two", "relevant": []}]))
    assert [tuple(r) for r in readers.read_gold_queries(spark, str(tmp_path / "q.json")).orderBy("query_id").collect()] == [(0, "one", [1, 2]), (1, "two", [])]
    sinks.write_pages(spark.createDataFrame([("https://x.com/a", "<p>")], "url string, html string"), str(tmp_path / "pages"))
    row = spark.read.parquet(str(tmp_path / "pages")).first()
    assert row["host"] == "x.com" and row["slug"].startswith("x.com__a__")
