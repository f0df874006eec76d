"""Scans: HTML folders, text tables, gold sets, stored indexes, and pages from the web."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib import robotparser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AGENT = "sparkwell/1.0"
PAGE = "url string, status int, html string, error string"

#: (url, seconds) -> (status, content type, body); raises on failure.
Fetcher = Callable[[str, float], tuple[int, str, bytes]]


def read_html(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(path, html) of all matching files; bytes that aren't UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)

    @F.arrow_udf("string")
    def decode(content: pa.Array) -> pa.Array:
        return pa.array([None if c is None else c.decode("utf-8", "ignore") for c in content.to_pylist()], pa.string())

    return files.select("path", decode("content").alias("html"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; fields may hold quotes, line breaks and white space at their ends, all are strings, and empty ones stay empty."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).na.fill("")


def read_gold_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant): a JSON array of queries and the ids relevant to each, in file order."""
    rows = spark.read.schema("query string, relevant array<long>").json(path, multiLine=True)
    return _numbered(rows)


def read_gold_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, reference)."""
    return _numbered(spark.read.schema("query string, reference string").json(path, multiLine=True))


def _numbered(rows: DataFrame) -> DataFrame:
    # one file of gold queries is one partition, whose row order this id follows
    return rows.coalesce(1).select(F.monotonically_increasing_id().alias("query_id"), *rows.columns)


def http_get(url: str, timeout: float) -> tuple[int, str, bytes]:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as r:
        return r.status, r.headers.get("Content-Type", ""), r.read()


def fetch(urls: DataFrame, url: str = "url", fetcher: Fetcher = http_get, timeout: float = 30.0, delay: float = 0.0) -> DataFrame:
    """(url, status, html, error): a page for each URL; html is null where it failed or isn't HTML.

    One request at a time in each partition, ``delay`` seconds apart; partition by host to be polite.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for b in batches:
            for u in b.column(0).to_pylist():
                status, html, error = None, None, None
                try:
                    status, kind, body = fetcher(u, timeout)
                    if 200 <= status < 300 and "text/html" in kind:
                        html = body.decode("utf-8", "replace")
                    else:
                        error = f"{status} {kind}"
                except Exception as e:  # a page that can't be had is a row like any other
                    error = repr(e)
                yield pa.RecordBatch.from_arrays([pa.array([u]), pa.array([status], pa.int32()), pa.array([html], pa.string()), pa.array([error], pa.string())], ["url", "status", "html", "error"])
                if delay:
                    time.sleep(delay)

    return urls.select(url).mapInArrow(run, PAGE)


def live(fetcher: Fetcher = http_get, timeout: float = 30.0, delay: float = 1.5) -> Callable[[DataFrame], DataFrame]:
    """A source for ``crawl`` that fetches what is asked: a host's pages one after the other, ``delay`` seconds apart."""

    def source(urls: DataFrame) -> DataFrame:
        by_host = urls.repartition(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
        return fetch(by_host, fetcher=fetcher, timeout=timeout, delay=delay).select("url", "html")

    return source


def robots_by_host(seed_urls: list[str], fetcher: Fetcher = http_get, timeout: float = 30.0) -> Callable[[Column], Column]:
    """A column function: whether the robots rules of a URL's host, one of the seeds', let it be fetched."""
    from urllib.parse import urlsplit

    host = lambda u: urlsplit(u).netloc.lower().removeprefix("www.")
    rules = {host(u): robots_rules(u, fetcher, timeout) for u in seed_urls}

    @F.arrow_udf("boolean")
    def may(urls: pa.Array) -> pa.Array:
        return pa.array([u is not None and (r := rules.get(host(u))) is not None and r.can_fetch(AGENT, u) for u in urls.to_pylist()], pa.bool_())

    return may


def robots_rules(seed_url: str, fetcher: Fetcher = http_get, timeout: float = 30.0) -> robotparser.RobotFileParser:
    """The rules of the seed's host. If they can't be had, nothing may be fetched; 401 and 403 forbid all, other 4xx nothing."""
    from urllib.error import HTTPError
    from urllib.parse import urlsplit

    p = urlsplit(seed_url)
    rules = robotparser.RobotFileParser()
    try:
        status, _, body = fetcher(f"{p.scheme}://{p.netloc}/robots.txt", timeout)
        if status in (401, 403):
            rules.disallow_all = True
        elif 400 <= status < 500:
            rules.allow_all = True
        elif status < 400:
            rules.parse(body.decode("utf-8", "ignore").splitlines())
    except HTTPError as e:
        rules.disallow_all, rules.allow_all = e.code in (401, 403), 400 <= e.code < 500 and e.code not in (401, 403)
    except Exception:  # never read: can_fetch says no
        pass
    return rules


def allowed(url: Column, rules: robotparser.RobotFileParser, agent: str = AGENT) -> Column:
    """Whether the rules let ``agent`` fetch a URL."""

    @F.arrow_udf("boolean")
    def may(urls: pa.Array) -> pa.Array:
        return pa.array([u is not None and rules.can_fetch(agent, u) for u in urls.to_pylist()], pa.bool_())

    return may(url)
