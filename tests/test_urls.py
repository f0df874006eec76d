from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkwell.functions import urls as U


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "u string").select(f(F.col("u")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://x.com/a#frag", "https://x.com/a"),
        ("https://www.x.com/a", "https://x.com/a"),
        ("HTTPS://X.COM/Foo", "https://x.com/Foo"),
        ("http://x.com/a", "https://x.com/a"),
        ("https://x.com:443/a", "https://x.com/a"),
        ("http://x.com:80/", "https://x.com:80/"),
        ("https://x.com:8080/a", "https://x.com:8080/a"),
        ("https://x.com/", "https://x.com/"),
        ("https://x.com", "https://x.com/"),
        ("https://x.com/a/", "https://x.com/a"),
        ("https://x.com/a/../b/./c//d", "https://x.com/b/c/d"),
        ("https://x.com/../../b", "https://x.com/b"),
        ("https://x.com//a", "https://x.com//a"),
        ("https://x.com///a", "https://x.com/a"),
        ("https://user:pw@x.com/a?q=1", "https://x.com/a"),
        ("ftp://x.com/a", "ftp://x.com/a"),
        (None, None),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize_url, url) == want


def test_slugs(spark):
    slug = one(spark, U.slugify, "https://www.example.com/a/b/c")
    assert slug.startswith("example.com__a_b_c__") and len(slug.rsplit("__", 1)[1]) == 8
    assert "__index__" in one(spark, U.slugify, "https://example.com/")
    assert one(spark, U.slugify, "http://example.com/a/") == one(spark, U.slugify, "https://www.example.com/a#x")


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://site.gov/students/work/opt", True),
        ("https://www.site.gov/students", True),
        ("https://other.com/students/page", False),
        ("https://site.gov/schools/page", False),
        ("https://site.gov/studentsother", False),
        ("https://site.gov/students/file.PDF", False),
        ("ftp://site.gov/students/x", False),
    ],
)
def test_crawlable(spark, url, want):
    assert one(spark, lambda u: U.is_crawlable(u, F.lit("site.gov"), F.lit("/students/")), url) is want


def test_crawlable_without_prefix(spark):
    assert one(spark, lambda u: U.is_crawlable(u, F.lit("site.gov"), F.lit("")), "https://site.gov/anything") is True


@pytest.mark.parametrize(("url", "want"), [("https://x.gov/students/work/page", "work"), ("https://x.gov/students", ""), ("https://x.gov/about", ""), ("https://x.gov/students/students/a", "students"), (None, "")])
def test_topic(spark, url, want):
    assert one(spark, U.topic_of, url) == want


@pytest.mark.parametrize(
    ("href", "want"),
    [("/b", "https://x.com/b"), ("c", "https://x.com/a/c"), ("../c", "https://x.com/a/../c"), ("//y.com/z", "https://y.com/z"), ("https://y.com/", "https://y.com/"), ("?q=1", "https://x.com/a/p?q=1")],
)
def test_resolve(spark, href, want):
    assert one(spark, lambda u: U.resolve(u, F.lit("https://x.com/a/p?old#f")), href) == want
