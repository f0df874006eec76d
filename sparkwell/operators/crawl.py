"""Breadth-first crawl as joins, one level at a time, over a page source."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.html import page_facts
from ..lineage import Workspace

KEPT = "seed_url string, url string, depth int, parent_url string, seq long, canonical string, article_hash string"
KEPT_NAMES = [c.split()[0] for c in KEPT.split(", ")]
#: What gives (url, html) for a table of distinct (url).
Source = Callable[[DataFrame], DataFrame]


def keep_new(batches: Iterator[pa.RecordBatch], max_pages: int) -> Iterator[pa.RecordBatch]:
    """Of each seed's pages of a level, those that are kept: duplicates by canonical link or article are left out.

    Rows are (seed_url, old, ..., canonical, article_hash), sorted by seed, those kept before (``old``) first, then by place.
    A page left out registers nothing, so this is a fold, not two windows. What is held is one
    seed's links and hashes of at most ``max_pages`` pages, however many seeds a task has.
    """
    at, n, canonicals, hashes = None, 0, set(), set()
    for b in batches:
        columns = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("seed_url", "old", "canonical", "article_hash"))
        kept = []
        for i, (seed, old, canonical, article) in enumerate(zip(*columns, strict=True)):
            if seed != at:
                at, n, canonicals, hashes = seed, 0, set(), set()
            if not old and (n >= max_pages or (canonical and canonical in canonicals) or (article and article in hashes)):
                continue
            n += 1
            if canonical:
                canonicals.add(canonical)
            if article:
                hashes.add(article)
            if not old:
                kept.append(i)
        yield b.take(pa.array(kept, pa.int64())).select(KEPT_NAMES)


def snapshot(pages: DataFrame, ws: Workspace) -> Source:
    """Pages at hand as a source: URLs are normalised once; of several that are one then, the first in order holds."""
    known = pages.where("html IS NOT NULL").select(U.normalize_url(F.col("url")).alias("url"), F.col("url").alias("raw"), "html")
    held = ws.cut(known.groupBy("url").agg(F.min_by("html", F.struct("raw", F.xxhash64("html"))).alias("html")), "snapshot")
    return lambda urls: urls.join(held, "url")


def crawl(seeds: DataFrame, pages: DataFrame | Source, max_depth: int = 8, max_pages: int = 80, robots=None) -> DataFrame:
    """(seed_url, url, depth, parent_url, seq, canonical, article_hash, html) and the seed's further columns.

    ``seeds`` has ``url`` and maybe ``path_prefix``. ``pages``: a table of ``url`` and ``html``, or
    a source that is asked for the URLs of each level and for no others, such as
    ``sources.readers.live``, which fetches them. Per seed at most ``max_pages`` pages are kept,
    and a seed that has as many asks for no more; links are followed in document order from kept pages only.
    ``robots``: a function from a URL column to a boolean column.
    """
    spark, ws = seeds.sparkSession, Workspace(seeds.sparkSession, "crawl")
    seed = seeds.withColumn("seed_url", U.normalize_url(F.col("url"))).withColumn("prefix", F.col("path_prefix") if "path_prefix" in seeds.columns else F.lit(None).cast("string"))
    rules = seed.select("seed_url", "prefix", U.parts(F.col("seed_url"))["authority"].alias("seed_host")).distinct()  # a seed given twice is crawled once
    source = pages if callable(pages) else snapshot(pages, ws)
    frontier = seed.select("seed_url", F.col("seed_url").alias("url"), F.lit(None).cast("string").alias("parent_url"), F.lit(0).cast("long").alias("seq"))
    visited, saved, pages_of = spark.createDataFrame([], "seed_url string, url string"), spark.createDataFrame([], KEPT), []

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return keep_new(batches, max_pages)

    for depth in range(max_depth + 1):
        first = frontier.groupBy("seed_url", "url").agg(F.min(F.struct("seq", "parent_url")).alias("x")).select("seed_url", "url", "x.parent_url", "x.seq")
        full = saved.groupBy("seed_url").agg(F.count("url").alias("n")).where(F.col("n") >= max_pages)
        asked = ws.cut(first.join(visited, ["seed_url", "url"], "left_anti").join(full, "seed_url", "left_anti"), f"asked-{depth}")
        if asked.isEmpty():
            break
        visited = visited.union(asked.select("seed_url", "url"))
        fit = asked.join(rules, "seed_url").where(U.is_crawlable(F.col("url"), F.col("seed_host"), F.col("prefix")))
        if robots is not None:
            fit = fit.where(robots(F.col("url")))
        fit = ws.cut(fit.select("seed_url", "url", "parent_url", "seq"), f"fit-{depth}")
        # a page is had, parsed and written once, whichever seeds ask for it
        had = source(fit.select("url").distinct()).where("html IS NOT NULL").select("url", "html")
        facts = ws.cut(had.withColumn("f", page_facts(F.col("html"))).select("url", "html", "f.canonical", F.sha2(F.encode("f.article", "UTF-8"), 256).alias("article_hash"), "f.links"), f"pages-{depth}")
        new = fit.join(facts.drop("html", "links"), "url").select("seed_url", "url", F.lit(depth).alias("depth"), "parent_url", "seq", "canonical", "article_hash")
        both = new.withColumn("old", F.lit(False)).union(saved.withColumn("old", F.lit(True)))
        in_order = both.repartition("seed_url").sortWithinPartitions("seed_url", F.desc("old"), "seq")
        own = ws.cut(in_order.mapInArrow(fold, KEPT), f"kept-{depth}")
        saved = saved.union(own)
        pages_of.append(own.join(facts.select("url", "html"), "url").select(*KEPT_NAMES, "html"))
        kept = own.join(facts.select("url", "links"), "url")
        links = kept.select("seed_url", F.col("url").alias("parent_url"), "seq", F.posexplode("links").alias("pos", "href"))
        to = links.select("seed_url", "parent_url", "seq", "pos", U.normalize_url(U.resolve(F.col("href"), F.col("parent_url"))).alias("url"))
        order = Window.partitionBy("seed_url").orderBy("seq", "pos")
        frontier = to.select("seed_url", "url", "parent_url", F.row_number().over(order).cast("long").alias("seq"))
    more = [c for c in seeds.columns if c not in ("url", "path_prefix")]
    found = reduce(DataFrame.union, pages_of) if pages_of else saved.withColumn("html", F.lit(None).cast("string"))
    return found.join(seed.select("seed_url", *more), "seed_url", "left")


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, pos, link): each page's distinct links, resolved and normalised, in document order."""
    each = pages.select(F.col(url).alias("url"), F.posexplode(page_facts(F.col(html))["links"]).alias("pos", "href"))
    full = each.select("url", "pos", U.normalize_url(U.resolve(F.col("href"), F.col("url"))).alias("link"))
    return full.groupBy("url", "link").agg(F.min("pos").alias("pos")).select("url", "pos", "link")
