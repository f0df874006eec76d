"""Command line: build indexes, search, evaluate."""

from __future__ import annotations

import argparse
import logging


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkwell", description=__doc__)
    p.add_argument("--log-level", default="WARNING")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="parse a folder of pages and write corpora and indexes")
    b.add_argument("pages")
    b.add_argument("out")
    b.add_argument("--title-tag", default="h2")
    c = sub.add_parser("crawl", help="fetch the pages below the seeds of a CSV (url, path_prefix)")
    c.add_argument("seeds")
    c.add_argument("out")
    c.add_argument("--max-depth", type=int, default=8)
    c.add_argument("--max-pages", type=int, default=80)
    c.add_argument("--delay", type=float, default=1.5)
    s = sub.add_parser("search", help="search with the queries given")
    s.add_argument("store")
    s.add_argument("query", nargs="+")
    s.add_argument("--top-k", type=int, default=5)
    s.add_argument("--generator-url")
    s.add_argument("--model", default="")
    e = sub.add_parser("evaluate", help="measure retrieval and summaries against gold sets")
    e.add_argument("store")
    e.add_argument("--queries", help="gold queries (JSON)")
    e.add_argument("--summaries", help="gold summaries (JSON)")
    e.add_argument("--ir", action=argparse.BooleanOptionalAction, default=True)
    e.add_argument("--summarizer", action=argparse.BooleanOptionalAction, default=True)
    e.add_argument("-k", type=int, default=5)
    return p


def main(argv: list[str] | None = None) -> None:
    p = parser()
    args = p.parse_args(argv)
    if args.command == "evaluate" and not (args.ir or args.summarizer):
        p.error("nothing to evaluate: both --no-ir and --no-summarizer were given")
    logging.basicConfig(level=args.log_level.upper())

    # Spark starts only once the arguments are good
    from pyspark.sql import SparkSession

    from .operators.index import load_index
    from .plans.search import HybridSearch
    from .sources import readers

    spark = SparkSession.builder.appName("sparkwell").getOrCreate()
    if args.command == "crawl":
        from .operators.crawl import crawl
        from .sources.sinks import write_pages

        seeds = readers.read_csv(spark, args.seeds)
        robots = readers.robots_by_host([r["url"] for r in seeds.select("url").collect()])  # seeds are a list made by hand
        write_pages(crawl(seeds, readers.live(delay=args.delay), args.max_depth, args.max_pages, robots), args.out)
        return
    if args.command == "build":
        from .plans.build import build

        build(readers.read_html(spark, args.pages), args.out, title_tag=args.title_tag)
        return
    engine = HybridSearch(load_index(spark, f"{args.store}/bm25"), spark.read.parquet(f"{args.store}/embeddings"))
    if args.command == "search":
        from .operators.generate import http_generator

        queries = spark.createDataFrame(list(enumerate(args.query)), "query_id long, query string")
        engine.search(queries, args.top_k).orderBy("query_id", "rank").show(truncate=80)
        generator = http_generator(args.generator_url, args.model) if args.generator_url else None
        engine.answer(queries, args.top_k, generator).orderBy("query_id").show(truncate=False)
        return
    from .plans.evaluate import evaluate_retrieval, evaluate_summaries

    if args.ir and args.queries:
        comparison, base, both = evaluate_retrieval(engine, readers.read_gold_queries(spark, args.queries), args.k)
        comparison.show()
        base.show(100)
        both.show(100)
    if args.summarizer and args.summaries:
        evaluate_summaries(engine, readers.read_gold_summaries(spark, args.summaries)).show()


if __name__ == "__main__":
    main()
