"""Sinks: pages, CSV copies and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import parts, slugify


def write_pages(pages: DataFrame, path: str, url: str = "url", mode: str = "overwrite") -> None:
    """Pages with their file name and host, a folder a host; all other columns (crawl facts) are kept."""
    named = pages.withColumns({"slug": slugify(F.col(url)), "host": parts(F.col(url))["authority"]})
    named.repartition("host", F.pmod(F.xxhash64("slug"), F.lit(16))).write.mode(mode).partitionBy("host").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A CSV that ``read_csv`` and others read back as it was, white space at the ends of fields too."""
    df.write.mode(mode).csv(path, header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
