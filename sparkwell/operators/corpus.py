"""Corpus building: blocks of articles, first-wins dedup, dense ids, cleaned and embedding corpora."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..functions.urls import topic_of
from ..lineage import Workspace


def structured_blocks(pages: DataFrame, path: str = "path", html: str = "html", title_tag: str = "h2", section_tag: str = "h3", anchor: str = "students") -> DataFrame:
    """(path, pos, topic, title, section, text): the blocks of each page's article. A page is parsed once."""
    parsed = pages.select(F.col(path).alias("path"), H.parse_page(F.col(html), title_tag, section_tag).alias("p"))
    return parsed.select("path", "p.canonical", F.explode("p.blocks").alias("b")).select("path", "b.pos", topic_of(F.col("canonical"), anchor).alias("topic"), "b.title", "b.section", "b.text")


def failed_pages(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """(path, error): the pages that can't be parsed and so have no blocks."""
    return pages.select(F.col(path).alias("path"), H.parse_page(F.col(html))["error"].alias("error")).where("error IS NOT NULL")


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row, by ``order``, of each distinct ``keys``; nulls equal each other.

    The minimum of (order, row) is combined on the map side, so a key that a third of all
    rows share costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    order_ = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    row = F.struct(*(F.col(c) for c in rest))
    return df.groupBy(*keys).agg(F.min_by(row, order_).alias("__row")).select(*(F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns))


def number_rows(df: DataFrame, order: list[str], into: str = "doc_id") -> DataFrame:
    """Dense ids from 0 in the given order, without gathering rows in one place.

    Rows are range-partitioned and sorted once; each partition's count is known before
    places are given out, so only one number a partition reaches the driver.
    """
    ws = Workspace(df.sparkSession, "number-rows")
    df = ws.cut(df, "rows")  # the range exchange reads its input twice, once to sample it
    names, types = df.columns, df.schema
    by = [F.col(o).asc_nulls_first() for o in order]
    part = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())

    def place(batches):
        at = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows), pa.int64())], [*b.schema.names, "__at"])
            at += b.num_rows

    from pyspark.sql import types as T

    placed = ws.cut(part.mapInArrow(place, T.StructType([*types.fields, T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType())])), "placed")
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("__at").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    return placed.join(F.broadcast(offsets), "__part").select((F.col("__start") + F.col("__at")).alias(into), *names)  # a row for each partition


def structured_corpus(pages: DataFrame, **options) -> DataFrame:
    """(doc_id, topic, title, section, text): blocks of all pages, the first of each text, numbered in page order."""
    blocks = structured_blocks(pages, **options)
    return number_rows(keep_first(blocks, ["text"], ["path", "pos"]), ["path", "pos"]).select("doc_id", "topic", "title", "section", "text")


def cleaned_corpus(df: DataFrame, lexicon: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """The input columns (null as empty), ``raw_document`` and ``cleaned_document``.

    All columns but ``topic`` and the id feed the cleaned text.
    """
    for needed in ("topic",):
        if needed not in df.columns:
            raise ValueError(f"the corpus has no column {needed}")
    text_columns = [c for c, t in df.dtypes if t == "string"]
    filled = df.na.fill("", text_columns)
    used = [c for c in text_columns if c != "topic"]
    shown = [F.col(c) for c in ("title", "section", "text") if c in df.columns]
    return filled.withColumns({"raw_document": X.raw_document(shown), "cleaned_document": X.clean_row([F.col(c) for c in used], lexicon)})


def embedding_corpus(df: DataFrame, order: list[str]) -> DataFrame:
    """(row_id, topic, title, section, text, natural_text) of the rows with any text, numbered in order."""
    filled = df.na.fill("", ["title", "section", "text"])
    natural = filled.withColumn("natural_text", X.natural_text([F.col(c) for c in ("title", "section", "text")])).where("natural_text <> ''")
    return number_rows(natural, order, "row_id").select("row_id", "topic", "title", "section", "text", "natural_text")


def token_length_report(df: DataFrame, length: Column, limit: int = 512, row_id: str = "row_id", examples: int = 10) -> DataFrame:
    """One row: the greatest length, how many rows exceed ``limit``, and the first of them."""
    own = df.select(F.col(row_id).alias("id"), length.cast("long").alias("n"))
    stats = own.agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_tokens"), F.count_if(F.col("n") > limit).alias("n_over"))
    first = own.where(F.col("n") > limit).orderBy("id").limit(examples).agg(F.array_sort(F.collect_list("id")).alias("first_over"))
    both = stats.withColumn("first_over", F.lit(None).cast(first.schema["first_over"].dataType)).unionByName(first, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in ("max_tokens", "n_over", "first_over")))  # one row each


def whitespace_length(text: Column) -> Column:
    """Tokens of a whitespace tokenizer."""
    return F.when(X.collapse_space(text) == "", F.lit(0)).otherwise(F.size(F.split(X.collapse_space(text), " "))).cast("long")


def first_rank(partition: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
