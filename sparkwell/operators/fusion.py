"""Reciprocal rank fusion of any number of rankings, and the hybrid of two."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FusionConfig:
    """``k`` damps the first ranks; each side offers ``candidates`` documents a query."""

    k: int = 60
    candidates: int = 50


def hybrid(bm25: DataFrame, dense: DataFrame, top_k: int = 10, config: FusionConfig = FusionConfig(), digits: int = 6) -> DataFrame:
    """(query_id, rank, doc_id, score, bm25_rank, bm25_score, dense_rank, dense_score).

    Each side has (query_id, rank, doc_id, score). A side that lacks a document gives a null
    rank and a score of 0. Equal scores: BM25 rank first, then dense rank, missing ones last.
    """
    sides = [
        df.where(F.col("rank") <= config.candidates).select("query_id", "doc_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))
        for name, df in (("bm25", bm25), ("dense", dense))
    ]
    both = sides[0].join(sides[1], ["query_id", "doc_id"], "full_outer")
    share = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(config.k) + F.col(rank)), F.lit(0.0))
    scored = both.withColumn("raw", share("bm25_rank") + share("dense_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("raw"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("dense_rank"), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return ranked.select("query_id", "rank", "doc_id", F.round("raw", digits).alias("score"), "bm25_rank", zero("bm25_score"), "dense_rank", zero("dense_score"))


def fuse(rankings: Sequence[DataFrame], top_k: int = 10, config: FusionConfig = FusionConfig(), digits: int = 6) -> DataFrame:
    """(query_id, rank, doc_id, score) of many rankings; ties to the best rank of the earliest ranking, then to smaller ids."""
    stacked = reduce(DataFrame.unionAll, (df.where(F.col("rank") <= config.candidates).select("query_id", "doc_id", "rank", F.lit(i).alias("list")) for i, df in enumerate(rankings)))
    raw = stacked.groupBy("query_id", "doc_id").agg(F.sum(F.lit(1.0) / (F.lit(config.k) + F.col("rank"))).alias("raw"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 12)), "first", "doc_id")
    return raw.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "doc_id", F.round("raw", digits).alias("score"))


def with_metadata(fused: DataFrame, bm25: DataFrame, dense: DataFrame, columns: Sequence[str] = ("topic", "title", "section", "text"), bm25_only: Sequence[str] = ("raw_document",)) -> DataFrame:
    """What is shown of each hit, from the BM25 side or, where that lacks the document, from the dense one."""
    left = bm25.select("query_id", "doc_id", *(F.col(c).alias(f"b_{c}") for c in (*columns, *bm25_only) if c in bm25.columns), F.lit(True).alias("b_here"))
    right = dense.select("query_id", "doc_id", *(F.col(c).alias(f"d_{c}") for c in columns if c in dense.columns))
    both = fused.join(left, ["query_id", "doc_id"], "left").join(right, ["query_id", "doc_id"], "left")
    pick = lambda c: F.coalesce(*(F.col(f"{side}_{c}") for side in "bd" if f"{side}_{c}" in both.columns), F.lit(None).cast("string")).alias(c)
    return both.select(*fused.columns, *(pick(c) for c in (*columns, *bm25_only)))
