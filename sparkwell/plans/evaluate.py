"""Quality of retrieval and of summaries over gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.generate import Generator
from .search import HybridSearch


def evaluate_retrieval(engine: HybridSearch, gold: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(comparison of means, BM25 by query, hybrid by query); ``gold`` has (query_id, query, relevant)."""
    relevant = gold.select("query_id", F.explode("relevant").alias("doc_id"))
    queries = gold.select("query_id", "query")
    depth = max(k, 10)
    base = metrics.evaluate(queries, relevant, engine.keywords(queries, depth), k)
    both = metrics.evaluate(queries, relevant, engine.search(queries, depth), k)
    return metrics.compare(base, both), base, both


def evaluate_summaries(engine: HybridSearch, gold: DataFrame, generator: Generator | None = None, top_k: int = 5) -> DataFrame:
    """One row: mean ROUGE F scores; ``gold`` has (query_id, query, reference)."""
    answers = engine.answer(gold.select("query_id", "query"), top_k, generator)
    pairs = gold.join(answers, "query_id").select(F.col("query_id").alias("pair_id"), F.col("answer").alias("prediction"), "reference")
    return metrics.rouge(pairs).agg(*(F.avg(c).alias(c) for c in ("rouge1", "rouge2", "rougeL")))
