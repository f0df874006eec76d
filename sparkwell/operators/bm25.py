"""Field-weighted BM25 for a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_query
from ..lineage import Workspace
from .index import Index

#: How much each field's score counts.
WEIGHTS = {"topic": 3.0, "title": 2.0, "text": 3.0}
BROADCAST_TERMS = 200_000


def query_terms(queries: DataFrame, tokenize: Callable[[Column], Column] | None = None, query: str = "query") -> DataFrame:
    """(query_id, term): each query's distinct terms; a blank query has none."""
    tokens = tokenize(F.col(query)) if tokenize else F.split(clean_query(F.col(query)), " ")
    return queries.select("query_id", F.explode(F.array_distinct(tokens)).alias("term")).where("term <> ''")


def term_scores(index: Index, terms: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """(query_id, doc_id, field, s): what each query term adds to a field's score (of ``fields``, if given).

    Only postings of query terms are touched: the terms are sent to the postings' tasks if
    they are few (counted), else both sides are hashed by term.
    """
    terms = Workspace(terms.sparkSession, "bm25").cut(terms, "terms")
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    side = F.broadcast(terms) if few else terms
    wanted = index.term_stats.join(F.broadcast(terms.select("term").distinct()) if few else terms.select("term").distinct(), "term", "left_semi")
    stats = wanted.join(F.broadcast(index.field_stats), "field").select("field", "term", "idf", "avgdl")
    stats = F.broadcast(stats) if few else stats
    k1, b = index.k1, index.b
    tf, norm = F.col("tf").cast("double"), F.when(F.col("avgdl") > 0, 1 - b + b * F.col("dl") / F.nullif("avgdl", F.lit(0.0))).otherwise(F.lit(1.0))
    postings = index.postings if fields is None else index.postings.where(F.col("field").isin(*fields))
    each = postings.join(stats, ["field", "term"]).select("field", "term", "doc_id", (F.col("idf") * tf * (k1 + 1) / (tf + k1 * norm)).alias("s"))
    return each.join(side, "term").select("query_id", "doc_id", "field", "s")


def score_fields(index: Index, terms: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """(query_id, doc_id, field, score): unweighted BM25 of each field in which a query term occurs."""
    return term_scores(index, terms, fields).groupBy("query_id", "doc_id", "field").agg(F.sum("s").alias("score"))


def search(
    index: Index, queries: DataFrame, top_k: int = 10, weights: Mapping[str, float] = WEIGHTS, tokenize: Callable[[Column], Column] | None = None, digits: int = 6, terms: DataFrame | None = None
) -> DataFrame:
    """(query_id, rank, doc_id, score, bm25_<field>...): each query's best documents.

    Scores are rounded before they are ranked, so that the order doesn't hang on the order
    in which floats were added; ties go to smaller ids.
    """
    each = term_scores(index, terms if terms is not None else query_terms(queries, tokenize), weights)
    by_field = {f: F.sum(F.when(F.col("field") == f, F.col("s"))) for f in weights}  # all fields in one exchange
    both = each.groupBy("query_id", "doc_id").agg(*(F.coalesce(c, F.lit(0.0)).alias(f"bm25_{f}") for f, c in by_field.items()))
    total = sum((F.lit(w) * F.col(f"bm25_{f}") for f, w in weights.items()), F.lit(0.0))
    scored = both.withColumn("score", F.round(total, digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", "doc_id", "score", *(F.round(f"bm25_{f}", digits).alias(f"bm25_{f}") for f in weights))


def with_store(hits: DataFrame, index: Index, columns: tuple[str, ...] = ("topic", "title", "section", "text")) -> DataFrame:
    """What is shown of each hit, looked up after the cut; documents that the store lacks have nulls."""
    return look_up(hits, index.doc_store.select("doc_id", *(c for c in columns if c in index.doc_store.columns)))


def look_up(hits: DataFrame, store: DataFrame) -> DataFrame:
    """``hits`` with the store's columns, or nulls. Where hits are few (counted), their ids go to the store, so that only rows that are shown move."""
    hits = Workspace(hits.sparkSession, "hits").cut(hits, "hits")
    few = hits.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    ids = hits.select("doc_id").distinct()
    return hits.join(store.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "doc_id", "left")
