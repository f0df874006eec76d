"""Batch search: a table of queries against stored indexes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_query
from ..lineage import Workspace
from ..operators import bm25, dense, fusion, generate
from ..operators.index import Index


@dataclass(frozen=True)
class HybridSearch:
    """BM25 and dense candidates, fused. ``embeddings`` has (doc_id, embedding).

    ``lexicon``: the one that the index was built with, so that queries and documents are
    cleaned alike. ``dense_store``: (doc_id and what is shown) of the dense side's rows, for
    hits that the index's store lacks; without it the store serves both.
    """

    index: Index
    embeddings: DataFrame
    encoder: dense.Encoder | None = None
    config: fusion.FusionConfig = field(default_factory=fusion.FusionConfig)
    lexicon: Mapping[str, Mapping[str, str]] | None = None
    dense_store: DataFrame | None = None

    def keywords(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """BM25 alone, of queries cleaned as the documents were."""
        return bm25.search(self.index, queries, top_k, tokenize=lambda c: F.split(clean_query(c, self.lexicon), " "))

    def sides(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The two candidate lists of (query_id, query); a blank query has none on either side."""
        asked = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")
        left = self.keywords(asked, self.config.candidates)
        vectors = dense.encode(asked.select("query_id", "query"), "query", encoder=self.encoder, instruction=dense.INSTRUCTION)
        return left, dense.search(self.embeddings, vectors, self.config.candidates)

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """Each query's hits with both ranks and scores, and what is shown of them."""
        fused = fusion.hybrid(*self.sides(queries), top_k, self.config)
        fused = Workspace(fused.sparkSession, "hybrid").cut(fused, "fused") if self.dense_store is not None else fused  # both sides read it
        shown = ("topic", "title", "section", "text", "raw_document")
        if self.dense_store is None:
            return bm25.with_store(fused, self.index, shown)
        left = bm25.with_store(fused.where("bm25_rank IS NOT NULL").select("query_id", "doc_id"), self.index, shown)
        own = [c for c in shown if c in self.dense_store.columns]
        right = bm25.look_up(fused.where("dense_rank IS NOT NULL").select("query_id", "doc_id"), self.dense_store.select("doc_id", *own))
        return fusion.with_metadata(fused, left, right)

    def answer(self, queries: DataFrame, top_k: int = 5, generator: generate.Generator | None = None) -> DataFrame:
        """(query_id, answer)."""
        return generate.summarize(queries, self.search(queries, top_k), generator)
