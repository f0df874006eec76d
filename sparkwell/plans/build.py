"""From pages to indexes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..functions.text import clean_tokens
from ..operators import corpus, dense
from ..operators.index import build_index, save_index
from ..sources.sinks import write_table


def build(pages: DataFrame, path: str, encoder: dense.Encoder | None = None, lexicon: Mapping[str, Mapping[str, str]] | None = None, **options) -> None:
    """Write below ``path``: the structured, cleaned and embedding corpora, the BM25 index and the embeddings.

    ``pages`` has ``path`` and ``html``. Each table is read again from what was written, so nothing is parsed twice.
    """
    spark = pages.sparkSession
    write_table(corpus.structured_corpus(pages, **options), f"{path}/structured")
    structured = spark.read.parquet(f"{path}/structured")
    write_table(corpus.cleaned_corpus(structured, lexicon), f"{path}/cleaned")
    save_index(build_index(structured, tokenize=lambda c: clean_tokens(c, lexicon)), f"{path}/bm25")
    write_table(corpus.embedding_corpus(structured, ["doc_id"]), f"{path}/embedding_corpus")
    natural = spark.read.parquet(f"{path}/embedding_corpus")
    vectors = dense.encode(natural.select("row_id", "natural_text"), "natural_text", encoder=encoder)
    write_table(vectors.selectExpr("row_id AS doc_id", "embedding"), f"{path}/embeddings")
