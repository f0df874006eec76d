"""The registered queries of the ten operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, token_file, toxicity
from .common import Workspace
from .decontaminate import find_items
from .html_text import extract_text
from .line_dedup import dedup_lines
from .near_dedup import near_duplicate_rows
from .sharding import shard_by_bytes, text_size
from .topk import quantize, top_k
from .url_filter import filter_urls

#: The listed URLs of op1: (host, path, verdict).
URL_LIST = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    listed = spark.createDataFrame(URL_LIST, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without the lines that five or more documents share."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class among those whose shingle sets overlap by 75 %."""
    out = near_duplicate_rows(table(spark, sf_dir, "documents"), words=2, percent=75)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op4_token_file(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """What the token files of all documents hold, read back from them."""
    import public_tokenizers

    path = Workspace(spark, "op4").path("ids")
    token_file.write_ids(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_file.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for each vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantize(F.col("embedding")).alias("vector"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of eight, by bytes, and its place there."""
    out = shard_by_bytes(table(spark, sf_dir, "documents"), shards=8, tolerance=0.02)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return out.select("doc_id", text_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item: (doc_id, item_id, lcs, cosine, answer, at)."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "html", "text")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    import public_tokenizers

    vocabulary, pattern = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    out = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, pattern, decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(byte_bpe.ids_text("ids"), "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_token_file": op4_token_file,
    "op5_topk": op5_topk,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_html_text": op9_html_text,
    "op10_byte_bpe": op10_byte_bpe,
}
