"""A training corpus from ``documents``: five stages, each reading all that the one before it kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All stages
but the last return the columns of ``documents``.

Nulls and odd inputs: rows with a null id pass the filters that work by id; a null text is
empty once lines have been filtered; of several rows with one id, all stay or all go. Empty
tables give empty results. Columns beyond those of ``documents``, whatever their names, pass all
stages as they are and are dropped by the last alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm import byte_bpe, toxicity
from sparkwell.llm.common import Workspace, col
from sparkwell.llm.decontaminate import decontaminate
from sparkwell.llm.line_dedup import dedup_lines
from sparkwell.llm.near_dedup import dedup_near


def _by_place(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` under names that clash with nothing, and those of the text and the id."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")], names[docs.columns.index("doc_id")]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic; it learns from ``labels`` outside the held-out fifth."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five or more documents share; ``n_chars`` follows the text."""
    plain, text, doc_id = _by_place(docs)
    out = dedup_lines(plain, text, doc_id).select(*plain.columns).toDF(*docs.columns)
    return out.select(*(F.length(col(out, "text")).cast("long").alias(c) if c == "n_chars" else col(out, c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    plain, text, doc_id = _by_place(docs)
    return dedup_near(plain, text, doc_id).select(*plain.columns).toDF(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    plain, text, doc_id = _by_place(docs)
    return decontaminate(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text, doc_id).select(*plain.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and digests of them and of the bytes decoded from them."""
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.encode(docs, vocabulary, pattern, decoded="decoded")
    return out.select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.encode(byte_bpe.ids_text("ids"), "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("byte BPE", encode),
]

#: SQL expresses neither the classifier nor the latent search; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_name, stage) in enumerate(STAGES):
        docs = ws.cut(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
