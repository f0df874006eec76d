"""Inverted index of several fields, as plain tables.

``postings`` (field, term, doc_id, tf, dl) carries each document's length, so that scoring
needs no join for it; ``term_stats`` (field, term, df, idf); ``field_stats`` (field, n,
avgdl); ``doc_store`` has what is shown of a hit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_tokens
from ..lineage import Workspace, small_batches

FIELDS = ("topic", "title", "text")
K1, B = 1.5, 0.3
#: Tokens that are counted at once.
CHUNK = 200_000


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    doc_store: DataFrame
    k1: float = K1
    b: float = B


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def tokenized(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tokenize: Callable[[Column], Column] = clean_tokens, doc_id: str = "doc_id") -> DataFrame:
    """(field, doc_id, tokens): every document once a field, those without a token too."""
    stacked = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), stacked.alias("x"))
    return rows.select("x.field", "doc_id", tokenize(F.col("x.value")).alias("tokens"))


def count_terms(rows: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, tf): each row's distinct terms with how often they occur in it; rows are arrays of tokens."""
    sizes = np.asarray(rows.value_lengths().fill_null(0)).astype(np.int64)
    words = rows.flatten().dictionary_encode()
    n = max(len(words.dictionary), 1)
    keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + words.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    return keys // n, words.dictionary.take(pa.array(keys % n)), counts


def term_rows(tokens: DataFrame) -> DataFrame:
    """(field, term, doc_id, tf, dl) of (field, doc_id, tokens): a row's tokens are in one place, so nothing moves.

    Rows are counted ``CHUNK`` tokens at a time, so a task holds one batch and little more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column(2).value_lengths().fill_null(0)).astype(np.int64)
            ends, start = np.cumsum(sizes), 0
            while start < b.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + CHUNK, "right")))
                row, term, tf = count_terms(b.column(2).slice(start, end - start))
                at = pa.array(row + start)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), term, b.column(1).take(at), pa.array(tf, pa.int64()), pa.array(sizes[row + start], pa.int64())], ["field", "term", "doc_id", "tf", "dl"])
                start = end

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("field", "doc_id", "tokens").mapInArrow(run, f"field string, term string, doc_id {kind}, tf bigint, dl bigint")


def spread(df: DataFrame) -> DataFrame:
    """One small file is one task: rows go to all cores where there are fewer partitions than half of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def build_index(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tokenize: Callable[[Column], Column] = clean_tokens, doc_id: str = "doc_id", k1: float = K1, b: float = B) -> Index:
    """Tokenise once, count the rest.

    Terms are counted within each row, so the postings are written without an exchange, and the
    statistics are taken of them. Ids are unique: a document occurs once a term, so a term's document frequency is a row count, and lengths add up to
    the field's total; documents without a token count in ``n`` alone.
    """
    ws = Workspace(docs.sparkSession, "index")
    small_batches(docs.sparkSession)
    tokens = tokenized(spread(docs), fields, tokenize, doc_id)
    postings = ws.cut(term_rows(tokens), "postings")
    n_docs = docs.count()
    totals = postings.groupBy("field").agg(F.sum("tf").alias("total"))
    names = docs.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    # one row a field
    stats = ws.cut(names.withColumn("n", F.lit(n_docs).cast("long")).join(F.broadcast(totals), "field", "left").select("field", "n", F.coalesce(F.try_divide(F.coalesce("total", F.lit(0)).cast("double"), F.col("n")), F.lit(0.0)).alias("avgdl")), "field-stats")
    counts = postings.groupBy("field", "term").agg(F.count("doc_id").alias("df"))
    terms = counts.join(F.broadcast(stats), "field").select("field", "term", "df", idf(F.col("df").cast("double"), F.col("n").cast("double")).alias("idf"))
    return Index(postings, terms, stats, docs, k1, b)


def save_index(index: Index, path: str) -> None:
    """Parquet tables below ``path``; postings and terms by field, so that a query of one field reads one."""
    for name in ("postings", "term_stats"):
        getattr(index, name).write.mode("overwrite").partitionBy("field").parquet(f"{path}/{name}")
    index.field_stats.withColumns({"k1": F.lit(index.k1), "b": F.lit(index.b)}).write.mode("overwrite").parquet(f"{path}/field_stats")
    index.doc_store.write.mode("overwrite").parquet(f"{path}/doc_store")


def load_index(spark: SparkSession, path: str) -> Index:
    stats = spark.read.parquet(f"{path}/field_stats")
    known = stats.select("k1", "b").first()
    k1, b = (known["k1"], known["b"]) if known else (K1, B)
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/term_stats"), stats.drop("k1", "b"), spark.read.parquet(f"{path}/doc_store"), k1, b)
