"""Dense retrieval: encoders, normalised vectors and exact inner-product search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import small_batches

#: What the query side is prefixed with before it is encoded.
INSTRUCTION = "Represent this sentence for searching relevant passages: "

#: Loaded once a task: texts -> one vector each.
Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


def hashing_encoder(dims: int = 384) -> Encoder:
    """A deterministic stand-in for a model: hashed words, signed and added. Its scores are no model's."""

    def load():
        @lru_cache(50_000)
        def place(w: str) -> tuple[int, int]:
            h = hashlib.md5(w.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
            return int(h[:7], 16) % dims, 1 if h[7] > "7" else -1

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims), np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    at, sign = place(w)
                    out[i, at] += sign
            return out

        return encode

    return load


def encode(df: DataFrame, text: str, into: str = "embedding", encoder: Encoder | None = None, batch: int = 32, instruction: str = "") -> DataFrame:
    """``df`` with a unit vector for each text, encoded in batches; the encoder loads once a task."""
    from pyspark.sql import types as T

    load = encoder or hashing_encoder()
    names = df.columns
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for whole in batches:
            for start in range(0, max(whole.num_rows, 1), 8 * batch):
                b = whole.slice(start, 8 * batch)
                texts = [instruction + (t or "") for t in b.column(names.index(text)).to_pylist()]
                parts = [model(texts[s : s + batch]) for s in range(0, len(texts), batch)]
                v = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                at = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(v.astype(np.float32).ravel()))], [*names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))]))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, and without null or non-finite components."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _pack(block: int):
    """Rows (id, vector) to rows (at, ids, dims, m) of ``block`` vectors each, zero-filled where lengths differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, block):
                part = b.slice(s, block)
                sizes = np.asarray(part.column(1).value_lengths())
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                dims = int(sizes.max(initial=0))
                m = np.zeros((len(sizes), dims))
                m[np.arange(dims) < sizes[:, None]] = flat
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[:1]), pa.array([ids.tobytes()], pa.binary()), pa.array([dims], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["at", "ids", "dims", "m"])

    return run


def search(data: DataFrame, queries: DataFrame, top_k: int = 10, id_col: str = "doc_id", vector: str = "embedding", query_vector: str = "embedding", digits: int = 6, block: int = 512, chunk: int = 1024, salts: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): exact inner-product search, ties to smaller ids.

    Queries and data are packed in blocks. A block of data has one of ``salts`` numbers, a block
    of queries has all of them, and blocks of one number meet in a join: the query blocks are sent
    to the data where they are small, else both sides move once. A task keeps the best ``top_k`` of
    each query, so what is ranked is queries times tasks times k. It is one join, however many
    query blocks there are. Vectors that are null or hold a null or non-finite component take no
    part; missing components count as 0 where lengths differ.
    """
    rows = data.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col(query_vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    n = salts or max(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = "at long, ids binary, dims int, m binary"
    blocks = rows.mapInArrow(_pack(chunk), schema).select(F.pmod(F.xxhash64("at"), F.lit(n)).cast("int").alias("salt"), "ids", "dims", "m")
    packed = asked.mapInArrow(_pack(block), schema).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"), F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("m").alias("q"))

    def solve(batches):
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for q_ids, (scores, ids) in best.items():
                k = scores.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(q_ids, np.int64), k)), pa.array(ids.ravel()), pa.array(scores.ravel())], ["query_id", "doc_id", "score"])
            best.clear()

        for b in batches:
            for r in range(b.num_rows):
                ids, dims, m, q_ids, q_dims, q = (b.column(c)[r].as_py() for c in range(6))
                own = np.frombuffer(ids, np.int64)
                x, y, d = np.frombuffer(m).reshape(len(own), dims), np.frombuffer(q).reshape(len(q_ids) // 8, q_dims), min(dims, q_dims)
                scores = np.round(y[:, :d] @ x[:, :d].T, digits) + 0.0
                names = np.broadcast_to(own, scores.shape)
                if q_ids in best:
                    scores, names = np.concatenate([best[q_ids][0], scores], 1), np.concatenate([best[q_ids][1], names], 1)
                order = np.lexsort((names, -scores), axis=1)[:, :top_k]
                best[q_ids] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
                if len(best) > 64:
                    yield from flush()
        yield from flush()

    near = blocks.join(packed, "salt").select("ids", "dims", "m", "q_ids", "q_dims", "q").mapInArrow(solve, "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return near.select("query_id", F.row_number().over(order).alias("rank"), "doc_id", "score").where(F.col("rank") <= top_k)
