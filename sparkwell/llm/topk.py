"""Exact top-k search by inner product: a Voronoi kNN join.

Queries and data are grouped by their nearest pivot. Summaries of the groups (for queries:
the greatest distance to the pivot and the greatest norm; for data: the count and the
smallest distances to the pivot) give, for each query group, a score that every query of the
group is sure to reach ``k`` times, and, for each pair of groups, the distance to the pivot
that a data vector must have to reach it:

    p·c - U |c| - N d  <=  q·x  <=  p·c + U |c| + N d

with query pivot p, data pivot c, greatest query distance U, greatest query norm N, and d the
distance of x to c. Only data vectors that may reach the bound of a group are copied to the set
of query groups that it is in, packed in blocks; blocks meet the set's queries in a join salted
by block, each task compares a group with those of a block that may reach its own bound and
keeps the best ``k`` of each query, and a ranked window merges the tasks' lists.

Vectors are integers; scores are exact. Bounds are widened by a relative 1e-9 for rounding.

Nulls and odd inputs: rows with a null id, a null vector, or a null or non-finite component
take no part. Missing components count as 0 where vectors differ in length. Repeated rows are
each a candidate; repeated query ids are one query (of its smallest vector, in byte order). Other columns
aren't looked at. No data or no queries give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, col

BLOCK = 2048
SET = 1 << 15


def quantize(embedding: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of each component, or null where a vector takes no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(F.lit(factor) * x.cast("double"))))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of 64-bit integers, zero-filled to ``dims``."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    for i, (n, e) in enumerate(zip(sizes, np.cumsum(sizes), strict=True)):
        out[i, :n] = flat[e - n : e]
    return out


def _assign(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = vectors.astype(np.float64)
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)[None, :], 0)
    cell = d.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the ``k`` highest scores and their ids, ties to smaller ids; ``ids`` may be one row for all."""
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > 4 * k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        width = int((scores >= least[:, None]).sum(1).max())
        keep = np.argsort(-(scores >= least[:, None]).astype(np.int8), axis=1, kind="stable")[:, :width]
        scores, ids = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


LOW = -(1 << 62)


def _pivots(rows: DataFrame, n: int, n_rows: int) -> list[list[int]]:
    """At most ``n`` vectors chosen by the hash of their ids. Tasks combine them, so the driver gets ``n`` whatever the number of tasks."""
    at = F.xxhash64("id", F.lit(7))
    for part in sorted({max(1, n_rows // (32 * n)), 1}, reverse=True):  # some 32 rows for each pivot; all rows where few ids repeat
        few = rows.where(F.pmod(at, F.lit(part)) == 0).groupBy(F.pmod(F.shiftright(at, 20), F.lit(n)).alias("b")).agg(F.min(F.struct(at.alias("h"), "v")).alias("m"))
        if found := few.orderBy("b").select("m.v").collect():
            return [r["v"] for r in found]
    return []


def top_k(
    data: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector: str = "vector", queries_per_group: int = 500, max_pivots: int = 1024
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's best ``k`` of ``data`` but itself.

    ``vector`` is an array of 64-bit integers (``quantize``). The number of pivots follows the
    number of queries; a data vector is copied at most once a set of query groups.
    """
    spark, ws = data.sparkSession, Workspace(data.sparkSession, "top-k")
    take = lambda df: df.select(col(df, id_col).cast("long").alias("id"), col(df, vector).cast("array<bigint>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows, asked = take(data), take(queries).groupBy("id").agg(F.min("v").alias("v"))
    dims, top = rows.union(asked).agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    n_queries = asked.count() if dims else 0
    out_schema = "query_id long, rank int, vec_id long, score long"
    if not dims or not n_queries:
        return spark.createDataFrame([], out_schema)
    n_data = rows.count()
    wide = next(w for w, bits in (("<i1", 7), ("<i2", 15), ("<i4", 31), ("<i8", 63)) if (top or 0) < 2**bits)
    exact = next((t for t, bits in ((np.float32, 24), (np.float64, 53)) if dims * (top or 0) ** 2 < 2**bits), np.int64)
    if dims * (top or 0) ** 2 >= 2**62:
        raise ValueError("scores don't fit in 64 bits")
    n_pivots = max(1, min(max_pivots, n_queries // queries_per_group + 2))
    chosen = _pivots(rows, n_pivots, n_data)
    pivots = np.zeros((max(len(chosen), 1), dims), np.float64)
    for i, v in enumerate(chosen):
        pivots[i, : len(v)] = v
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1), dims)
                cell, d = _assign(m, sent.value)
                packed = m.astype(wide)
                norm = np.sqrt((m.astype(np.float64) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(cell, pa.int32()), pa.array(d), pa.array(norm)], ["id", "v", "cell", "d", "norm"])

    schema = "id long, v binary, cell int, d double, norm double"
    placed, placed_q = ws.cut(rows.mapInArrow(assign, schema), "data"), ws.cut(asked.mapInArrow(assign, schema), "queries")

    # summaries: at most k + 1 numbers a data group, two a query group
    nearest = placed.select("cell", "d", F.row_number().over(Window.partitionBy("cell").orderBy("d")).alias("r")).where(F.col("r") <= k + 1)
    small: dict[int, list[float]] = {}
    for r in nearest.select("cell", "d").toLocalIterator():
        small.setdefault(r["cell"], []).append(r["d"])
    found = placed_q.groupBy("cell").agg(F.max("d").alias("u"), F.max("norm").alias("n"), F.count("*").alias("asked")).collect()
    reach, asked_of = {r["cell"]: (r["u"], r["n"]) for r in found}, {r["cell"]: r["asked"] for r in found}
    lengths = np.sqrt((pivots**2).sum(1))
    least_d = np.full((len(pivots), len(pivots)), np.inf)  # [query group, data group]: the distance from which data are copied
    for i, (u, norm) in reach.items():
        middle = pivots[i] @ pivots.T
        sure = np.sort(np.concatenate([[m - u * c - norm * d for d in small.get(j, [])] for j, (m, c) in enumerate(zip(middle, lengths, strict=True))]))[::-1]
        bound = sure[k] if len(sure) > k else -np.inf  # one more, as the query itself may be among them
        slack = 1e-9 * (abs(bound) + 1) if np.isfinite(bound) else 0
        need = bound - slack - middle - u * lengths
        least_d[i] = np.where(need <= 0, -1.0, need / norm if norm else np.inf)
    # consecutive groups of at most SET queries (or one larger group) share their copies of the data; tasks look at each group's own bound again
    set_of, n_sets, held = np.zeros(len(pivots), np.int32), 0, 0
    for i in sorted(reach):
        if held and held + asked_of[i] > SET:
            n_sets, held = n_sets + 1, 0
        set_of[i], held = n_sets, held + asked_of[i]
    least_of_set = np.stack([least_d[set_of == s].min(0) for s in range(n_sets + 1)])
    bounds = spark.sparkContext.broadcast((least_d, least_of_set, set_of))

    def replicate(batches):
        for b in batches:
            cell, d = b.column(2).to_numpy(), b.column(3).to_numpy()
            for s, least in enumerate(bounds.value[1]):
                own = np.flatnonzero(d >= least[cell])
                for at in range(0, len(own), BLOCK):
                    part = b.take(pa.array(own[at : at + BLOCK]))
                    ids, m, cells, ds = part.column(0).to_numpy(), b"".join(part.column(1).to_pylist()), part.column(2).to_numpy(), part.column(3).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([int(ids[0]) & 0x7FFFFFFF], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), m, cells.tobytes(), ds.tobytes()))], ["set", "at", "ids", "m", "cells", "ds"])

    def pack(batches):
        for b in batches:
            sets = bounds.value[2][b.column(2).to_numpy()]
            for s in np.unique(sets):
                own = np.flatnonzero(sets == s)
                for at in range(0, len(own), BLOCK):
                    part = b.take(pa.array(own[at : at + BLOCK]))
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in (part.column(0).to_numpy().tobytes(), b"".join(part.column(1).to_pylist()), part.column(2).to_numpy().tobytes()))], ["set", "q_ids", "q", "q_cells"])

    salts = max(1, min(64, n_data // 20_000 + 1))
    blocks = placed.mapInArrow(replicate, "set int, at long, ids binary, m binary, cells binary, ds binary").withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int")).drop("at")
    packs = placed_q.orderBy("cell", "id").mapInArrow(pack, "set int, q_ids binary, q binary, q_cells binary").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def solve(batches):
        best: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for (_g, q_ids), (scores, ids) in best.items():
                q = np.repeat(np.frombuffer(q_ids, np.int64), scores.shape[1])
                ok = scores.ravel() != LOW
                yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(ids.ravel()[ok]), pa.array(scores.ravel()[ok])], ["query_id", "vec_id", "score"])
            best.clear()

        held = 0
        for b in batches:
            for r in range(b.num_rows):
                ids, m, cells, ds, q_ids, q, q_cells = (np.frombuffer(b.column(c)[r].as_buffer(), t) for c, t in enumerate((np.int64, wide, np.int32, np.float64, np.int64, wide, np.int32)))
                m, q = m.reshape(len(ids), dims).astype(exact), q.reshape(len(q_ids), dims).astype(exact)
                for g in np.unique(q_cells):
                    near, own = np.flatnonzero(ds >= bounds.value[0][g][cells]), np.flatnonzero(q_cells == g)
                    if not len(near):
                        continue
                    mine = m if len(near) == len(ids) else m[near]
                    for s in range(0, len(own), 256):
                        names, who = q_ids[own[s : s + 256]], ids[near]
                        scores = (q[own[s : s + 256]] @ mine.T).astype(np.int64)
                        scores[names[:, None] == who[None, :]] = LOW
                        key = (g, names.tobytes())
                        if (old := best.get(key)) is None:
                            held += len(names)
                        elif old[0].shape[1] == k:  # only what may enter some list
                            may = np.flatnonzero((scores >= old[0][:, -1:]).any(0))
                            if not len(may):
                                continue
                            scores, who = scores[:, may], who[may]
                        found = _best(scores, who, k)
                        best[key] = found if old is None else _best(np.concatenate([old[0], found[0]], 1), np.concatenate([old[1], found[1]], 1), k)
                if held > 2 * SET:
                    yield from flush()
                    held = 0
        yield from flush()

    # never broadcast: Spark's estimate leaves the salts out, so the driver would hold all queries once a salt
    met = blocks.join(packs.hint("merge"), ["set", "salt"]).select("ids", "m", "cells", "ds", "q_ids", "q", "q_cells")
    near = met.mapInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
