"""Sharding by histogram sort: shards of near-equal bytes, found by counting, filled in one exchange.

Rows are ordered by (hash of the text, id), so that equal texts are neighbours. The
boundaries between shards are found without sorting: each round counts the exact bytes and
rows between candidate boundaries (a histogram of 4,096 bins over the key space, computed
with partial aggregation), and looks more closely only at the bins that hold a target, until
every boundary is within ``tolerance`` of its target. A group of equal texts stays in one
shard if the boundary can move to either side of it within the tolerance; a group too heavy
for that is split by id, so a text that a third of all rows hold doesn't unbalance anything.
Then the whole rows move once, into ranges of about ``part_bytes``; counted rows below each
range give every row its place in its shard.

The key must be the same for a row wherever it is computed, so lost executors change nothing.

Nulls and odd inputs: a null text has no bytes, a null id sorts first, an empty table gives
an empty result, repeated rows with equal ids stay neighbours and can't be split from each
other. Further columns are carried along; ``shard`` and ``slot`` replace columns of these names.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, col, fresh

STEP_BITS = 12
#: Bins that a round of counting may have, whatever the number of boundaries looked for.
MAX_BINS = 1 << 18
#: Up to so many boundaries are compared by an expression; more are searched in an Arrow function.
TREE = 64
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Boundary:
    """Rows with (key, id) below (``key``, ``id``) lie under it: so many bytes and rows. No id: below all ids."""

    key: int
    id: int | None
    bytes: int
    rows: int


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)


def _histogram(rows: DataFrame, value: str, bits: int) -> list[tuple[int, int, int]]:
    """(bin, bytes, rows) by the value without its lowest ``bits`` bits, in order."""
    found = rows.groupBy(F.shiftright(value, bits).alias("bin")).agg(F.sum("size").alias("size"), F.count("size").alias("n")).collect()
    return sorted((r["bin"], r["size"], r["n"]) for r in found)


def _inside(rows: DataFrame, value: str, bits: int, bins: list[int]) -> DataFrame:
    """The rows of these bins; many bins are sent as a table, not as literals of the plan."""
    own = F.shiftright(value, bits)
    if len(bins) <= 1000:
        return rows.where(own.isin(bins))
    wanted = rows.sparkSession.createDataFrame(pd.DataFrame({"__bin": np.array(bins, np.int64)}))
    return rows.join(F.broadcast(wanted), own == F.col("__bin"), "left_semi")  # as many as boundaries


def _refine(rows: DataFrame, value: str, targets: dict[int, tuple[float, float]], below: tuple[int, int], width: int = 64) -> tuple[dict[int, tuple[int, int, int]], dict[int, tuple[int, int, int, int, int]]]:
    """Find, for each target (bytes below, tolerance), a boundary of ``value``, whose values differ in the lowest ``width`` bits alone.

    Returns those found, as (value, bytes, rows below), and those where all weight sits on
    one value, as (value, bytes and rows below it, its bytes, its rows).
    """
    found: dict[int, tuple[int, int, int]] = {}
    heavy: dict[int, tuple[int, int, int, int, int]] = {}
    open_: list[tuple[int | None, int, tuple[int, int], list[int]]] = [(None, width, below, list(targets))]
    while open_:
        step = max(2, min(STEP_BITS, (MAX_BINS // len(open_)).bit_length() - 1))
        bits = max(0, open_[0][1] - step)
        scope = rows if open_[0][0] is None else _inside(rows, value, open_[0][1], [o[0] for o in open_])
        bins = _histogram(scope, value, bits)
        later: dict[int, tuple[int, int, tuple[int, int], list[int]]] = {}
        for parent, width, (base, n_base), names in open_:
            own = [b for b in bins if parent is None or b[0] >> (width - bits) == parent]
            edges, sizes, counts = [], [base], [n_base]
            for b, size, n in own:
                edges.append(b << bits)
                sizes.append(sizes[-1] + size)
                counts.append(counts[-1] + n)
            for t in names:
                target, tolerance = targets[t]
                k = min(max(bisect_right(sizes, target) - 1, 0), len(own) - 1)
                near = k if target - sizes[k] <= sizes[k + 1] - target else k + 1
                past = edges[near] if near < len(edges) else ((own[-1][0] + 1) << bits)
                if abs(sizes[near] - target) <= tolerance and past <= HIGHEST:
                    found[t] = (past, sizes[near], counts[near])
                elif bits == 0:
                    heavy[t] = (own[k][0], sizes[k], counts[k], own[k][1], own[k][2])
                else:
                    later.setdefault(own[k][0], (own[k][0], bits, (sizes[k], counts[k]), []))[3].append(t)
        open_ = list(later.values())
    return found, heavy


def boundaries(rows: DataFrame, total: int, n_rows: int, ranges: int, shards: int, tolerance: float, width: int = 64) -> list[Boundary]:
    """``ranges`` - 1 boundaries over (key, id, size) rows; each ``ranges`` / ``shards``-th lies between shards."""
    per = ranges // shards
    targets = {i: (total * i / ranges, total / shards * tolerance if i % per == 0 else total / ranges / 4) for i in range(1, ranges)}
    found, heavy = _refine(rows, "key", targets, (0, 0), width) if targets and n_rows else ({}, {})
    out = {i: Boundary(key, None, size, n) for i, (key, size, n) in found.items()}
    by_key: dict[int, list[int]] = {}
    for i, (key, *_rest) in heavy.items():
        by_key.setdefault(key, []).append(i)
    for key, names in by_key.items():  # as many as there are groups heavier than the tolerance that hold a target: fewer than ranges
        _, size, n, own, own_n = heavy[names[0]]
        inner, stuck = _refine(rows.where(F.col("key") == key), "id", {i: targets[i] for i in names}, (size, n)) if own_n > 1 else ({}, {i: heavy[i] for i in names})
        out |= {i: Boundary(key, at, b, c) for i, (at, b, c) in inner.items()}
        for i, (at, b, c, w, k) in stuck.items():
            start = (key, at if own_n > 1 else None)
            after = (key, at + 1) if own_n > 1 and at < HIGHEST else (key + 1, None)
            near_start = targets[i][0] - b <= b + w - targets[i][0] or after[0] > HIGHEST
            out[i] = Boundary(*(start if near_start else after), *((b, c) if near_start else (b + w, c + k)))
    order = sorted(out.values(), key=lambda x: (x.key, LOWEST if x.id is None else x.id))
    return order


def _tree(key: Column, id_: Column, cuts: list[Boundary], at: int = 0) -> Column:
    if not cuts:
        return F.lit(at)
    m = len(cuts) // 2
    c = cuts[m]
    above = key >= F.lit(c.key) if c.id is None else (key > F.lit(c.key)) | ((key == F.lit(c.key)) & (id_ >= F.lit(c.id)))
    return F.when(above, _tree(key, id_, cuts[m + 1 :], at + m + 1)).otherwise(_tree(key, id_, cuts[:m], at))


def range_of(key: Column, id_: Column, cuts: list[Boundary], spark: SparkSession) -> Column:
    """How many boundaries lie at or below (key, id)."""
    if len(cuts) <= TREE:
        return _tree(key, id_, cuts)
    sent = spark.sparkContext.broadcast((np.array([c.key for c in cuts], np.int64), np.array([LOWEST if c.id is None else c.id for c in cuts], np.int64)))

    @F.arrow_udf("int")
    def search(keys: pa.Array, ids: pa.Array) -> pa.Array:
        cut_keys, cut_ids = sent.value
        k, i = keys.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
        low, out = np.searchsorted(cut_keys, k, "left"), np.searchsorted(cut_keys, k, "right")
        for start in np.unique(low[low < out]):  # keys that boundaries split
            rows = np.flatnonzero((low == start) & (low < out))
            end = out[rows[0]]
            out[rows] = start + np.searchsorted(cut_ids[start:end], i[rows], "right")
        return pa.array(out.astype(np.int32))

    return search(key, id_)


def shard_by_bytes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, shards: int = 8, tolerance: float = 0.02, part_bytes: int = 16 << 20, max_ranges: int = 1 << 18
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (the row's place in its shard, from 0).

    Ranges are of about ``part_bytes``, larger if there would be more than ``max_ranges``:
    what is counted and sent is bounded by that number.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    key, id_, range_ = (fresh(docs, x) for x in ("key", "id", "range"))
    docs = docs.drop(*(c for c in ("shard", "slot") if c in docs.columns))
    hashed, ordered = F.xxhash64(col(docs, text)), F.coalesce(col(docs, doc_id).cast("long"), F.lit(LOWEST))
    narrow = ws.cut(docs.select(hashed.alias("key"), ordered.alias("id"), text_size(col(docs, text)).alias("size")), "keys")
    total, n = narrow.agg(F.sum("size"), F.count("size")).first()
    per = max(1, min(-(-(total or 0) // (shards * part_bytes)), max_ranges // shards))
    cuts = boundaries(narrow, total or 0, n, per * shards, shards, tolerance)
    ws.drop()
    full = docs.withColumns({key: hashed, id_: ordered})
    full = full.withColumn(range_, range_of(F.col(key), F.col(id_), cuts, docs.sparkSession)).repartitionById(len(cuts) + 1, F.col(range_))
    starts = [0, *(c.rows for c in cuts)] if n else [0] * (per * shards)
    first = [starts[min(i // per * per, len(starts) - 1)] for i in range(len(starts))]
    before = fresh(docs, "before")
    gaps = docs.sparkSession.createDataFrame([(i, s - f) for i, (s, f) in enumerate(zip(starts, first, strict=True))], f"{range_} int, {before} long")
    place = F.row_number().over(Window.partitionBy(range_).orderBy(key, id_)).cast("long") - F.lit(1)
    placed = full.withColumn("slot", place).join(F.broadcast(gaps), range_)  # at most max_ranges rows
    out = placed.withColumns({"shard": (F.col(range_) / F.lit(per)).cast("int"), "slot": F.col("slot") + F.col(before)})
    out = out.select(*(col(out, c) for c in docs.columns), "shard", "slot", key, id_, range_)
    return out.drop(key, id_, range_)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
