"""Bloom filters over 64-bit hashes: numpy bit arrays, built in parallel and merged by OR.

Both kinds are blocked: a hash picks one 64-byte block and sets eight bits inside it, so
that a probe touches one cache line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, col, fresh, mix64, row_count_bound

BLOCK_BITS, PROBES = 512, 8
SEGMENT_BYTES = 1 << 20


def bytes_for(n: int, bits_per_key: float) -> int:
    """What a filter of ``n`` keys takes without a bound."""
    return (int(n * bits_per_key) // BLOCK_BITS + 1) * (BLOCK_BITS // 8)


def blocks_for(n: int, bits_per_key: float, max_bytes: int) -> int:
    """Blocks for ``n`` keys, never more than ``max_bytes`` allow.

    A filter at its bound lets more keys pass than it should; it never loses one, so what
    follows is still exact.
    """
    return max(1, min(int(n * bits_per_key) // BLOCK_BITS + 1, max_bytes // (BLOCK_BITS // 8)))


def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Per hash: the first word (64 bits) of its block and eight bit positions in the block."""
    h = mix64(hashes.view(U64) if hashes.dtype == np.int64 else hashes)
    block = ((h >> U64(32)) * U64(blocks)) >> U64(32)
    g = mix64(h + U64(0x9E3779B97F4A7C15))
    shifts = (np.arange(PROBES, dtype=U64) * U64(7)) + U64(1)  # 8 probes of 9 bits each from overlapping windows
    bits = (g[:, None] >> shifts[None, :]) & U64(BLOCK_BITS - 1)
    return (block * U64(BLOCK_BITS // 64)).astype(np.int64), bits.astype(np.int64)


def add(words: np.ndarray, hashes: np.ndarray) -> None:
    if len(hashes):
        base, bits = places(hashes, len(words) * 64 // BLOCK_BITS)
        np.bitwise_or.at(words, (base[:, None] + (bits >> 6)).ravel(), (U64(1) << (bits & 63).astype(U64)).ravel())


def might_contain(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(0, bool)
    base, bits = places(hashes, len(words) * 64 // BLOCK_BITS)
    return ((words[base[:, None] + (bits >> 6)] >> (bits & 63).astype(U64)) & U64(1)).all(axis=1)


def _segments(*filters: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = SEGMENT_BYTES // 8
    for s in range(0, len(filters[0]), step):
        parts = [f[s : s + step] for f in filters]
        if any(p.any() for p in parts):
            yield pa.RecordBatch.from_arrays([pa.array([s // step], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["segment", *"ab"[: len(parts)]])


def _merge_once(table: pa.Table) -> pa.Table:
    a = np.frombuffer(table["a"][0].as_py(), U64).copy()
    for x in table["a"][1:]:
        a |= np.frombuffer(x.as_py(), U64)
    return pa.table({"segment": table["segment"][:1], "a": pa.array([a.tobytes()], pa.binary())})


def _merge_twice(table: pa.Table) -> pa.Table:
    """once = any once; twice = any twice, or once in two parts."""
    once, twice = np.frombuffer(table["a"][0].as_py(), U64).copy(), np.frombuffer(table["b"][0].as_py(), U64).copy()
    for x, y in zip(table["a"][1:], table["b"][1:], strict=True):
        more = np.frombuffer(x.as_py(), U64)
        twice |= np.frombuffer(y.as_py(), U64) | (once & more)
        once |= more
    return pa.table({"segment": table["segment"][:1], "a": pa.array([once.tobytes()], pa.binary()), "b": pa.array([twice.tobytes()], pa.binary())})


def _gather(rows, blocks: int, field: str) -> np.ndarray:
    words, step = np.zeros(blocks * BLOCK_BITS // 64, U64), SEGMENT_BYTES // 8
    for r in rows:
        part = np.frombuffer(bytes(r[field]), U64)
        words[r["segment"] * step : r["segment"] * step + len(part)] = part
    return words


def build(hashes: DataFrame, blocks: int) -> np.ndarray:
    """A filter of the single long column of ``hashes``. At most ``blocks`` * 64 bytes reach the driver."""

    def partial(batches):
        words = np.zeros(blocks * BLOCK_BITS // 64, U64)
        for b in batches:
            add(words, b.column(0).drop_null().to_numpy(zero_copy_only=False))
        yield from _segments(words)

    parts = hashes.mapInArrow(partial, "segment long, a binary")
    rows = parts.groupBy("segment").applyInArrow(_merge_once, "segment long, a binary").toLocalIterator()
    return _gather(rows, blocks, "a")


def builders_for(n: int, blocks: int) -> int:
    """Tasks that each build a whole filter: so many that what they send to be merged stays near the size of the hashes."""
    return max(1, 4 * 8 * n // (blocks * BLOCK_BITS // 8) + 1)


def build_twice(hash_lists: DataFrame, blocks: int, builders: int) -> np.ndarray:
    """The twice-seen filter of a column of lists of hashes, each list one document's distinct hashes.

    Two filters grow side by side: a hash whose eight bits are already set in the once-seen
    filter goes into the twice-seen one. Parts are merged by OR, and a bit set once in each
    of two parts is set twice. A hash that two documents hold is always in the result.
    """

    def partial(batches):
        once, twice = (np.zeros(blocks * BLOCK_BITS // 64, U64) for _ in range(2))
        for b in batches:
            h = b.column(0).flatten().drop_null().to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            h, n = np.unique(h, return_counts=True)
            add(twice, h[(n > 1) | might_contain(once, h)])
            add(once, h)
        yield from _segments(once, twice)

    parts = hash_lists.coalesce(builders).mapInArrow(partial, "segment long, a binary, b binary")
    merged = parts.groupBy("segment").applyInArrow(_merge_twice, "segment long, a binary, b binary")
    return _gather(merged.select("segment", "b").toLocalIterator(), blocks, "b")


def seen_twice(hash_lists: DataFrame, n: int, bits_per_key: float, max_bytes: int) -> DataFrame:
    """(h): distinct hashes that two lists hold, and a few others; for more keys than one filter has room for.

    The hash space is cut into parts whose filters take ``max_bytes`` at most. A hash goes to its
    part's task, once a batch and with a note if the batch had it twice, so a hash of a third of
    all lists is no hot key. The task fills a once-seen filter of the part's size and passes on
    what that holds already.
    """
    parts = -(-bytes_for(n, bits_per_key) // max_bytes)
    blocks = blocks_for(-(-n // parts), bits_per_key, max_bytes)

    def notes(batches):
        for b in batches:
            h, k = np.unique(b.column(0).flatten().drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            part = mix64(h.view(U64) ^ U64(0x5BD1E995)) % U64(parts)  # not the bits that pick a block
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(h), pa.array(k > 1)], ["part", "h", "more"])

    def fill(batches):
        filters: dict[int, np.ndarray] = {}
        for b in batches:
            part, h, more = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            for p in np.unique(part):
                once = filters.setdefault(int(p), np.zeros(blocks * BLOCK_BITS // 64, U64))
                at = np.flatnonzero(part == p)
                own, where, k = np.unique(h[at], return_inverse=True, return_counts=True)
                again = (k > 1) | (np.bincount(where, more[at], len(own)) > 0) | might_contain(once, own)
                add(once, own)
                yield pa.RecordBatch.from_arrays([pa.array(own[again])], ["h"])

    noted = hash_lists.mapInArrow(notes, "part int, h long, more boolean")
    return noted.repartitionById(parts, "part").mapInArrow(fill, "h long").distinct()


def probe_udf(words: np.ndarray, spark):
    """A column function: long -> boolean, true for every key of the filter and a few others."""
    sent = spark.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def probe(h: pa.Array) -> pa.Array:
        return pa.array(might_contain(sent.value, h.fill_null(0).to_numpy(zero_copy_only=False)), pa.bool_())

    return probe


def drop_ids(docs: DataFrame, doc_id: str, gone: DataFrame, broadcast_rows: int = 500_000, filter_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``gone``; null ids stay.

    A few ids (8 bytes each, counted) are sent to all tasks. Otherwise a Bloom filter of them
    does the first cut, so that only rows that it holds back meet the ids in an exchange.
    """
    name = fresh(docs, "gone")
    ids = gone.select(gone[gone.columns[0]].alias(name)).where(F.col(name).isNotNull())
    own = col(docs, doc_id)
    if row_count_bound(ids, broadcast_rows) is not None:
        return docs.join(F.broadcast(ids), own == F.col(name), "left_anti")
    n = ids.count()
    maybe = probe_udf(build(ids.select(F.xxhash64(name).alias("h")), blocks_for(n, 12, filter_bytes)), docs.sparkSession)
    held = maybe(F.xxhash64(own))
    return docs.where(~held | own.isNull()).unionByName(docs.where(held & own.isNotNull()).join(ids, own == F.col(name), "left_anti"))
