"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token (a match of the split pattern) is merged on a doubly linked list of symbols.
The pairs wait in buckets, one per merge rank, that hold list positions; two levels of
256-bit words mark the buckets that aren't empty, and find-first-set picks the lowest rank.
Entries whose pair has changed since are stale and skipped. A merge costs a constant number
of word operations whatever the pre-token's length, so a pre-token of a million bytes takes
time in proportion to it, where scanning for the best pair takes its square.

Equal pre-tokens repeat, so their ids are kept in two generations of tables per task, bounded
in bytes: when the young one is full it becomes the old one, and what is used again of the old
one moves to the young one, so frequent words stay. Texts are cut
at single spaces before the pattern runs, where the pattern cuts too; a text in which a
space touches other white space goes through the pattern whole.

Nulls and odd inputs: a null text is empty and has no ids; null ids decode to no bytes.
Columns named like the results are replaced, others carried along.
"""

from __future__ import annotations

import base64
import re
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, map_batches, small_batches, tidy

TOUCHING = re.compile(r"\s (?:\s|\Z)|  ")
#: Bytes, about, of each of a task's two generations of held strings, and what an entry takes beside its characters and ids.
HELD_BYTES, ENTRY_BYTES = 48 << 20, 200
END_MARKS = frozenset(".,;:!?")
AFTER, BEFORE = list(range(1, 65)), list(range(-1, 63))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Spaced(dict):
    """A table that learns what it lacks."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        return self.learn(key)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.low_ids = bytes(self.byte_ids) if max(self.byte_ids) < 256 else None
        size = max(ranks.values()) + 1
        #: the queue, empty between calls: which words of ``low`` aren't 0 is for ``merge`` to know
        self.low, self.buckets = [0] * ((size >> 8) + 1), [None] * size
        self.bits = [1 << i for i in range(max(256, len(self.low)))]
        #: left id -> right id -> the id of both together, which is also the rank of the merge
        none: dict[int, int] = {}
        self.pairs = [none] * size
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    if self.pairs[a] is none:
                        self.pairs[a] = {}
                    self.pairs[a][b] = rank
        #: ids of pre-tokens, and of a space and what follows it
        self.plain: dict[str, bytes] = {}
        self.spaced = _Spaced(self._missed)
        self.old_plain: dict[str, bytes] = {}
        self.old_spaced: dict[str, bytes] = {}
        self.room = HELD_BYTES
        self.tokens = {v: k for k, v in ranks.items()}
        self.lengths = np.zeros(size, np.int64)
        for k, v in ranks.items():
            self.lengths[v] = len(k)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the pair of lowest rank, the leftmost of equals.

        A bucket is None, one position, or a heap of positions.
        """
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        low, buckets, pairs, bits, top = self.low, self.buckets, self.pairs, self.bits, 0
        n = len(piece)
        ids = list(piece.translate(self.low_ids)) if self.low_ids else [self.byte_ids[b] for b in piece]
        nxt, prv = (AFTER[:n], BEFORE[:n]) if n <= len(AFTER) else (list(range(1, n + 1)), list(range(-1, n - 1)))
        rank_at = [-1] * n
        left = pairs[ids[0]] if n else None
        for i in range(n - 1):
            right = ids[i + 1]
            if (r := left.get(right)) is not None:
                rank_at[i] = r
                if (bucket := buckets[r]) is None:
                    buckets[r] = i
                    low[r >> 8] |= bits[r & 255]
                    top |= bits[r >> 8]
                elif bucket.__class__ is int:
                    buckets[r] = [bucket, i]
                else:
                    bucket.append(i)  # ascending, so a heap
            left = pairs[right]
        while top:
            at = (top & -top).bit_length() - 1
            word = low[at]
            bit = word & -word
            r = (at << 8) + bit.bit_length() - 1
            i = buckets[r]
            if i.__class__ is int:
                buckets[r] = None
                if word == bit:
                    low[at] = 0
                    top &= top - 1
                else:
                    low[at] = word ^ bit
            else:
                bucket, i = i, heappop(i)
                if len(bucket) == 1:
                    buckets[r] = bucket[0]
            if rank_at[i] != r:
                continue  # stale
            j = nxt[i]
            k = nxt[j]
            ids[i], nxt[i], rank_at[j], rank_at[i] = r, k, -1, -1
            if k < n:
                prv[k] = i
                if (new := pairs[r].get(ids[k])) is not None:
                    rank_at[i] = new
                    if (bucket := buckets[new]) is None:
                        buckets[new] = i
                        low[new >> 8] |= bits[new & 255]
                        top |= bits[new >> 8]
                    elif bucket.__class__ is int:
                        buckets[new] = [bucket, i] if bucket < i else [i, bucket]
                    else:
                        heappush(bucket, i)
            h = prv[i]
            if h >= 0:
                if (new := pairs[ids[h]].get(r)) is None:
                    rank_at[h] = -1
                elif rank_at[h] != new:
                    rank_at[h] = new
                    if (bucket := buckets[new]) is None:
                        buckets[new] = h
                        low[new >> 8] |= bits[new & 255]
                        top |= bits[new >> 8]
                    elif bucket.__class__ is int:
                        buckets[new] = [bucket, h] if bucket < h else [h, bucket]
                    else:
                        heappush(bucket, h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = nxt[i]
        return out

    def _ids(self, word: str) -> bytes:
        return array("i", self.merge(word.encode("utf-8", "surrogatepass"))).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a pre-token; those with a space in front are held without it."""
        if piece[0] == " ":
            key = piece[1:]
            found = self.spaced.get(key) or self.old_spaced.get(key) or self._ids(piece)
            if key not in self.spaced:
                self._hold(self.spaced, key, found)
            return found
        found = self.plain.get(piece)
        if found is None:
            found = self.old_plain.get(piece) or self._ids(piece)
            self._hold(self.plain, piece, found)
        return found

    def _hold(self, held: dict[str, bytes], key: str, ids: bytes) -> None:
        if len(key) < 64:
            held[key] = ids
            self.room -= ENTRY_BYTES + len(key) + len(ids)
            if self.room < 0:  # what was young is old now; the tables in use stay the same objects
                self.old_plain, self.old_spaced = dict(self.plain), dict(self.spaced)
                self.plain.clear()
                self.spaced.clear()
                self.room = HELD_BYTES

    def _missed(self, unit: str) -> bytes:
        """Ids of a space and ``unit``, which has no space and isn't in the young table."""
        found = self.old_spaced.get(unit)
        if found is None:
            return self._unit(unit)
        self._hold(self.spaced, unit, found)
        return found

    def _unit(self, unit: str) -> bytes:
        """Ids of a space and ``unit``, which has no space, when it isn't held."""
        if unit.isalpha():
            found = self._ids(" " + unit)
        elif unit[-1:] in END_MARKS and unit[:-1].isalpha():
            known = self.spaced.get(unit[:-1]) or self.old_spaced.get(unit[:-1])
            if known is None:  # seldom again with this mark: only the word is held
                return self._piece(" " + unit[:-1]) + self._piece(unit[-1])
            found = known + self._piece(unit[-1])
        else:
            found = b"".join(map(self._piece, self.split(" " + unit)))
        self._hold(self.spaced, unit, found)
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if TOUCHING.search(text):
            return b"".join(map(self._piece, self.split(text)))
        head, *rest = text.split(" ")
        return b"".join(map(self._piece, self.split(head))) + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)].tobytes()


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder for each vocabulary, for as long as a task runs: a waiting worker should hold nothing."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text. ``path``: a rank file that all executors can read.

    ``decoded``: a column for the bytes decoded from the ids, in the same pass.
    """
    small_batches(docs.sparkSession)
    new = [c for c in (into, decoded) if c]
    base = docs.drop(*(c for c in new if c in docs.columns))
    names = base.columns
    source = base.select(*(col(base, c) for c in names), col(docs, text).alias(fresh(base, "text")))

    def run(batches):
        bpe = encoder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                parts = [bpe.encode(t) if t else b"" for t in b.column(b.num_columns - 1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))
                more = [pa.array([bpe.decode(np.frombuffer(p, "<i4")) for p in parts], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, *more], [*names, *new])
        del bpe
        _LOADED.clear()
        tidy()

    types = [T.ArrayType(T.IntegerType()), T.BinaryType()]
    return map_batches(source, run, T.StructType([*base.schema.fields, *(T.StructField(c, t) for c, t in zip(new, types, strict=False))]))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for."""
    small_batches(encoded.sparkSession)
    base = encoded.drop(into) if into in encoded.columns else encoded
    names = base.columns

    def run(batches):
        bpe = encoder(path, pattern)
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 1024):
                b = whole.slice(at, 1024)
                lists = b.column(names.index(ids))
                out = [bpe.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in lists]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*names, into])

    return map_batches(base, run, T.StructType([*base.schema.fields, T.StructField(into, T.BinaryType())]))


def ids_text(ids: str) -> Column:
    """Decimal ids joined by one space."""
    return F.concat_ws(" ", F.col(ids).cast("array<string>"))
