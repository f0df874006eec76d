"""Token ids in compressed binary files: canonical, length-limited Huffman codes.

Writing takes two passes. The first puts the documents in ascending id order (one exchange
by ranges of about ``part_bytes`` bytes each, found by counting, as in ``sharding``; an id of
too many bytes for a range is split by its texts' hashes), encodes each whole text with a
tokenizer, and writes chunks of ids together
with their counts; the counts are summed over all chunks. From these global counts the code
lengths follow by package-merge, no longer than ``max_bits``, and from the lengths the
canonical codes. The second pass turns each chunk into one file; chunks don't move.

File format (little-endian): ``SWHUF001``; six unsigned 64-bit integers: ids in all files
before this one, ids, documents, ids a block, blocks, bytes of the packed code lengths; the
code lengths, one byte a symbol, deflated; per document its id, whether it has one (a byte
each) and its number of ids; per block the bit offset of its first code; the bit stream, in
64-bit big-endian words. A file needs nothing but itself to be read. Blocks decode
independently from their checkpoints, many at once, each step looking ``max_bits`` bits up
in a table of (symbol, length).

Nulls and odd inputs: a null text is empty and still gets the end id. A null id sorts first.
Documents with equal ids stay neighbours, in the order of their texts' hashes. An empty table writes
no files; reading them gives no rows. The literal of an added token in a text, such as
``<|endoftext|>``, is that token, as the library has it.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Workspace, col, hadoop_path, small_batches
from .sharding import LOWEST, boundaries, range_of, text_size

MAGIC = b"SWHUF001"
HEAD = struct.Struct("<8s6Q")
BLOCK_IDS = 512
CHUNK_IDS = 1 << 20
#: Ranges are larger where there would be more of them: one number a range reaches the driver.
MAX_RANGES = 1 << 16
#: Ids packed at a time: a multiple of the block.
PACK = 1 << 16
UNITS = 800_000
END_MARKS = frozenset(".,;:!?")
#: White space to Python alone.
SEPARATORS = "\x1c\x1d\x1e\x1f"
UNIT = re.compile(r"[^ \t-\r]+")


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` bits (package-merge); 0 for unused symbols."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if max_bits > 31:
        raise ValueError("codes have at most 31 bits")
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit in codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, leaves = weights, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        leaves.append(at < n)
    take, got = 2 * n - 2, np.zeros(n + 1, np.int64)
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:take].sum())
        got[0] += 1
        got[own] -= 1
        take = 2 * (min(take, len(is_leaf)) - own)
    lengths[order] = np.cumsum(got)[:n]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), each one more than the last."""
    codes = np.zeros(len(lengths), U64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        own = lengths[order].astype(np.int64)
        top = int(own[-1])
        steps = np.int64(1) << (top - own)
        codes[order] = ((np.cumsum(steps) - steps) >> (top - own)).astype(U64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray]:
    """(bits, symbol * 32 + length by the next ``bits`` bits)."""
    bits = int(lengths.max()) if len(lengths) and lengths.max() else 1
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    entries = np.repeat(order * 32 + lengths[order], np.int64(1) << (bits - lengths[order].astype(np.int64)))
    return bits, np.concatenate([entries, np.ones((1 << bits) - len(entries), np.int64)]).astype(np.uint32)


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(bit offset of each block, bit stream)."""
    aligned = codes << ((64 - lengths.astype(np.int64)) & 63).astype(U64)  # codes at the top of a word
    bits = lengths.astype(np.int64)
    starts, words, done = [], [np.zeros(1, U64)], 0
    for s in range(0, len(ids), PACK):
        part = ids[s : s + PACK]
        own, code = bits[part], aligned[part]
        ends = np.cumsum(own)
        at = ends - own + (done & 63)
        starts.append(at[::BLOCK_IDS] + (done & ~63))
        word, off = at >> 6, (at & 63).astype(U64)
        out = np.zeros((int(at[-1]) >> 6) + 2, U64)
        runs = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[runs]] = np.bitwise_or.reduceat(code >> off, runs)
        over = np.flatnonzero((at & 63) + own > 64)
        out[word[over] + 1] |= code[over] << (U64(64) - off[over])
        # the first word goes on where the last part ended
        out[0] |= words[-1][-1]
        words[-1] = words[-1][:-1]
        done += int(ends[-1])
        words.append(out[: (done >> 6) - ((done - int(ends[-1])) >> 6) + 1])
    blocks = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return blocks.astype("<u8"), np.concatenate([*words, np.zeros(1, U64)]).astype(">u8").tobytes()


def unpack(stream: np.ndarray, blocks: np.ndarray, n: int, table: tuple[int, np.ndarray], block_ids: int) -> np.ndarray:
    """All ids: every block advances by one code a step."""
    bits, entries = table
    out = np.empty((min(block_ids, n), len(blocks)), np.uint32)
    at = blocks.astype(np.int64)
    last, drop = len(stream) - 2, U64(64 - bits)
    for step in range(len(out)):
        word = np.minimum(at >> 6, last)
        off = (at & 63).astype(U64)
        # two shifts, as a shift by 64 is undefined
        look = ((stream[word] << off) | ((stream[word + 1] >> U64(1)) >> (U64(63) - off))) >> drop
        entries.take(look.view(np.int64), out=out[step], mode="clip")
        at += out[step] & 31
    return (out.T.ravel()[:n] >> 5).astype(np.int32)


def file_bytes(base: int, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, packed_lengths: bytes) -> bytes:
    blocks, stream = pack(ids, lengths, codes)
    head = HEAD.pack(MAGIC, base, len(ids), len(doc_ids), BLOCK_IDS, len(blocks), len(packed_lengths))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, packed_lengths, names.tobytes(), known.tobytes(), sizes.astype("<u8").tobytes(), blocks.tobytes(), stream])


def parse_file(content: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(ids before this file, document ids, ids of each document, all ids)."""
    magic, base, n, docs, block_ids, n_blocks, packed = HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    lengths = np.frombuffer(zlib.decompress(content[at : at + packed]), np.uint8)
    at += packed
    names = np.frombuffer(content, "<i8", docs, at)
    at += 8 * docs
    known = np.frombuffer(content, np.uint8, docs, at)
    at += docs
    sizes = np.frombuffer(content, "<u8", docs, at).astype(np.int64)
    at += 8 * docs
    blocks = np.frombuffer(content, "<u8", n_blocks, at)
    at += 8 * n_blocks
    stream = np.frombuffer(content, ">u8", -1, at).astype(U64)
    ids = unpack(stream, blocks, n, decode_table(lengths), block_ids) if n else np.zeros(0, np.int32)
    return base, [int(x) if k else None for x, k in zip(names, known, strict=True)], sizes, ids


class UnitEncoder:
    """Ids of whole texts by way of their runs of non-space characters, which this tokenizer never joins.

    Equal runs get equal ids wherever they stand, so a bounded table per worker holds them
    and only runs not in it go to the tokenizer. What the tokenizer does to a run of letters
    below U+0130 before its merges is known (lower case, bytes as characters; such letters are
    in NFC as they are, and one word), so these go to its model directly, with or without a mark
    at the end, if trials at the start confirm it; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE)  # more than the library finds is no harm
        self.starts = {c for t in added for c in (t[0], t[0].lower(), t[0].upper())}
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.wide = "<u2" if size <= 1 << 16 else "<u4"
        self.raw = [x.tobytes() for x in np.arange(size).astype(self.wide)]
        self.units = _Held(self._learn)
        self.marks = {m: self._whole([m])[0] for m in END_MARKS}
        shown = sorted(ByteLevel.alphabet())
        plain = [b for b in range(256) if chr(b) in shown]  # the other bytes take what is left, in order
        self.bytes = {b: chr(b) for b in plain} | dict(zip((b for b in range(256) if b not in plain), (c for c in shown if ord(c) > 255), strict=True))
        trials = ["The", "zebra", "Éclair", "straße", "niño", "xqzv", "OBEN", "ªº", "Çà", "internationalisation", "ÿŸĀđ"[:3]]
        self.direct = all(self._word(t) == self._whole([t])[0] for t in trials) and self._whole(["Word."])[0] == self._word("Word") + self.marks["."]

    def _whole(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.wide).tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        low = word.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.bytes)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.tokenize(low)])

    def _learn(self, unit: str) -> bytes:
        units = self.units
        if self.direct and unit.isascii() and unit.isalpha() and len(unit) < 64:
            raw = self.raw
            found = b"".join([raw[t.id] for t in self.tokenize(unit.lower())])
            if len(units) >= UNITS:
                units.clear()
            units[unit] = found
            return found
        found = None
        if self.direct and (unit.isascii() or max(unit) < "\u0130"):
            if unit.isalpha():
                found = self._word(unit)
            elif unit[-1] in END_MARKS and unit[:-1].isalpha():
                found = (units.get(unit[:-1]) or self._word(unit[:-1])) + self.marks[unit[-1]]
        if found is None:
            found = self._whole([unit])[0]
        if len(unit) < 64:
            if len(units) >= UNITS:
                units.clear()
            units[unit] = found
        return found

    def encode_text(self, text: str) -> bytes:
        """What the library gives as it comes: a text that may hold an added token goes through the whole tokenizer."""
        if any(c in text for c in self.starts) and self.added.search(text):
            self.tokenizer.encode_special_tokens = False
            try:
                return self._whole([text])[0]
            finally:
                self.tokenizer.encode_special_tokens = True
        return self.encode(text)

    def encode(self, text: str) -> bytes:
        """Little-endian ids of a text, of ``wide`` each; added tokens in it are ordinary text."""
        words = UNIT.findall(text) if any(c in text for c in SEPARATORS) else text.split()
        return b"".join(map(self.units.__getitem__, words))


class _Held(dict):
    """A table that learns what it lacks."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        return self.learn(key)


_ENCODERS: dict[str, UnitEncoder] = {}


def unit_encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def _chunks(docs: DataFrame, tokenizer: str, end_id: int, chunk_ids: int) -> DataFrame:
    """Rows of (part, chunk, ids before it in its part, doc_ids, sizes, ids, symbols, counts); documents ascend within and across them."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc = unit_encoder(tokenizer)
        end, width = np.array([end_id], enc.wide).tobytes(), np.dtype(enc.wide).itemsize
        names: list[int | None] = []
        parts: list[bytes] = []
        part, chunk, held, before, total = 0, 0, 0, 0, np.zeros(len(enc.raw), np.int64)

        def flush(last: bool = False):
            ids = np.frombuffer(b"".join(parts), enc.wide)
            total[:] += np.bincount(ids, minlength=len(total))
            symbols = np.flatnonzero(total) if last else np.zeros(0, np.int64)  # counts go with a task's last row
            counts = total[symbols]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([before], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([[len(p) // width for p in parts]], pa.list_(pa.int64())),
                    pa.array([ids.tobytes()], pa.binary()), pa.array([symbols.tolist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64())),
                ],
                ["part", "chunk", "before", "doc_ids", "sizes", "ids", "symbols", "counts"],
            )

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                part = b.column(0)[0].as_py()
                for name, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    names.append(name)
                    parts.append(enc.encode_text(t or "") + end)
                    held += len(parts[-1]) // width
                    if held >= chunk_ids:
                        yield flush()
                        names, parts, held, chunk, before = [], [], 0, chunk + 1, before + held
        if names or chunk:
            yield flush(last=True)

    return docs.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, "part int, chunk int, before long, doc_ids array<long>, sizes array<long>, ids binary, symbols array<long>, counts array<long>")


def write_ids(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", *, end_id: int = 1, max_bits: int = 18, part_bytes: int = 16 << 20, chunk_ids: int = CHUNK_IDS) -> None:
    """Write the ids of every document to token files below ``path``, a folder that all executors share.

    ``tokenizer``: a tokenizer file that all executors can read. A file holds about
    ``chunk_ids`` ids (one document's at least). Each file is written under
    another name and then renamed, so a task that runs twice leaves one whole file.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "token-file")
    small_batches(spark)
    source = docs.select(col(docs, doc_id).cast("long").alias("doc_id"), col(docs, text).alias("text"))
    key, hashed = F.coalesce("doc_id", F.lit(LOWEST)), F.xxhash64("text")
    narrow = ws.cut(source.select(key.alias("key"), hashed.alias("id"), text_size(F.col("text")).alias("size")), "sizes")
    total, n, low, high = narrow.agg(F.sum("size"), F.count("size"), F.min("key"), F.max("key")).first()
    ranges = max(1, min(-(-(total or 0) // part_bytes), MAX_RANGES))
    cuts = boundaries(narrow, total or 0, n, ranges, 1, 0.0, (low ^ high).bit_length() if n and (low < 0) == (high < 0) else 64)
    ws.drop("sizes")
    part = range_of(key, hashed, cuts, spark)
    ordered = source.withColumn("hash", hashed).repartitionById(len(cuts) + 1, part).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash")
    chunks = ws.cut(_chunks(ordered, tokenizer, end_id, chunk_ids), "chunks")
    pairs = chunks.select(F.explode(F.arrays_zip("symbols", "counts")).alias("x")).groupBy(F.col("x.symbols").alias("symbol")).agg(F.sum("x.counts").alias("n"))
    seen = pairs.collect()  # one row for each id of the vocabulary
    counts = np.zeros(max((r["symbol"] for r in seen), default=0) + 1, np.int64)
    for r in seen:
        counts[r["symbol"]] = r["n"]
    lengths = code_lengths(counts, max_bits)
    table = spark.sparkContext.broadcast((lengths, canonical_codes(lengths), zlib.compress(lengths.tobytes(), 9)))
    n_ids = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = chunks.groupBy("part").agg(F.max(F.col("before") + n_ids).alias("n")).collect()  # one number a partition
    before, starts = 0, []
    for r in sorted(totals):
        starts.append((r["part"], before))
        before += r["n"]
    p, fs = hadoop_path(spark, path)
    fs.mkdirs(p)
    target = fs.makeQualified(p).toString()
    base = spark.createDataFrame(starts, "part int, start long")  # as many rows as partitions

    def encode(batches):
        from pyarrow import fs as pafs

        lengths, codes, packed = table.value
        store, folder = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", target))
        for b in batches:
            for r in b.to_pylist():
                body = file_bytes(r["base"], r["doc_ids"], np.array(r["sizes"], np.int64), np.frombuffer(r["ids"], f"<u{len(r['ids']) // max(sum(r['sizes']), 1) or 2}"), lengths, codes, packed)
                name = f"{folder}/part-{r['part']:06d}-{r['chunk']:05d}.swh"
                own = f"{folder}/.{os.urandom(8).hex()}.tmp"
                with store.open_output_stream(own) as f:
                    f.write(body)
                store.move(own, name)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(body)], pa.int64())], ["file", "bytes"])

    written = chunks.join(F.broadcast(base), "part").select("part", "chunk", "doc_ids", "sizes", "ids", (F.col("start") + F.col("before")).alias("base")).mapInArrow(encode, "file string, bytes long")
    written.agg(F.count("file"), F.sum("bytes")).collect()
    ws.drop()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): from the files below ``path``; ids are little-endian 32-bit integers."""

    def parse(batches):
        for b in batches:
            for content in b.column(0):
                base, names, sizes, ids = parse_file(content.as_py())
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4").tobytes()
                for s in range(0, len(names), 1024):
                    own, e = sizes[s : s + 1024], ends[s : s + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[s : s + 1024], pa.int64()), pa.array(base + e - own, pa.int64()), pa.array(own, pa.int64()), pa.array([raw[4 * (x - k) : 4 * x] for x, k in zip(e, own, strict=True)], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.swh").load(path).select("content")
    return files.mapInArrow(parse, "doc_id long, start long, n_tokens long, ids binary")
