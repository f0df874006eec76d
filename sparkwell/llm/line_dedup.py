"""Line dedup: drop lines that many documents share, keeping one occurrence.

A line is what stands between two ``\\n``. Its key is the line with ASCII white space
stripped at both ends and A-Z lower-cased. Keys of at least ``min_chars`` code points that
occur in at least ``min_docs`` documents lose all their lines, except in one document (the
one with the largest id). Method:

1. one pass over the texts writes, per document, the digests of its distinct long keys;
2. two Bloom filters over the digests, once seen and twice seen, are built from that narrow
   table; only digests in the twice-seen filter are suspects. Where a filter of the size that
   all lines need would exceed ``filter_bytes``, the hash space is cut into parts that don't:
   the hashes (8 bytes each, equal ones of a batch once) go to the task of their part, which
   fills that part's once-seen filter and passes on what it holds already; those hashes, fewer
   by all lines that stand alone, make up the twice-seen filter or, if there are too many for
   one, are joined with the lines. So filters stay as selective at any size;
3. only suspects shuffle: (digest, document) pairs are counted exactly, first per pair and
   then per digest, so that a line that a third of all documents hold is combined on the
   map side;
4. the confirmed digests go back to the texts: if there are few enough of them
   (``broadcast_bytes``, counted before), each task gets them all and no text moves;
   otherwise each document's digests are joined with them and only the documents that lose
   lines meet their list in a join on the id.

Digests are 128 bits of BLAKE2b, so that equal digests mean equal keys.

Nulls and odd inputs: a null or empty text is one empty line. Rows with equal ids count as
one document for the threshold, and each is filtered as such. A null id is a document that
is smaller than all others. Further columns are carried along; those named ``n_lines`` or
``n_dropped`` are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ASCII_SPACE, ASCII_UPPER, Workspace, col, fresh, map_batches, small_batches, tidy

LOWER = str.maketrans(ASCII_UPPER, ASCII_UPPER.lower())


def line_key(line: str) -> str:
    line = line.strip(ASCII_SPACE)
    return line.lower() if line.isascii() else line.translate(LOWER)


def line_digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _digests(text: str | None, min_chars: int) -> list[bytes]:
    keys = {line_key(x) for x in text.split("\n") if len(x) >= min_chars} if text else ()
    return [line_digest(k) for k in keys if len(k) >= min_chars]


def _heads(digests: list[bytes]) -> list[int]:
    return np.frombuffer(b"".join(digests), "<i8")[::2].tolist() if digests else []


def confirmed_lines(docs: DataFrame, ws: Workspace, text: str, doc_id: str, min_chars: int, min_docs: int, bits_per_line: float, filter_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Per document its suspects (id, digest), and the digests to drop with the id that keeps them."""

    def keyed(batches):
        for b in (w.slice(s, 512) for w in batches for s in range(0, w.num_rows, 512)):
            found = [_digests(t, min_chars) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_heads(d) for d in found], pa.list_(pa.int64())), pa.array(found, pa.list_(pa.binary()))], ["id", "heads", "digests"])
        tidy()

    source = docs.select(col(docs, doc_id).alias("id"), col(docs, text).alias("text"))
    lines = ws.cut(source.mapInArrow(keyed, f"id {source.schema['id'].dataType.simpleString()}, heads array<long>, digests array<binary>").where(F.size("digests") > 0), "lines")
    n = lines.agg(F.sum(F.size("digests").cast("long"))).first()[0] or 0
    each = lines.select("id", F.explode(F.arrays_zip("heads", "digests")).alias("x")).select("id", F.col("x.heads").alias("head"), F.col("x.digests").alias("digest"))
    if bloom.bytes_for(n, bits_per_line) <= filter_bytes:
        blocks = bloom.blocks_for(n, bits_per_line, filter_bytes)
        twice = bloom.probe_udf(bloom.build_twice(lines.select("heads"), blocks, bloom.builders_for(n, blocks)), docs.sparkSession)
        found = each.where(twice("head"))
    else:
        again = ws.cut(bloom.seen_twice(lines.select("heads"), n, bits_per_line, filter_bytes), "twice")
        k = again.count()
        if bloom.bytes_for(k, bits_per_line) <= filter_bytes:
            twice = bloom.probe_udf(bloom.build(again, bloom.blocks_for(k, bits_per_line, filter_bytes)), docs.sparkSession)
            found = each.where(twice("head"))
        else:
            found = each.join(again.withColumnRenamed("h", "head"), "head", "left_semi")
    suspects = ws.cut(found.select("id", "digest"), "suspects")
    ws.drop("lines", "twice")
    per_doc = suspects.groupBy("digest", "id").agg(F.lit(1).alias("one"))
    drop = per_doc.groupBy("digest").agg(F.count("one").alias("n_docs"), F.max("id").alias("keep")).where(F.col("n_docs") >= min_docs)
    return suspects, ws.cut(drop.select("digest", "keep"), "drop")


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, min_chars: int = 40, min_docs: int = 5, bits_per_line: float = 10.0, filter_bytes: int = 256 << 20, broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """``docs`` with ``text`` filtered, plus ``n_lines`` (before) and ``n_dropped``.

    ``filter_bytes`` bounds each Bloom filter; beyond it the hash space is cut into parts.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "line-dedup")
    suspects, drop = confirmed_lines(docs, ws, text, doc_id, min_chars, min_docs, bits_per_line, filter_bytes)
    id_type = docs.schema[doc_id].dataType.simpleString()
    own = fresh(docs, "own")
    n_drop = drop.count()
    # what a task holds of a digest: 16 bytes and an id, as Python objects
    if n_drop * 200 <= broadcast_bytes:
        sent = spark.sparkContext.broadcast({bytes(r["digest"]): r["keep"] for r in drop.toLocalIterator()})
        base, lists = docs, None
    else:
        sent = None
        lists = suspects.distinct().join(drop, "digest").where(~F.col("id").eqNullSafe(F.col("keep"))).groupBy("id").agg(F.collect_list("digest").alias(own)).withColumnRenamed("id", fresh(docs, "id"))
        base = docs.join(lists, col(docs, doc_id).eqNullSafe(lists[lists.columns[0]]), "left").drop(lists.columns[0])

    names = docs.columns

    def filtered(batches):
        table = sent.value if sent is not None else None
        for b in (w.slice(s, 512) for w in batches for s in range(0, w.num_rows, 512)):
            texts, ids = b.column(names.index(text)).to_pylist(), b.column(names.index(doc_id)).to_pylist()
            mine = b.column(b.num_columns - 1).to_pylist() if table is None else [None] * len(texts)
            out, total, lost = [], [], []
            for t, i, own_digests in zip(texts, ids, mine, strict=True):
                lines = (t or "").split("\n")
                if table is not None:
                    gone = {d for d in _digests(t, min_chars) if d in table and table[d] != i} if table else ()
                else:
                    gone = set(own_digests or ())
                if gone:
                    rest = [x for x in lines if len(x) < min_chars or len(k := line_key(x)) < min_chars or line_digest(k) not in gone]
                    out.append("\n".join(rest))
                    lost.append(len(lines) - len(rest))
                else:
                    out.append(t or "")
                    lost.append(0)
                total.append(len(lines))
            columns = [pa.array(out, pa.string()) if c == text else b.column(k) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], [*names, "n_lines", "n_dropped"])
        tidy()

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return map_batches(base, filtered, schema)
