"""Near-duplicate documents: MinHash signatures, banding, exact verification, components.

A document's set holds its distinct word shingles; documents whose sets overlap by
``100 * |a & b| >= percent * |a | b|`` are linked, and groups are what links connect. Method:

1. one pass over the texts writes, per document, the set's size, a 128-bit digest of the set
   and ``bands * rows`` minima of universal hashes ((a x + b) mod 2^64, upper half). Documents
   with equal sets are one class from here on, represented by the smallest id;
2. bands of ``rows`` minima are hashed to buckets; buckets of one class are dropped;
3. each member of a bucket is paired with the bucket's smallest member only, so a bucket of
   n costs n pairs. Pairs go through signature verification (the estimate must not be far
   below the threshold) and then exact verification on the full sets, which are computed
   again for the classes that need them;
4. components of these links by alternating large-star and small-star. Buckets that now hold
   several components still have unverified pairs: those of a member outside the bucket's
   largest component and a member of another one. Where at most ``few`` members are outside,
   these pairs are written out, no more than ``few`` a member. The members of all other such
   buckets go through an exact prefix filter: with the tokens of each set in one order, rarest
   first, two sets that overlap enough share a token among the first 25 % (of the larger) and
   14 % (of the smaller, at 75 %) of theirs, so only members of different components that meet
   in such a token are candidates. Tokens that one component alone has are left out before the
   join. So a bucket of n documents that are alike but not alike enough doesn't cost n * n
   pairs, and a bucket of a third of all documents that are one group costs none here.

With 32 bands of 4 a pair at 75 % misses all buckets with probability 5e-6. The signature
check leaves a pair out only if the estimate is ``slack`` below the threshold (about seven
standard deviations).

Nulls and odd inputs: a null, empty or blank text has an empty set and is linked with
nothing; a text of one word has one shingle, the word. Rows with equal ids are one document,
whose set is that of the row with the smallest digest; null ids form no links, and each row
is its own group, kept, with a null component (``near_duplicate_rows`` returns these rows,
``near_duplicates`` has ids only). Both return ids and results, whatever other columns there
are; ``dedup_near`` returns the documents that stay with all their columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import U64, Workspace, col, mix64, small_batches, tidy
from .components import connected_components

#: Ids that are sent to all tasks: 8 bytes each.
SENT_IDS = 200_000
#: Counters of the tokens' frequencies by which prefixes are ordered; any order is exact, rarest first is fast.
COUNTERS = 1 << 18


def shingle_set(text: bytes | None, words: int = 2) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text."""
    from xxhash import xxh3_64_intdigest

    parts = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not parts:
        return np.zeros(0, U64)
    h = np.fromiter(map(xxh3_64_intdigest, parts), U64, len(parts))
    if len(h) < words:
        return mix64(np.array([_fold(h, len(h))[0] ^ U64(len(h))], U64))
    return np.unique(mix64(_fold(h, words) ^ U64(words)))


def _fold(h: np.ndarray, words: int) -> np.ndarray:
    n = len(h) - words + 1
    out = np.zeros(n, U64)
    for k in range(words):
        out = (out << U64(23) | out >> U64(41)) * U64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out


def hash_family(n: int, seed: int = 20_011) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 1 << 63, n, dtype=U64)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Minima of ``n`` universal hashes of each set, none of them empty; many sets at a time."""
    a, b = hash_family(n)
    out = np.empty((len(sets), n), np.uint32)
    sizes = np.array([len(s) for s in sets])
    groups = np.cumsum(sizes) // 60_000  # what stays in the processor's cache
    for g in np.unique(groups):
        own = np.flatnonzero(groups == g)
        flat = np.concatenate([sets[i] for i in own])
        starts = np.concatenate([[0], np.cumsum(sizes[own])[:-1]])
        h = np.empty_like(flat)
        for k in range(n):
            np.multiply(flat, a[k], out=h)
            np.add(h, b[k], out=h)
            out[own, k] = np.minimum.reduceat(h, starts) >> U64(32)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = sig.shape[1] // bands
    keys = np.tile(np.arange(bands, dtype=U64), (len(sig), 1))
    for r in range(rows):
        keys = mix64(keys * U64(0x9E3779B97F4A7C15) + sig[:, r::rows][:, :bands].astype(U64))
    return keys.view(np.int64)


def _sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        from xxhash import xxh3_128_digest

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = [shingle_set(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, bands * rows)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["id", "n", "digest", "sig"],
                )
        tidy()

    return docs.mapInArrow(run, "id long, n long, digest binary, sig binary")


def _bands(classes: DataFrame, bands: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), bands), pa.int64()), pa.array(band_keys(sig, bands).ravel(), pa.int64())], ["id", "key"])

    return classes.select("id", "sig").mapInArrow(run, "id long, key long")


def _likely(least: float):
    @F.arrow_udf("boolean")
    def likely(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint32).reshape(len(s), -1) for s in (a, b))
        return pa.array((x == y).mean(axis=1) >= least, pa.bool_()) if len(a) else pa.array([], pa.bool_())

    return likely


def _overlaps(a: Column, b: Column, percent: int) -> Column:
    """On the full sets; arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b)).cast("long")
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


class Verifier:
    """Which pairs of class ids (u, v) really overlap."""

    def __init__(self, source: DataFrame, classes: DataFrame, ws: Workspace, words: int, percent: int, slack: float, filter_bytes: int):
        self.source, self.classes, self.ws, self.words, self.percent, self.filter_bytes = source, classes, ws, words, percent, filter_bytes
        self.likely = _likely(percent / 100 - slack)

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """The full sets of the classes in ``ids``. Few ids (counted) are sent to the texts; of many, a Bloom filter spares the other texts the exchange."""
        words, spark = self.words, ids.sparkSession
        n = ids.count()
        if n <= SENT_IDS:
            few = self.source.join(F.broadcast(ids), "id", "left_semi")
        else:
            wanted = bloom.probe_udf(bloom.build(ids.select(F.xxhash64("id").alias("h")), bloom.blocks_for(n, 12, self.filter_bytes)), spark)
            few = self.source.where(wanted(F.xxhash64("id"))).join(ids.hint("merge"), "id", "left_semi")  # an exchange, so that no task needs two Python workers

        def run(batches):
            from xxhash import xxh3_128_digest

            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    sets = [shingle_set(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "digest", "set"])
            tidy()

        # equal ids with different texts: the class holds the row whose digest it has
        return self.ws.cut(few.mapInArrow(run, "id long, digest binary, set array<long>").groupBy("id").agg(F.min_by("set", "digest").alias("set")), name)

    def __call__(self, pairs: DataFrame, name: str) -> DataFrame:
        sig = self.classes.select("id", "sig", "n")
        left, right = (sig.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}")) for x in "uv")
        near = pairs.join(left, "u").join(right, "v").where(100 * F.least("n_u", "n_v") >= self.percent * F.greatest("n_u", "n_v")).where(self.likely("sig_u", "sig_v")).select("u", "v")
        near = self.ws.cut(near, f"{name}-near")
        sets = self.sets(near.select(F.explode(F.array("u", "v")).alias("id")).distinct(), f"{name}-sets")
        left, right = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "uv")
        links = self.ws.cut(near.join(left, "u").join(right, "v").where(_overlaps(F.col("set_u"), F.col("set_v"), self.percent)).select("u", "v"), name)
        self.ws.drop(f"{name}-near", f"{name}-sets")
        return links


def prefix_lengths(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(as the smaller, as the larger of two): how many first tokens of a set of ``n`` must hold one of the other's, if they overlap enough."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def _prefix_pairs(members: DataFrame, verify: Verifier, ws: Workspace) -> DataFrame:
    """Pairs (u, v) of ``members`` (id, component, minor) of different components, one of them minor, whose prefixes meet."""
    percent = verify.percent
    held = verify.sets(members.select("id"), "prefix-sets")
    n_of = held.select(F.explode("set").alias("h")).groupBy(F.pmod("h", F.lit(COUNTERS)).alias("at")).agg(F.count("h").alias("n")).toArrow()  # COUNTERS rows at most
    counts = np.zeros(COUNTERS, np.int64)
    counts[n_of["at"].to_numpy()] = n_of["n"].to_numpy()
    sent = members.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = [x.values.to_numpy(zero_copy_only=False) for x in b.column(3)]
                n = np.array([len(s) for s in sets], np.int64)
                short, long_ = prefix_lengths(n, percent)
                tokens = [s[np.lexsort((s, sent.value[s % COUNTERS]))[:k]] for s, k in zip(sets, long_, strict=True)]
                of = np.repeat(np.arange(len(sets)), long_)
                place = np.arange(len(of)) - np.repeat(np.cumsum(long_) - long_, long_)
                rows = pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)), pa.array(n[of]), pa.array(place < short[of])], ["token", "n", "short"])
                own = b.select([0, 1, 2]).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*own.columns, *rows.columns], ["id", "component", "minor", "token", "n", "short"])

    rows = members.join(held, "id").select("id", "component", "minor", "set").mapInArrow(run, "id long, component long, minor boolean, token long, n long, short boolean")
    rows = ws.cut(rows, "prefixes")
    ws.drop("prefix-sets")
    shared = rows.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.bool_or("minor").alias("m")).where("a <> b AND m").select("token")
    shared = ws.cut(rows.join(shared, "token", "left_semi"), "shared-prefixes")
    ws.drop("prefixes")
    a, b = (shared.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "minor", "n", "short"))) for x in "uv")
    met = a.where("short_u").join(b, "token").where("component_u <> component_v AND (minor_u OR minor_v)").where((F.col("n_u") <= F.col("n_v")) & (100 * F.col("n_u") >= percent * F.col("n_v")))
    return met.select(F.least("id_u", "id_v").alias("u"), F.greatest("id_u", "id_v").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, words: int = 2, percent: int = 75, bands: int = 32, rows: int = 4, slack: float = 0.27, filter_bytes: int = 64 << 20, few: int = 16
) -> DataFrame:
    """(id, n_shingles, component_id, kept) per document id: the classes and what they are linked with."""
    small_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "near-dedup")
    source = docs.select(col(docs, doc_id).cast("long").alias("id"), col(docs, text).alias("text")).where("id IS NOT NULL")
    sketch = ws.cut(_sketch(source, words, bands, rows), "sketch")
    # one row for each id
    first = F.min_by(F.struct("n", "sig"), "digest")
    single = sketch.groupBy("id").agg(F.min("digest").alias("digest"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.count("n").alias("k"))
    repeated = single.where("k > 1").select("id", "digest")
    if repeated.isEmpty():
        docs_once = sketch
    else:
        docs_once = ws.cut(sketch.groupBy("id", "digest").agg(first.alias("x")).join(repeated.union(single.where("k = 1").select("id", "digest")), ["id", "digest"], "left_semi").select("id", "x.n", "digest", "x.sig"), "once")
    same = docs_once.where("n > 0").groupBy("digest").agg(F.min("id").alias("class"))
    classes = ws.cut(docs_once.where("n > 0").join(same.select(F.col("class").alias("id")), "id", "left_semi").select("id", "n", "sig"), "classes")

    keyed = ws.cut(_bands(classes, bands), "bands")
    buckets = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("key", "least")
    members = ws.cut(keyed.join(buckets, "key"), "members")
    ws.drop("bands")
    verify = Verifier(source, classes, ws, words, percent, slack, filter_bytes)
    star = ws.cut(members.where("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v")).distinct(), "star-pairs")
    links = verify(star, "star")
    groups = ws.cut(connected_components(links, ws, "cc-star"), "groups")

    placed = ws.cut(members.select("key", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "placed")
    ws.drop("members")
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    inside = ws.cut(placed.join(mixed, "key"), "inside")
    ws.drop("placed")
    sizes = inside.groupBy("key", "component").agg(F.count("id").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("n_minor"))
    known = ws.cut(inside.join(largest, "key").select("key", "id", "component", (F.col("component") != F.col("main")).alias("minor"), (F.col("n_minor") > few).alias("many")), "known")
    ws.drop("inside")
    direct = known.where("NOT many").select("key", "id", "component", "minor")
    minor = direct.where("minor").select("key", F.col("id").alias("x"), F.col("component").alias("c"))
    crossed = minor.join(direct, "key").where("c <> component").select(F.least("x", "id").alias("u"), F.greatest("x", "id").alias("v"))
    many = ws.cut(known.where("many").groupBy("id").agg(F.first("component").alias("component"), F.bool_or("minor").alias("minor")), "many")
    if not many.isEmpty():
        crossed = crossed.union(_prefix_pairs(many, verify, ws))
    rest = verify(crossed.distinct().join(star.select("u", "v"), ["u", "v"], "left_anti"), "rest")
    ws.drop("known", "many", "shared-prefixes")
    if rest.isEmpty():
        final = groups
    else:
        final = ws.cut(connected_components(rest.union(groups.where("node <> component").select("node", "component")), ws, "cc-all"), "final")
    found = docs_once.select("id", "n", "digest").join(same, "digest", "left")
    found = found.join(final.withColumnRenamed("node", "class"), "class", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "class")).otherwise(F.col("id"))
    return found.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def near_duplicate_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, words: int = 2, **options) -> DataFrame:
    """``near_duplicates``, and a row for each document with a null id: its own group, kept, with a null component."""
    found = near_duplicates(docs, text, doc_id, words=words, **options)
    unnamed = docs.select(col(docs, doc_id).cast("long").alias("id"), col(docs, text).alias("text")).where("id IS NULL")
    alone = _sketch(unnamed, words, 1, 1).select("id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return found.union(alone)


def dedup_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that represent their group, one row of each id, with all their columns.

    A document with a null id belongs to no group and stays.
    """
    found = near_duplicates(docs, text, doc_id, **options)
    gone = Workspace(docs.sparkSession, "near-dedup-gone").cut(found.where(~F.col("kept")).select("id"), "ids")
    return bloom.drop_ids(docs, doc_id, gone)
