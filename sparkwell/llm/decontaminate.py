"""Benchmark decontamination: latent semantic retrieval, then subsequence and answer checks.

Which documents hold benchmark items, word for word or reworded? Method:

1. one pass over the texts keeps, of each document, the words that occur in any item, with
   their places; what follows reads that narrow table only. Document frequencies over the whole
   corpus give the inverse document frequencies, none of them below ``FLOOR``, so that an item
   held by most of the documents keeps its weight too;
2. a latent space holds TF-IDF passages of the benchmark (an item, or 48-word pieces of a long
   one) and of the corpus (64 words each), both by a distributed randomised SVD over words that
   items hold. Of the benchmark's passages it has every dimension: those known by a few rare
   words would be cut off first, and a copy of one must not be missed. Of the corpus's passages
   it has the ``topics`` leading ones beside those; a window that is mostly about them is less
   like an item. Only square matrices and one row for each word reach the driver. More than
   ``dims`` benchmark passages get several spaces, one after the other;
3. every window of 64 words of every document (one each 32 words) is folded into the space and
   compared with every passage; a pair goes on if its cosine and the share of the passage that
   the window covers are high enough, or if the window covers about half of the passage, however
   much of other items or topics stands beside it. One of the windows over a word-for-word copy
   covers half;
4. the item and the surroundings of the window are compared by their longest common
   subsequence of words. An item counts as found if the subsequence covers ``full`` of it and
   the words shared carry half of its weight, or if it covers ``partial`` of it, the words
   shared carry 60 % of its weight and the answer (the item's last fifth, or the words of an
   ``answer`` column) is there too;
5. items of fewer than ``min_words`` words are too short to be reworded and are found where they
   stand word for word, by hashed runs of words and a comparison.

What is sent to the tasks grows with the benchmark, not the corpus: the benchmark is taken in
parts of at most ``items_per_pass`` items, one pass over the texts each, and of at most ``dims``
passages, one pass over the narrow table each, so that it has a bound.

Nulls and odd inputs: a null or empty text holds nothing. Items without a word (or null ones)
are never found; shorter ones than ``min_words`` are found verbatim. Rows with equal ids are reported
once. Null ids are reported as null. An empty benchmark or corpus gives no rows. Other columns
aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import drop_ids
from .common import U64, Workspace, col, mix64, small_batches, tidy

TABLE = bytes(32 if chr(i) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\x0c\r'" else i for i in range(256))
STEP, SPAN = 32, 2
PIECE = 48
#: Words of a corpus passage.
PASSAGE = 64
#: Words of a block of partial sums.
BLOCK = 1024
#: Least weight of a word, however many documents hold it.
FLOOR = 0.1
#: Share of a passage at which the cosine isn't asked. Two neighbouring windows miss different words of a copy, so one has half.
HALF = 0.49
FOUND = "doc_id long, item_id long, lcs double, cosine double, answer double, at long"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates."""
    return text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


# --- distributed randomised SVD -----------------------------------------------------------


def _omega(m: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((m, width)).astype(np.float32)


def _rows_times(rows: DataFrame, right) -> DataFrame:
    """(row, y): each sparse row (row, terms, weights) times a matrix that ``right`` makes in the task."""

    def run(batches):
        m = right()
        for b in batches:
            y = [np.asarray(w, np.float32) @ m[t] if len(t) else np.zeros(m.shape[1], np.float32) for t, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.astype(np.float32).tobytes() for v in y], pa.binary())], ["row", "y"])

    return rows.mapInArrow(run, "row long, y binary")


def _gram(y: DataFrame, width: int) -> np.ndarray:
    """Y'Y: a partial sum of width * width numbers a task."""

    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                m = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(b.num_rows, width).astype(np.float64)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    return sum((np.frombuffer(bytes(r["g"]), np.float64).reshape(width, width) for r in y.select("y").mapInArrow(run, "g binary").toLocalIterator()), np.zeros((width, width)))


def _inverse_root(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(E, s): Y E has orthonormal columns, s their singular values in Y; null directions are dropped."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    order = order[values[order] > max(values.max(), 0) * 1e-9]
    return vectors[:, order] / np.sqrt(values[order]), np.sqrt(values[order])


def _terms_times(joined: DataFrame, root, m: int, width: int) -> np.ndarray:
    """A'Q from rows (terms, weights, y), Q being Y times the broadcast ``root``: partial sums a task, added up a block of terms at a time."""

    def run(batches):
        total = np.zeros((m, width), np.float32)
        for b in batches:
            for t, w, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                total[t] += np.asarray(w, np.float32)[:, None] * (np.frombuffer(y, np.float32) @ root.value)[None, :]
        yield from _blocks(total)

    return _summed(joined.mapInArrow(run, "block int, z binary"), m, width)


def _blocks(total: np.ndarray):
    for s in range(0, len(total), BLOCK):
        part = total[s : s + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([s // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "z"])


def _summed(parts: DataFrame, m: int, width: int) -> np.ndarray:
    """The tasks' partial sums (block, z), added up block by block."""

    def add(table: pa.Table) -> pa.Table:
        z = sum((np.frombuffer(x.as_py(), np.float32) for x in table["z"][1:]), np.frombuffer(table["z"][0].as_py(), np.float32).copy())
        return pa.table({"block": table["block"][:1], "z": pa.array([z.tobytes()], pa.binary())})

    out = np.zeros((m, width), np.float32)
    for r in parts.groupBy("block").applyInArrow(add, "block int, z binary").toLocalIterator():
        part = np.frombuffer(bytes(r["z"]), np.float32).reshape(-1, width)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return out


def randomized_svd(rows: DataFrame, m: int, k: int, ws: Workspace, oversample: int = 8, powers: int = 1, seed: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """(V, s): the leading right singular vectors (m, <= k) and values of sparse rows (row, terms, weights).

    Range finder Y = A Omega, orthonormalised through Y'Y; each power takes Z = A'Q and
    Y = A Z; the last Z = A'Q gives V and s through Z'Z.
    """
    spark, width = rows.sparkSession, k + oversample
    y = ws.cut(_rows_times(rows, lambda: _omega(m, width, seed)), "svd-y0")
    z = np.zeros((m, width), np.float32)
    for p in range(powers + 1):
        root, s = _inverse_root(_gram(y, width))
        if not len(s):
            return np.zeros((m, 0), np.float32), np.zeros(0)
        sent = spark.sparkContext.broadcast(root.astype(np.float32))
        n = root.shape[1]
        z = _terms_times(rows.join(y, "row").select("terms", "weights", "y"), sent, m, n)
        if p < powers:
            held = spark.sparkContext.broadcast(z)
            width = n
            y = ws.cut(_rows_times(rows, lambda held=held: held.value), f"svd-y{p + 1}")
    root, s = _inverse_root(z.T.astype(np.float64) @ z)
    return (z @ root[:, :k]).astype(np.float32), s[:k]


def narrow_rows(b: pa.RecordBatch, wide: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word id, place) of all words of rows whose last two columns are ids and gaps."""
    raw = [x or b"" for x in b.column(b.num_columns - 2).to_pylist()]
    gaps = np.frombuffer(b"".join(x or b"" for x in b.column(b.num_columns - 1).to_pylist()), "<u2").astype(np.int64)
    ids = np.frombuffer(b"".join(raw), wide).astype(np.int64)
    sizes = np.array([len(x) for x in raw], np.int64) // np.dtype(wide).itemsize
    row = np.repeat(np.arange(len(raw)), sizes)
    so_far = np.cumsum(gaps)
    before = np.concatenate([[0], so_far])[np.cumsum(sizes) - sizes]
    return row, ids, so_far - before[row]


def corpus_topics(corpus: DataFrame, wide: str, idf: np.ndarray, k: int, oversample: int = 8, passes: int = 2, seed: int = 37) -> np.ndarray:
    """The ``k`` leading right singular vectors (words, <= k) of the TF-IDF matrix A of all passages of the narrow table.

    Randomised subspace iteration: each pass multiplies an orthonormal block by A'A, a job in
    which no passage leaves its task and each task passes on one row for each word it has.
    """
    spark, m = corpus.sparkSession, len(idf)
    width = min(k + oversample, m)
    v = np.linalg.qr(_omega(m, width, seed).astype(np.float64))[0]
    for _ in range(passes):
        sent = spark.sparkContext.broadcast((v * idf[:, None]).astype(np.float32))

        def run(batches, sent=sent):
            w, total = sent.value, np.zeros((m, width), np.float32)
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    row, ids, places = narrow_rows(whole.slice(at, 256), wide)
                    if not len(ids):
                        continue
                    new = (np.diff(row, prepend=-1) > 0) | (np.diff(places // PASSAGE, prepend=-1) != 0)
                    y = np.add.reduceat(w[ids], np.flatnonzero(new), axis=0)
                    order = np.argsort(ids, kind="stable")
                    sorted_ids = ids[order]
                    first = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
                    total[sorted_ids[first]] += np.add.reduceat(y[(np.cumsum(new) - 1)[order]], first, axis=0)
            yield from _blocks(total)
            tidy()

        z = _summed(corpus.select("ids", "gaps").mapInArrow(run, "block int, z binary"), m, width).astype(np.float64) * idf[:, None]
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        v = u[:, s > max(s.max(initial=0), 0) * 1e-9]
        width = v.shape[1]
        if not width:
            break
    return v[:, :k]


# --- longest common subsequence -----------------------------------------------------------


def lcs_masks(item: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, t in enumerate(item):
        masks[t] = masks.get(t, 0) | 1 << i
    return masks


def lcs_length(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Bit-parallel: one addition a word of ``other``, whatever the item's length."""
    full = (1 << n) - 1
    v = full
    for t in other:
        if u := v & masks.get(t, 0):
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


# --- the search ---------------------------------------------------------------------------


class Space:
    """What a task needs: passages (item, ids) in the latent space, their items, and the vectors of their words ``terms``."""

    def __init__(self, items: dict[int, tuple], pieces: list[tuple], terms: np.ndarray, idf: np.ndarray, basis: np.ndarray, topics: np.ndarray, cosine: float, cover: float, full: float, partial: float):
        self.idf, self.cosine, self.cover, self.full, self.partial = idf, cosine, cover, full, partial
        self.word = (basis * idf[terms][:, None]).astype(np.float32)
        self.place = np.full(len(idf), -1, np.int32)
        self.place[terms] = np.arange(len(terms))
        beside = np.array(topics, np.float64)
        beside[terms] -= basis @ (basis.T @ beside[terms])  # what of the topics the passages don't span
        u, s, _ = np.linalg.svd(beside, full_matrices=False) if beside.size else (beside, np.zeros(0), None)
        #: the words' vectors in the dimensions of the corpus's topics
        self.topic = (u[:, s > 1e-3] * idf[:, None]).astype(np.float32)
        self.items = {i: (name, ids, lcs_masks(ids), float(idf[ids].sum()), answer) for i, (name, ids, answer) in items.items()}
        self.owner = np.array([i for i, _ in pieces], np.int64)
        p = np.array([self.word[self.place[ids]].sum(0) for _, ids in pieces], np.float32).reshape(len(pieces), -1)
        self.lengths = np.sqrt((p**2).sum(1))
        self.unit = (p / np.maximum(self.lengths, 1e-9)[:, None]).T.copy()

    def search(self, docs: list[tuple]) -> list[tuple]:
        """(doc_id, item_id, lcs, cosine, answer, word place) of (doc_id, ids, places)."""
        base, own, block, ids_all = 0, [], [], []
        for _name, ids, places in docs:
            block.append(places // STEP + base)
            ids_all.append(ids)
            own.append(base)
            base += (int(places[-1]) // STEP + 1 if len(places) else 0) + SPAN
        if not base:
            return []
        flat, at = np.concatenate(ids_all), np.concatenate(block)
        rows = self.place[flat]
        keep = rows >= 0
        windows = self._windows(self.word, rows[keep], at[keep], base)
        norms = np.sqrt((windows**2).sum(1))
        lengths = np.sqrt(norms**2 + (self._windows(self.topic, flat, at, base) ** 2).sum(1)) if self.topic.shape[1] else norms
        hot = np.flatnonzero(norms >= self.cover * self.lengths.min()) if len(self.lengths) else []
        owns, found = np.array(own), {}
        for s in range(0, len(hot), 4096):
            w = hot[s : s + 4096]
            dot = windows[w] @ self.unit
            good = (dot >= self.cover * self.lengths) & ((dot >= self.cosine * lengths[w][:, None]) | (dot >= HALF * self.lengths))
            for a, b in zip(*np.nonzero(good), strict=True):
                d = int(np.searchsorted(owns, w[a], "right")) - 1
                key = (d, int(self.owner[b]))
                found.setdefault(key, []).append((int(w[a]) - own[d], float(dot[a, b] / lengths[w[a]])))
        out = []
        for (d, i), places in found.items():
            if best := self.verify(docs[d], i, places):
                out.append((docs[d][0], *best))
        return out

    @staticmethod
    def _windows(vectors: np.ndarray, flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Sums of the words' vectors over the ``SPAN`` blocks from each block on."""
        sums = np.zeros((n + SPAN, vectors.shape[1]), np.float32)
        if len(flat):
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            for s in range(0, len(starts), 512):
                e = int(starts[s + 512]) if s + 512 < len(starts) else len(flat)
                first = int(starts[s])
                sums[at[starts[s : s + 512]]] = np.add.reduceat(vectors[flat[first:e]], starts[s : s + 512] - first, axis=0)
        return sum(sums[d : len(sums) - SPAN + d] for d in range(SPAN))

    def verify(self, doc: tuple, i: int, windows: list[tuple[int, float]]) -> tuple | None:
        _doc, ids, places = doc
        name, item, masks, weight, answer = self.items[i]
        n, best = len(item), None
        around = max(0, n - PIECE) + STEP
        for block, cosine in windows:
            low, high = block * STEP - around, (block + SPAN) * STEP + around
            a, b = np.searchsorted(places, (low, high))
            region = ids[a:b].tolist()
            share = lcs_length(masks, n, region) / n
            if share < self.partial:
                continue
            here = set(region)
            got = lcs_length(lcs_masks(answer), len(answer), region) / len(answer) if answer else 1.0
            shared = sum(float(self.idf[t]) for t in item if t in here) / weight if weight > 0 else 1.0
            if (share >= self.full and shared >= 0.5) or (got >= 0.8 and shared >= 0.6):
                row = (name, share, cosine, got, max(low + around, 0))
                best = max(best, row, key=lambda r: r[1:3]) if best else row
        return best


def _items(benchmark: DataFrame, item_id: str, text: str, answer: str | None) -> DataFrame:
    chosen = [col(benchmark, item_id).cast("long").alias("item_id"), col(benchmark, text).alias("text"), (col(benchmark, answer) if answer else F.lit(None)).cast("string").alias("answer")]

    def run(batches):
        for b in batches:
            words = [words_of(t) for t in b.column(1).to_pylist()]
            answers = [words_of(a) or w[-max(3, len(w) // 5) :] for a, w in zip(b.column(2).to_pylist(), words, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.binary())), pa.array(answers, pa.list_(pa.binary()))], ["item_id", "words", "answer"])

    return benchmark.select(*chosen).mapInArrow(run, "item_id long, words array<binary>, answer array<binary>").where(F.size("words") > 0)


def find_items(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", answer: str | None = None, *,
    dims: int = 256, topics: int = 32, cosine: float = 0.35, cover: float = 0.3, full: float = 0.65, partial: float = 0.5, min_words: int = 8, items_per_pass: int = 4000,
) -> DataFrame:
    """One row for each document and benchmark item found in it: (doc_id, item_id, lcs, cosine, answer, at)."""
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "decontaminate")
    small_batches(spark)
    items = ws.cut(_items(benchmark, item_id, item_text, answer), "items")
    parts = -(-items.count() // items_per_pass)
    out = spark.createDataFrame([], FOUND)
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == p) if parts > 1 else items
        found = _find_part(docs.select(col(docs, doc_id).cast("long").alias("doc_id"), col(docs, text).alias("text")), own, Workspace(spark, f"decontaminate-{p}"), dims, topics, min_words, (cosine, cover, full, partial))
        out = found if parts == 1 else out.union(found)
    best = F.max(F.struct("lcs", "cosine", "answer", "at")).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.lcs", "x.cosine", "x.answer", "x.at")


def _find_part(docs: DataFrame, items: DataFrame, ws: Workspace, dims: int, topics: int, min_words: int, limits: tuple) -> DataFrame:
    spark = docs.sparkSession
    rows = sorted((r["item_id"] if r["item_id"] is not None else -1, [bytes(w) for w in r["words"]], [bytes(w) for w in r["answer"]], r["item_id"]) for r in items.collect())  # items_per_pass at most
    if not rows:
        return spark.createDataFrame([], FOUND)
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words, answer, _ in rows for w in (*words, *answer)}))}
    m = len(vocabulary)
    wide = "<u2" if m < 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast(vocabulary)

    def narrow(batches):
        get = sent.value.get
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids, gaps = [], []
                for t in b.column(1).to_pylist():
                    words = words_of(t)
                    x = np.fromiter((get(w, -1) for w in words), np.int64, len(words)) if words else np.zeros(0, np.int64)
                    places = np.flatnonzero(x >= 0)
                    ids.append(x[places].astype(wide).tobytes())
                    gaps.append(np.minimum(np.diff(places, prepend=0), 65_535).astype("<u2").tobytes())  # a longer gap is as good as this one
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(gaps, pa.binary())], ["doc_id", "ids", "gaps"])
        tidy()

    corpus = ws.cut(docs.mapInArrow(narrow, "doc_id long, ids binary, gaps binary"), "corpus", "zstd")

    def frequencies(batches):
        total, n = np.zeros(m, np.int64), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                total[np.unique(np.frombuffer(x, wide))] += 1
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "df"])

    n_docs, df = 0, np.zeros(m, np.int64)
    for r in corpus.select("ids").mapInArrow(frequencies, "n long, df binary").toLocalIterator():  # one number a word and task
        n_docs += r["n"]
        df += np.frombuffer(bytes(r["df"]), np.int64)
    idf = np.maximum(np.log((1 + n_docs) / (1 + df)), FLOOR)

    known = [(name, [vocabulary[w] for w in words], [vocabulary[w] for w in answer]) for _, words, answer, name in rows]
    pieces = [(i, x[s : s + PIECE]) for i, (_n, x, _a) in enumerate(known) if len(x) >= min_words for s in range(0, max(len(x) - PIECE // 4, 1), PIECE)]
    short = [(name, x) for name, x, _a in known if len(x) < min_words]
    found = _search_short(corpus, wide, short, ws) if short else None
    leading = corpus_topics(corpus, wide, idf, topics) if pieces and topics else np.zeros((m, 0))
    for g in range(0, len(pieces), dims):
        part = _search(corpus, wide, known, pieces[g : g + dims], idf, leading, limits, ws, g // dims)
        found = part if found is None else found.union(part)
    ws.drop("corpus")
    return found


def _search_short(corpus: DataFrame, wide: str, short: list[tuple], ws: Workspace) -> DataFrame:
    """Where the short items stand word for word: runs of neighbouring words with an item's hash, compared."""
    names: dict[tuple[int, ...], list] = {}
    for name, x in short:
        names.setdefault(tuple(x), []).append(name)
    factor = U64(0x9E3779B97F4A7C15)

    def fold(ids: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(max(len(ids) - n + 1, 0), U64)
        for k in range(n):
            h = mix64(h * factor + ids[k : k + len(h)].astype(U64) + U64(1))
        return h

    keys = {n: np.array([fold(np.array(x), n)[0] for x in names if len(x) == n], U64) for n in {len(x) for x in names}}
    sent = corpus.sparkSession.sparkContext.broadcast((names, keys))

    def search(batches):
        names, keys = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                row, ids, places = narrow_rows(b, wide)
                ends = np.flatnonzero((np.diff(places, append=-1) != 1) | (np.diff(row, append=-1) != 0))  # last words of runs
                left = ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids)) + 1  # words from here to the end of the run
                hits: dict[tuple, int] = {}
                for n, known in keys.items():
                    for i in np.flatnonzero(np.isin(fold(ids, n), known) & (left[: max(len(ids) - n + 1, 0)] >= n)).tolist():
                        for name in names.get(tuple(ids[i : i + n].tolist()), ()):
                            hits.setdefault((int(row[i]), name), int(places[i]))
                own = b.column(0).to_pylist()
                columns = [[own[r] for r, _ in hits], [name for _, name in hits], *[[1.0] * len(hits)] * 3, list(hits.values())]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "lcs", "cosine", "answer", "at"])
        tidy()

    return ws.cut(corpus.mapInArrow(search, FOUND), "found-short")


def _search(corpus: DataFrame, wide: str, known: list[tuple], pieces: list[tuple], idf: np.ndarray, topics: np.ndarray, limits: tuple, ws: Workspace, group: int) -> DataFrame:
    """What the narrow table holds of these passages' items, by way of the passages' own space."""
    spark = corpus.sparkSession
    terms = np.unique(np.concatenate([np.array(x) for _, x in pieces]))
    matrix = []
    for i, (_, x) in enumerate(pieces):
        used, counts = np.unique(np.array(x), return_counts=True)
        weights = counts * idf[used]
        # rows of length 1, so that a short passage has as much of the space as a long one
        matrix.append((i, np.searchsorted(terms, used).tolist(), (weights / max(float(np.sqrt((weights**2).sum())), 1e-9)).astype(float).tolist()))
    a = spark.createDataFrame(matrix, "row long, terms array<int>, weights array<double>")
    own = Workspace(spark, f"decontaminate-space-{group}")
    basis, _ = randomized_svd(a, len(terms), len(matrix), own)
    own.drop()
    space = spark.sparkContext.broadcast(Space({i: known[i] for i, _ in pieces}, pieces, terms, idf, basis, topics, *limits))

    def search(batches):
        s = space.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                read = []
                for name, ids, gaps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if ids:
                        read.append((name, np.frombuffer(ids, wide).astype(np.int64), np.cumsum(np.frombuffer(gaps, "<u2").astype(np.int64))))
                found = s.search(read) if read else []
                columns = list(zip(*found, strict=True)) if found else [[]] * 6
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "lcs", "cosine", "answer", "at"])
        tidy()

    return ws.cut(corpus.mapInArrow(search, FOUND), f"found-{group}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item. Rows with a null id stay."""
    found = find_items(docs, benchmark, text, doc_id, **options).where("doc_id IS NOT NULL").select("doc_id").distinct()
    return drop_ids(docs, doc_id, found)
