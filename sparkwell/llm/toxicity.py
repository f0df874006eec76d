"""Toxicity: a logistic classifier, regularised by counterfactual swaps of identity terms.

Features are the distinct words of the whole text (letter case and ASCII punctuation don't
count) and their prefixes of 4, 5 and 6 bytes, present or not. The model is fitted on a
bounded sample of labelled rows: features that go with toxicity are selected by chi-square
over the sample and have no negative weights, so that a text unlike the sample isn't toxic
for what it lacks. The loss adds to the weighted log-loss and an L2 term the squared change
of the score when the identity terms of a labelled text are swapped for others of their kind.
So a term that names a group carries no weight of its own, and a neutral mention isn't taken
for toxicity, however the sample's labels fell.

Scoring reads each whole text once, in one pass without a shuffle.

Nulls and odd inputs: a null or empty text has no features and gets the score of the bias
alone. Labels that are null, or whose document is missing, aren't learned from; without both
classes in the sample every score is the (smoothed) share of toxic labels. An id counts once:
of several label rows the toxic one holds, of several documents the least text is learned from,
so an id that a third of all rows have is one row of the sample. All rows are scored. Further
columns are carried along; columns named like the results are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, col, small_batches, tidy

#: Terms that name groups, by kind; a swap puts another term of the kind in a term's place.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("mother", "father"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "natives", "refugees", "foreigners"), ("americans", "mexicans", "germans", "chinese", "indians", "russians"), ("disabled", "blind", "deaf"), ("old", "young"),
)
KINDS = {t.encode(): tuple(o.encode() for o in kind if o != t) for kind in IDENTITY_TERMS for t in kind}
TABLE = bytes(32 if chr(i) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\x0c\r'" else i for i in range(256))
PREFIXES = (4, 5, 6)
HELD_OUT = 5
#: Features that a task counts before it passes the counts on.
COUNTED = 100_000


def words_of(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split()) if text else set()


def features_of(words: set[bytes]) -> set[bytes]:
    """Words, marked by a final space, and prefixes."""
    out = {w + b" " for w in words}
    for n in PREFIXES:
        out.update(w[:n] for w in words if len(w) > n)
    return out


@dataclass
class ToxicityModel:
    features: list[bytes]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.index = {f: i for i, f in enumerate(self.features)}
        #: what a word starts with if any of its features may be in the model
        self.heads = {f.rstrip(b" ")[:4] for f in self.features}

    def active(self, words: set[bytes]) -> list[int]:
        heads, index, found = self.heads, self.index, set()
        for w in words:
            if w[:4] in heads:
                found.update((w + b" ", *(w[:n] for n in PREFIXES if len(w) > n)))
        return sorted(i for f in found if (i := index.get(f)) is not None)

    def score(self, text: str | None) -> float:
        at = self.active(words_of(text))
        return float(1 / (1 + np.exp(-np.clip(self.weights[at].sum() + self.bias, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text is a multiple of five."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(HELD_OUT)) == 0


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, with, toxic): in how many sampled texts, and toxic ones, each feature is."""

    def rows(n: Counter, toxic: Counter):
        every = list(n)
        for s in range(0, len(every), 10_000):
            part = every[s : s + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([n[f] for f in part], pa.int64()), pa.array([toxic[f] for f in part], pa.int64())], ["feature", "n", "toxic"])

    def run(batches):
        n, toxic = Counter(), Counter()
        for b in batches:
            for t, y in zip((t for s in range(0, b.num_rows, 256) for t in b.column(0).slice(s, 256).to_pylist()), b.column(1).to_pylist(), strict=True):
                found = features_of(words_of(t))
                n.update(found)
                if y:
                    toxic.update(found)
                if len(n) > COUNTED:
                    yield from rows(n, toxic)
                    n.clear()
                    toxic.clear()
        yield from rows(n, toxic)
        n.clear()
        toxic.clear()
        tidy()

    return sample.select("text", "toxic").mapInArrow(run, "feature binary, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", *, max_rows: int = 12_000, max_features: int = 1024, min_docs: int = 3,
    swap_weight: float = 4.0, l2: float = 2e-4, rounds: int = 400, seed: int = 3,
) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled texts, none of them held out.

    The sample is the labelled ids of smallest hash, one row each, so its size is bounded whatever
    the corpus and however often an id occurs; it is the only thing that reaches the driver, as sets of at most ``max_features`` numbers.
    """
    small_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "toxicity")
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("id")))
    once = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = ws.cut(once.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_rows), "chosen")
    texts = docs.select(col(docs, doc_id).alias("id"), col(docs, text).alias("text"))
    named = texts.join(F.broadcast(chosen), "id")  # at most max_rows ids are sent
    sample = ws.cut(named.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "sample")  # a task passes on one row of each id
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("id").alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    prior = float(np.log((pos + 0.5) / (neg + 0.5)))
    if not pos or not neg:
        return ToxicityModel([], np.zeros(0), prior)
    a, n, p, m = F.col("toxic").cast("double"), F.col("n").cast("double"), float(pos), float(pos + neg)
    spread = n * (m - n) * p * (m - p)
    chi = F.when(spread > 0, m * (a * m - n * p) ** 2 / spread).otherwise(F.lit(0.0))
    best = _counts(sample).where((F.col("n") >= min_docs) & (a * m > n * p)).select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(max_features).collect()
    terms = [t + b" " for t in KINDS]
    features = sorted({bytes(r["feature"]) for r in best} | set(terms))
    model = ToxicityModel(features, np.zeros(len(features)), prior)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        m = sent.value
        for b in batches:
            plain, swapped = [], []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                plain.append(m.active(words))
                found = sorted(w for w in words if w in KINDS)
                others = {w: KINDS[w][len(words) % len(KINDS[w])] for w in found}
                swapped.append(m.active(words - set(found) | set(others.values())) if found else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(plain, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))], ["id", "toxic", "x", "swapped"])

    id_type = sample.schema["id"].dataType.simpleString()
    learned = sorted(sample.select("id", "text", "toxic").mapInArrow(rows, f"id {id_type}, toxic int, x array<int>, swapped array<int>").collect())
    x = np.zeros((len(learned), len(features)), np.float32)
    swapped, at = [], []
    for i, r in enumerate(learned):
        x[i, r["x"]] = 1
        if r["swapped"] is not None:
            row = np.zeros(len(features), np.float32)
            row[r["swapped"]] = 1
            swapped.append(row)
            at.append(i)
    y = np.array([r["toxic"] for r in learned], np.float32)
    weights, bias = _train(x, y, np.array(swapped, np.float32).reshape(-1, len(features)), np.array(at, np.int64), [features.index(t) for t in terms], prior, swap_weight, l2, rounds)
    ws.drop()
    return ToxicityModel(features, weights, bias)


def _train(x, y, swapped, at, terms, prior, swap_weight, l2, rounds):
    """Full-batch Adam on log-loss + l2 |w|^2 + swap_weight mean (s(x) - s(swapped))^2; all data are 0 and 1."""
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6) ** 0.5, 0.5 / max(1 - y.mean(), 1e-6) ** 0.5).astype(np.float32)
    weight /= weight.sum()
    w, b = np.zeros(x.shape[1], np.float32), np.float32(prior)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        s = sigmoid(x @ w + b)
        err = weight * (s - y)
        g = np.concatenate([x.T @ err + l2 * w, [err.sum()]])
        if len(at):
            r, own = sigmoid(swapped @ w + b), s[at]
            change = 2 * swap_weight * (own - r) / len(at)
            a, c = change * own * (1 - own), change * r * (1 - r)
            g[:-1] += x[at].T @ a - swapped.T @ c
            g[-1] += (a - c).sum()
        g[terms] += swap_weight * w[terms] / 4  # a text that names no group, with a term put in: the change is the term's weight
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        free = w - step[:-1]
        w = np.maximum(free, 0)
        w[terms] = free[terms]
        w, b = w.astype(np.float32), np.float32(b - step[-1])
    return w.astype(np.float64), float(b)


def _scored(docs: DataFrame, model: ToxicityModel, text: str) -> Column:
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        m = sent.value
        scores = [m.score(t) for s in range(0, len(texts), 256) for t in texts.slice(s, 256).to_pylist()]
        tidy()
        return pa.array(scores, pa.float64())

    return scored(col(docs, text))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    base = docs.withColumn("score", _scored(docs, model, text))
    return base.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns and no others."""
    return docs.where(_scored(docs, model, text) < threshold)
