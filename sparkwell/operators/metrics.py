"""Retrieval and summary quality: P@k, R@k, RR, Hit@k, F1; ROUGE; greedy embedding matching."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import small_batches

#: Pairs whose tokens a worker holds as Python strings, and similarities that it holds at once.
PAIRS, SIMILARITIES = 256, 1 << 20
METRICS = ("precision", "recall", "rr", "hit", "f1")


def evaluate(queries: DataFrame, relevant: DataFrame, hits: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """One row for each query of ``queries``: its metrics, also if it has no hit or nothing is relevant.

    ``relevant`` has (query_id, doc_id) pairs, ``hits`` (query_id, rank, doc_id). Precision
    divides by k whatever was found; the reciprocal rank looks at all hits given, not the first k.
    """
    gold = relevant.select("query_id", "doc_id").distinct()
    n_relevant = gold.groupBy("query_id").agg(F.count("doc_id").alias("n_rel"))
    first = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    good = first.join(gold, ["query_id", "doc_id"], "left_semi")
    own = good.groupBy("query_id").agg(F.sum((F.col("rank") <= k).cast("long")).alias("n_good"), F.min("rank").alias("best"))
    all_ = queries.select("query_id").join(n_relevant, "query_id", "left").join(own, "query_id", "left").na.fill(0, ["n_rel", "n_good"])
    p, r = F.col("n_good") / F.lit(float(k)), F.coalesce(F.try_divide(F.col("n_good").cast("double"), F.col("n_rel")), F.lit(0.0))
    out = all_.withColumns({"p": p, "r": r})
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    rr = F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0))
    values = {"precision": F.col("p"), "recall": F.col("r"), "rr": rr, "hit": (F.col("n_good") > 0).cast("double"), "f1": f1}
    return out.select("query_id", F.col("n_rel").alias("n_relevant"), *(F.round(v, digits).alias(name) for name, v in values.items()))


def summary(per_query: DataFrame, digits: int = 6) -> DataFrame:
    """One row: the mean of each metric over the queries; null if there are none."""
    return per_query.agg(F.count("query_id").alias("n_queries"), *(F.round(F.avg(m), digits).alias(m) for m in METRICS))


def compare(base: DataFrame, other: DataFrame, digits: int = 6) -> DataFrame:
    """(metric, base, other, delta, delta_pct): the means of two runs; no percentage of a base of 0."""
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in METRICS))).alias("x")).select("x.*")
    both = long(summary(base, 12), "base").join(long(summary(other, 12), "other"), "metric")
    delta = F.col("other") - F.col("base")
    return both.select("metric", *(F.round(c, digits).alias(n) for n, c in (("base", F.col("base")), ("other", F.col("other")), ("delta", delta), ("delta_pct", F.try_divide(100 * delta, F.col("base"))))))


def compare_queries(queries: DataFrame, base: DataFrame, other: DataFrame, width: int = 54, digits: int = 6) -> DataFrame:
    """Each query's change of precision, with a mark for its direction; the query is cut for display."""
    both = queries.join(base.select("query_id", F.col("precision").alias("base")), "query_id").join(other.select("query_id", F.col("precision").alias("other")), "query_id")
    delta = F.round(F.col("other") - F.col("base"), digits)
    mark = F.when(delta > 0, "up").when(delta < 0, "down").otherwise("equal")
    return both.select("query_id", F.substring("query", 1, width).alias("query"), "base", "other", delta.alias("delta"), mark.alias("mark"))


# --- ROUGE --------------------------------------------------------------------------------


def rouge_tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def rouge_n(pairs: DataFrame, n: int = 1, pair_id: str = "pair_id", digits: int = 6) -> DataFrame:
    """(pair_id, precision, recall, f) by clipped n-gram overlap of ``prediction`` with ``reference``, unstemmed.

    Built-in functions only; a pair without n-grams on a side scores 0.
    """

    def grams(side: str) -> DataFrame:
        t = pairs.select(pair_id, rouge_tokens(F.col(side)).alias("t"))
        starts = F.when(F.size("t") >= n, F.sequence(F.lit(1), F.size("t") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return t.select(pair_id, F.explode(F.transform(starts, lambda i: F.array_join(F.slice("t", i, n), " "))).alias("g")).groupBy(pair_id, "g").agg(F.count("g").alias(f"n_{side}"))

    a, b = grams("prediction"), grams("reference")
    both = a.join(b, [pair_id, "g"], "full_outer").groupBy(pair_id).agg(
        F.sum(F.coalesce(F.least(F.coalesce("n_prediction", F.lit(0)), F.coalesce("n_reference", F.lit(0))), F.lit(0))).alias("m"), F.coalesce(F.sum("n_prediction"), F.lit(0)).alias("np"), F.coalesce(F.sum("n_reference"), F.lit(0)).alias("nr")
    )
    return _prf(pairs.select(pair_id).join(both, pair_id, "left").na.fill(0), pair_id, digits)


def _prf(df: DataFrame, pair_id: str, digits: int) -> DataFrame:
    p, r = F.col("m") / F.greatest("np", F.lit(1)), F.col("m") / F.greatest("nr", F.lit(1))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return df.select(pair_id, F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f, digits).alias("f"))


def porter_stem(word: str) -> str:
    """Porter's algorithm (1980), with the usual short-word rule left to the caller."""
    vowels = "aeiou"

    def cons(w: str, i: int) -> bool:
        return w[i] not in vowels and not (w[i] == "y" and i > 0 and cons(w, i - 1))

    def measure(w: str) -> int:
        shape = "".join("c" if cons(w, i) else "v" for i in range(len(w)))
        return sum(1 for i in range(1, len(shape)) if shape[i - 1] == "v" and shape[i] == "c")

    has_vowel = lambda w: any(not cons(w, i) for i in range(len(w)))
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1)
    cvc = lambda w: len(w) > 2 and cons(w, len(w) - 3) and not cons(w, len(w) - 2) and cons(w, len(w) - 1) and w[-1] not in "wxy"

    def swap(w: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
        for old, new in rules:
            if w.endswith(old):
                stem = w[: len(w) - len(old)]
                return stem + new if measure(stem) > least else w
        return w

    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    w = swap(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    for end in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if measure(stem) > 1 or (measure(stem) == 1 and not cvc(stem)):
            w = stem
    return w[:-1] if measure(w) > 1 and double(w) and w[-1] == "l" else w


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if u := v & at.get(x, 0):
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def rouge(pairs: DataFrame, pair_id: str = "pair_id", stem: bool = True, digits: int = 6) -> DataFrame:
    """(pair_id, rouge1, rouge2, rougeL): F scores; tokens of more than three letters are stemmed."""
    tokens = pairs.select(pair_id, rouge_tokens(F.col("prediction")).alias("p"), rouge_tokens(F.col("reference")).alias("r"))

    @F.arrow_udf("struct<rouge1: double, rouge2: double, rougeL: double>")
    def scores(p: pa.Array, r: pa.Array) -> pa.Array:
        from collections import Counter
        from functools import lru_cache

        cut = lru_cache(50_000)(lambda t: porter_stem(t) if stem and len(t) > 3 else t)

        def f(m: int, a: int, b: int) -> float:
            x, y = m / max(a, 1), m / max(b, 1)
            return round(2 * x * y / (x + y), digits) if x + y else 0.0

        out = []
        for a, b in zip(p.to_pylist(), r.to_pylist(), strict=True):
            a, b = [cut(t) for t in a or []], [cut(t) for t in b or []]
            row = {}
            for n in (1, 2):
                x, y = (Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in (a, b))
                row[f"rouge{n}"] = f(sum((x & y).values()), sum(x.values()), sum(y.values()))
            row["rougeL"] = f(lcs_length(a, b), len(a), len(b))
            out.append(row)
        return pa.array(out, pa.struct([("rouge1", pa.float64()), ("rouge2", pa.float64()), ("rougeL", pa.float64())]))

    return tokens.select(pair_id, scores("p", "r").alias("s")).select(pair_id, "s.*")


# --- greedy matching of token vectors -----------------------------------------------------


def embedding_match(pairs: DataFrame, token_vectors: Callable[[], Callable[[list[str]], np.ndarray]], pair_id: str = "pair_id", digits: int = 6) -> DataFrame:
    """(pair_id, precision, recall, f): each token is matched with the most similar token of the other side.

    ``token_vectors`` is loaded once a task and gives a vector for each token.
    """
    small_batches(pairs.sparkSession)
    tokens = pairs.select(pair_id, rouge_tokens(F.col("prediction")).alias("p"), rouge_tokens(F.col("reference")).alias("r"))
    kind = pairs.schema[pair_id].dataType.simpleString()

    def run(batches):
        embed = token_vectors()

        def unit(words: list[str]) -> np.ndarray:
            v = np.asarray(embed(words), np.float64)
            return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

        def matched(p: np.ndarray, r: np.ndarray) -> tuple[float, float]:
            """Mean of the best of each token of either side; similarities are held for some tokens at a time."""
            step, own, other = max(1, SIMILARITIES // len(r)), [], np.full(len(r), -np.inf)
            for start in range(0, len(p), step):
                s = p[start : start + step] @ r.T
                own.append(s.max(1))
                other = np.maximum(other, s.max(0))
            return float(np.concatenate(own).mean()), float(other.mean())

        for whole in batches:
            for start in range(0, whole.num_rows, PAIRS):
                b, out = whole.slice(start, PAIRS), []
                for p, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if not p or not r:
                        out.append((0.0, 0.0, 0.0))
                        continue
                    x, y = matched(unit(p), unit(r))
                    out.append((x, y, 2 * x * y / (x + y) if x + y else 0.0))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], pa.float64()) for i in range(3))], [pair_id, "precision", "recall", "f"])

    scored = tokens.mapInArrow(run, f"{pair_id} {kind}, precision double, recall double, f double")
    return scored.select(pair_id, *(F.round(c, digits).alias(c) for c in ("precision", "recall", "f")))
