from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.llm.topk import _pivots, quantize, top_k


def run(spark, rows, k=20, every=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4).select("vec_id", "score", quantize(F.col("embedding")).alias("vector"))
    out = top_k(df, df.where(f"vec_id % {every} = 0"), k, **options)
    return sorted(tuple(r) for r in out.collect())


def brute(rows, k=20, every=5):
    good = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        own = min(tuple(v) for i, v in good if i == q)
        scored = sorted((-int(np.array(own) @ v), i) for i, v in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize(("n", "dims", "spread", "groups"), [(600, 8, 0.05, 9), (400, 64, 1.0, 40), (300, 4, 0.0, 9), (7, 3, 1.0, 500)])
def test_exact(spark, n, dims, spread, groups):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((5, dims))
    v = centres[rng.integers(0, 5, n)] + spread * rng.standard_normal((n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist(), "s") for i, x in enumerate(v)]
    assert run(spark, rows, queries_per_group=groups) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 1.0], "a"), (5, [0.5, None], "b"), (10, [nan, 1.0], "c"), (15, [inf, 0.0], "d"), (20, None, "e"), (None, [1.0, 1.0], "f"), (25, [1.0], "g"), (26, [-0.001, -2.0], "h"), (27, [], "i"), (0, [0.5, 1.0], "a"), (3, [0.25, 0.25], "t"), (2, [0.25, 0.25], "t"), (1, [1e6, -1e6], "big")]
    assert run(spark, rows) == brute(rows)


def test_none_at_all(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0], "x")]) == [] and run(spark, [(5, [1.0], "x")]) == []


def test_scores_that_dont_fit_are_refused(spark):
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(0, [1e12, 1.0], "x"), (1, [1.0, 1.0], "x")])


def test_pruning_leaves_data_out(spark):
    """Two tight far-apart clusters: a query group needs one of them only, and the result is still exact."""
    rng = np.random.default_rng(9)
    a, b = np.array([8.0, 0, 0, 0]), np.array([0, 8.0, 0, 0])
    rows = [(i, ((a if i % 2 else b) + 0.01 * rng.standard_normal(4)).tolist(), "s") for i in range(400)]
    assert run(spark, rows, k=5, queries_per_group=20) == brute(rows, k=5)


def test_driver_holds_neither_salted_queries_nor_vectors_of_each_task(spark):
    """Spark takes the queries for as small as they are before the salts multiply them, so it would broadcast them."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.integers(-60, 60, (500, 4)))], "vec_id long, vector array<long>")
    plan = top_k(df, df.where("vec_id % 20 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pivots_are_few_whatever_the_tasks_and_repeats(spark):
    rows = spark.range(3000).selectExpr("id", "array(id, id + 1) AS v")
    few, many = (_pivots(rows.repartition(n), 8, 3000) for n in (1, 16))
    assert few == many and 1 <= len(few) <= 8 and all(v[1] == v[0] + 1 for v in few)
    same = rows.selectExpr("7L AS id", "v")
    assert len(_pivots(same, 8, 3000)) == 1 and _pivots(rows.where("id < 0"), 8, 0) == []


@pytest.mark.parametrize("size", [1, 100, 30_000, 2**30])
def test_exact_at_each_width(spark, size):
    rng = np.random.default_rng(size)
    v = rng.integers(-size, size, (200, 3), endpoint=True)
    rows = [(i, (x / 64).tolist(), "s") for i, x in enumerate(v)]
    assert run(spark, rows, queries_per_group=9) == brute(rows)


def test_groups_in_several_sets(spark, monkeypatch):
    """Data are sent once a set; each set's groups keep bounds of their own."""
    monkeypatch.setattr("sparkwell.llm.topk.SET", 12)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((5, 6))[rng.integers(0, 5, 500)] + 0.1 * rng.standard_normal((500, 6))
    rows = [(i, x.tolist(), "s") for i, x in enumerate(v)]
    assert run(spark, rows, k=7, queries_per_group=9) == brute(rows, k=7)
