from __future__ import annotations

import numpy as np
import pytest

from sparkwell.llm import bloom
from sparkwell.llm.common import Workspace
from sparkwell.llm.components import connected_components


def test_no_key_is_lost_and_few_others_pass():
    rng = np.random.default_rng(1)
    keys, others = (rng.integers(-(1 << 63), 1 << 63, 20_000) for _ in range(2))
    words = np.zeros(bloom.blocks_for(len(keys), 12, 1 << 30) * 8, np.uint64)
    bloom.add(words, keys)
    assert bloom.might_contain(words, keys).all()
    assert bloom.might_contain(words, others).mean() < 0.03


def test_distributed_filter(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("xxhash64(id) AS h")
    words = bloom.build(df, bloom.blocks_for(5000, 12, 1 << 30))
    probe = bloom.probe_udf(words, spark)
    got = spark.range(0, 10_000).selectExpr("id", "xxhash64(id) AS h")
    rows = got.select("id", probe("h").alias("m")).collect()
    assert all(r["m"] for r in rows if r["id"] < 5000) and sum(r["m"] for r in rows if r["id"] >= 5000) < 250


def test_twice_seen(spark):
    lists = [([1, 2, 3],), ([3, 4],), ([5],), ([6, 1],), ([],), (None,)] + [([1000 + i],) for i in range(500)]
    df = spark.createDataFrame(lists, "h array<long>").repartition(5)
    words = bloom.build_twice(df, bloom.blocks_for(2000, 16, 1 << 30), 3)
    found = bloom.might_contain(words, np.array([1, 3]))
    assert found.all()
    assert bloom.might_contain(words, np.arange(1000, 1500)).mean() < 0.05


def test_filter_at_its_bound_still_holds_all():
    words = np.zeros(bloom.blocks_for(10**9, 10, 64) * 8, np.uint64)
    keys = np.arange(100)
    bloom.add(words, keys)
    assert len(words) == 8 and bloom.might_contain(words, keys).all()


@pytest.mark.parametrize("limit", [0, 10_000])
def test_drop_ids(spark, limit):
    docs = spark.createDataFrame([(i, "x") for i in range(50)] + [(None, "y"), (7, "again")], "doc_id long, __gone string")
    gone = spark.createDataFrame([(i,) for i in range(0, 50, 7)] + [(None,)], "id long")
    left = bloom.drop_ids(docs, "doc_id", gone, broadcast_rows=limit)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == sorted([(False, i) for i in range(50) if i % 7] + [(True, 0)])


def components_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for e in edges for x in e}


@pytest.mark.parametrize("kind", ["path", "star", "random", "loops", "empty"])
def test_components(spark, kind):
    rng = np.random.default_rng(2)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(100)] + [(900, 901), (901, 900), (900, 901)],
        "random": [tuple(map(int, rng.integers(0, 80, 2))) for _ in range(50)],
        "loops": [(1, 1), (2, 3)],
        "empty": [],
    }[kind]
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "test"))
    want = components_of([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in got.collect()} == want and got.count() == len(want)
