from __future__ import annotations

import random
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest

from sparkwell.llm.sharding import boundaries, shard_by_bytes, write_shards


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(5)
    return [r.asDict() for r in shard_by_bytes(df, **options).collect()]


def check(rows, got, shards=8, tolerance=0.02):
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _ in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += len((r["text"] or "").encode()) + 1
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards))
    return sizes


def test_sizes_slots_and_groups(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abc é") for _ in range(rng.randint(0, 200))), "x") for i in range(3000)] + [(5000 + i, "copy " * 20, "x") for i in range(5)]
    got = run(spark, rows, part_bytes=8192)
    sizes = check(rows, got)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) <= 1.05 * mean and min(sizes.values()) >= 0.95 * mean
    assert len({r["shard"] for r in got if r["text"] == "copy " * 20}) == 1
    again = run(spark, rows, part_bytes=1 << 20)
    assert {(r["doc_id"]): r["shard"] for r in got} == {(r["doc_id"]): r["shard"] for r in again}


def test_hot_text_is_split_by_id(spark):
    rows = [(i, "hot" * 30, "x") for i in range(1000)] + [(2000 + i, f"cold {i} " * 12, "x") for i in range(1200)]
    got = run(spark, rows)
    sizes = check(rows, got)
    assert max(sizes.values()) <= 1.06 * min(sizes.values())


@pytest.mark.parametrize("rows", [[], [(1, "a", "x")], [(1, None, "x"), (None, "", "x"), (None, None, "x"), (1, None, "x")], [(7, "same", "x")] * 40, [(1, "x" * 100_000, "x")] + [(i, "y", "x") for i in range(30)], [(-(2**63), "a", "x"), (2**63 - 1, "a", "x"), (0, "b", "x")]])
def test_odd_tables(spark, rows):
    check(rows, run(spark, rows))


def test_shards_on_disk(spark, tmp_path):
    rows = [(i, f"text {i % 50}", "x") for i in range(400)]
    df = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, other string"), shards=3)
    write_shards(df, str(tmp_path))
    back = spark.read.parquet(str(tmp_path))
    assert back.count() == 400 and set(back.columns) == {"doc_id", "text", "other", "shard", "slot"}


def test_very_many_boundaries(spark):
    """Each states exactly what lies below it, and none is far from its target."""
    rng = random.Random(2)
    rows = [(rng.getrandbits(63) * rng.choice((1, -1)), i, rng.randint(1, 200)) for i in range(20_000)]
    total = sum(r[2] for r in rows)
    cuts = boundaries(spark.createDataFrame(rows, "key long, id long, size long"), total, len(rows), 2400, 8, 0.02)
    rows.sort()
    keys, below = [r[0] for r in rows], [0]
    for r in rows:
        below.append(below[-1] + r[2])
    assert len(cuts) == 2399 and all(c.id is None and c.rows == bisect_left(keys, c.key) and c.bytes == below[c.rows] for c in cuts)
    assert max(abs(c.bytes - total * (i + 1) / 2400) for i, c in enumerate(cuts)) <= 0.02 * total / 8
