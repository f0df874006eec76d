from __future__ import annotations

import random
import string
from collections import defaultdict

import pytest

from sparkwell.llm.line_dedup import dedup_lines

LONG = "This line is long enough to be counted, as it has over forty characters"


def brute(docs, least=5):
    key = lambda x: "".join(c.lower() if c in string.ascii_uppercase else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < least or i == max(holders[key(x)], key=lambda v: (v is not None, v or 0))]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(df, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"filter_bytes": 64, "bits_per_line": 0.01}, {"filter_bytes": 64}, {"filter_bytes": 64, "broadcast_bytes": 0, "bits_per_line": 30}, {"filter_bytes": 128}])
def test_same_as_brute_force(spark, options):
    rng = random.Random(6)
    pool = [LONG + str(i) for i in range(12)] + ["short", "", "Ünïcode " * 6, "ünïcode " * 6, LONG.upper() + "1", "  " + LONG + "2\t", "x" * 39, "y" * 40, "ß" * 40]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, LONG + "0"), (3, LONG + "3\nother"), (3, LONG + "3"), (502, "\n".join([LONG + "4"] * 5000))]
    assert run(spark, docs, **options) == brute(docs)


def test_parts_let_few_single_lines_pass(spark):
    """Hashes of three times what a filter has room for: all repeats pass and hardly any other."""
    from pyspark.sql import functions as F

    from sparkwell.llm import bloom

    lists = spark.range(0, 6000, 1, 5).select(F.array(F.xxhash64("id"), F.xxhash64(F.col("id") % 40 + 100_000), F.xxhash64(F.lit("hot"))).alias("heads"))
    got = {r["h"] for r in bloom.seen_twice(lists, 18_000, 12.0, 9_000).collect()}
    must = {r["h"] for r in spark.range(40).select(F.xxhash64(F.col("id") + 100_000).alias("h")).collect()} | {spark.range(1).select(F.xxhash64(F.lit("hot")).alias("h")).first()["h"]}
    assert must <= got and len(got) - len(must) < 300


def test_four_documents_are_too_few(spark):
    docs = [(i, LONG) for i in range(4)] + [(1, LONG), (9, "z")]
    assert run(spark, docs) == brute(docs)
    assert all(r[3] == 0 for r in run(spark, docs))


def test_largest_id_keeps_all_its_repeats(spark):
    docs = [(i, f"{LONG}\n{i}\n{LONG}") for i in range(6)]
    got = {r[0]: r for r in run(spark, docs)}
    assert got[5][3] == 0 and all(got[i] == (i, str(i), 3, 2) for i in range(5))


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(i, LONG, "kept", 1.5) for i in range(6)], "doc_id long, text string, __kept string, digest double")
    for bytes_ in (0, 1 << 20):
        out = dedup_lines(df, broadcast_bytes=bytes_)
        assert out.columns == ["doc_id", "text", "__kept", "digest", "n_lines", "n_dropped"]
        assert sorted((r["doc_id"], r["text"], r["__kept"], r["digest"]) for r in out.collect()) == [(i, LONG if i == 5 else "", "kept", 1.5) for i in range(6)]


def test_columns_named_like_the_results_are_replaced(spark):
    df = spark.createDataFrame([(i, LONG, "old", 7, "q") for i in range(6)], "doc_id long, text string, n_lines string, n_dropped int, `a.b` string")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "a.b", "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["a.b"]) for r in out.collect()) == [(i, 1, int(i < 5), "q") for i in range(6)]
