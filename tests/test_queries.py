"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OURS = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(rows: list[tuple], names: list[str]) -> tuple[list[str], list[str]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", OURS)
def test_query(spark, name):
    df = entry.queries()[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    if name not in entry.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    assert plain(rows, df.columns) == plain(want.fetchall(), [d[0] for d in want.description])


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
