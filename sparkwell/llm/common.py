"""Shared plumbing: safe column handling, hashing, and lineage cuts from the library."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import Workspace, hadoop_path, remove, shared_dir, small_batches

__all__ = ["Workspace", "col", "fresh", "hadoop_path", "lower_ascii", "map_batches", "mix64", "remove", "row_count_bound", "shared_dir", "small_batches", "tidy"]

ASCII_SPACE = " \t\n\x0b\x0c\r"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
U64 = np.uint64


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, so that helper columns never clash."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df[f"`{name.replace('`', '``')}`"]


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` for columns of any names (dotted ones too): ``run`` finds them by their place."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def tidy() -> None:
    """Give freed memory back to the system, at the end of a task: workers wait for the next one with what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def row_count_bound(df: DataFrame, bound: int) -> int | None:
    """Rows of ``df`` if there are at most ``bound``, else None. Counts no further than the bound."""
    n = df.limit(bound + 1).count()
    return n if n <= bound else None
