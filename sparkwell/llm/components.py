"""Connected components by alternating large-star and small-star.

Each round is a partially aggregated minimum per node and an equi-join back on the node; no
neighbourhood is ever gathered, so a node with a third of all links is combined on the map
side and its join partition is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node link to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, link to the smallest."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc", max_rounds: int = 100) -> DataFrame:
    """(node, component): for each node of ``edges`` (u, v), the smallest node reachable from it.

    Self-links are ignored; an empty table gives an empty one.
    """

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    now = ws.cut(edges.select("u", "v").where("u <> v").distinct(), f"{name}-0")
    seen = state(now)
    for i in range(max_rounds):
        if not seen[0]:
            break
        after = ws.cut(_small_star(_large_star(now)), f"{name}-{i + 1}")
        ws.drop(f"{name}-{i}")
        now, before, seen = after, seen, state(after)
        if seen == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
