"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A listed URL is (host, path, verdict). It fits its host and all subdomains, if the page's
path starts with the listed path; the longest listed URL that fits wins (ties: the longer
host, then ``block``). A URL that no listed one fits is allowed. Method:

1. the canonical form of a page's URL is its host (A-Z lower-cased) and path. It has a
   candidate for each listed number of host labels that its host reaches and each listed path
   length that its path reaches;
2. the candidates' 64-bit hashes probe the Bloom filter inside an Arrow function, page by page.
   A page without a possible hit gets the method's verdict there and never leaves its task;
3. of the other pages, distinct (host, path, candidate) rows meet the list in an exact join,
   which removes false positives; the list side is sent to all tasks only if it is counted and
   small, otherwise both sides are hashed, and adaptive execution splits a hot key;
4. the winner of each (host, path) goes back to these pages: sent to all tasks if there are few
   winners (counted), else in an exchange.

Nulls and odd inputs: a null URL, or one without ``://``, has an empty host and an empty
path and is allowed by the method. An empty list allows everything. Repeated pages each
keep a row; further columns are carried along, and columns named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import Workspace, col, fresh, lower_ascii, row_count_bound

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RESULTS = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    return (lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit("")))


def candidates(host: str, path: str, labels: list[int], lengths: list[int]) -> list[str]:
    """All (host, path) keys under which a URL that fits this one may be listed.

    ``labels`` and ``lengths``, ascending: how many labels listed hosts have, and how long listed paths are.
    """
    parts = host.rsplit(".", labels[-1]) if labels else []
    if len(parts) > (labels[-1] if labels else 0):
        parts = parts[1:]
    heads = [path[:n] for n in lengths if n <= len(path)]
    return [f"{tail}\0{head}" for k in labels if k <= len(parts) for tail in (".".join(parts[-k:]),) for head in heads] if heads else []


def filter_urls(
    pages: DataFrame, listed: DataFrame, url: str = "url", *, bits_per_url: float = 12.0, filter_bytes: int = 256 << 20, broadcast_rows: int = 100_000
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the listed URL that decided, else null) and ``verdict``.

    ``listed`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``).
    """
    spark, ws = pages.sparkSession, Workspace(pages.sparkSession, "url-filter")
    rules = listed.select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict")).where(F.col("r_host").isNotNull() & F.col("r_path").isNotNull())
    rules = rules.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict")).withColumn("key", F.concat("r_host", F.lit("\x00"), "r_path"))
    rules = ws.cut(rules, "rules")
    lengths, labels = (sorted(r[0] for r in rules.select(c).distinct().toLocalIterator()) for c in (F.length("r_path"), F.size(F.split("r_host", r"\.", -1))))
    small = row_count_bound(rules, broadcast_rows)
    n = small if small is not None else rules.count()
    words = bloom.build(rules.select(F.xxhash64("key").alias("h")), bloom.blocks_for(n, bits_per_url, filter_bytes))
    sent = spark.sparkContext.broadcast(words)

    @F.arrow_udf("array<string>")
    def possible(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        from xxhash import xxh64_intdigest

        out: list[list[str]] = []
        for s in range(0, len(hosts), 4096):
            keys = [candidates(h, p, labels, lengths) if h else [] for h, p in zip(hosts.slice(s, 4096).to_pylist(), paths.slice(s, 4096).to_pylist(), strict=True)]
            flat = [k for own in keys for k in own]
            hashes = np.fromiter((xxh64_intdigest(k.encode("utf-8", "surrogatepass"), 42) for k in flat), np.uint64, len(flat))  # as F.xxhash64 has it
            maybe = iter(bloom.might_contain(sent.value, hashes.view(np.int64)).tolist())
            out += [[k for k in own if next(maybe)] for own in keys]
        return pa.array(out, pa.list_(pa.string()))

    host, path = host_and_path(col(pages, url))
    h, p, m = (fresh(pages, x) for x in ("host", "path", "maybe"))
    own = pages.withColumns({h: host, p: path})
    probed = own.withColumn(m, possible(F.col(h), F.col(p)))
    hits = probed.where(F.size(m) > 0).select(F.col(h).alias("host"), F.col(p).alias("path"), F.explode(m).alias("key")).distinct()
    exact = hits.join(F.broadcast(rules) if small is not None else rules, "key")
    best = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("m"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    won = exact.groupBy("host", "path").agg(F.max(best).alias("best")).select(F.col("host").alias("w_host"), F.col("path").alias("w_path"), F.col("best.rule").alias("w_rule"), F.col("best.verdict").alias("w_verdict"))
    won = ws.cut(won, "won")
    kept = [col(pages, c) for c in pages.columns if c not in RESULTS]
    fits = (F.col(h) == F.col("w_host")) & (F.col(p) == F.col("w_path"))
    result = [*kept, F.col(h).alias("host"), F.col(p).alias("path"), F.col("w_rule").alias("rule"), F.coalesce("w_verdict", F.lit("allow")).alias("verdict")]
    if row_count_bound(won, broadcast_rows) is not None:
        return own.join(F.broadcast(won), fits, "left").select(*result)
    rest = probed.where(F.size(m) == 0).select(*kept, F.col(h).alias("host"), F.col(p).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return probed.where(F.size(m) > 0).join(won, fits, "left").select(*result).unionByName(rest)
