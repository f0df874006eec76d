"""Grounded answers: context and prompt as Column expressions, the generator behind an interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_filled

NOTHING = "No results were found, so there is nothing to summarize."
UNAVAILABLE = "The generator can't be reached; the best document found says:"
TEMPLATE = "Summarise what the documents below say about the question, briefly, and add nothing of your own.\n\nQuestion: {query}\n\nDocuments:\n{context}\n\nAnswer:"

#: Loaded once a task: prompt -> answer; raises if it can't answer.
Generator = Callable[[], Callable[[str], str]]


def body(df: DataFrame) -> Column:
    """A hit's text, or failing that its raw document."""
    return first_filled(*(F.col(c) for c in ("text", "raw_document") if c in df.columns))


def contexts(hits: DataFrame, top: int = 3, chars: int = 800) -> DataFrame:
    """(query_id, context): the first ``top`` hits of each query, set out for a prompt."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in hits.columns else F.lit("")
    block = F.concat(
        F.lit("Document ID: "), F.col("doc_id").cast("string"), F.lit("\nTitle: "), shown("title"), F.lit("\nSection: "), shown("section"),
        F.lit("\nText: "), F.substring(body(hits), 1, chars), F.lit("\n"),
    )
    few = hits.where(F.col("rank") <= top).select("query_id", "rank", block.alias("block"))
    rows = few.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("rows"))  # ``top`` rows a query
    return rows.select("query_id", F.array_join(F.transform("rows", lambda r: r["block"]), "\n---\n").alias("context"))


def prompts(queries: DataFrame, hits: DataFrame, template: str = TEMPLATE, top: int = 3, chars: int = 800) -> DataFrame:
    """(query_id, query, prompt): null prompt for a query without hits."""
    before, _, rest = template.partition("{query}")
    middle, _, after = rest.partition("{context}")
    joined = queries.join(contexts(hits, top, chars), "query_id", "left")
    prompt = F.concat(F.lit(before), F.col("query"), F.lit(middle), F.col("context"), F.lit(after))
    return joined.select("query_id", "query", prompt.alias("prompt"))


def fallbacks(queries: DataFrame, hits: DataFrame, chars: int = 500, notice: str = UNAVAILABLE, nothing: str = NOTHING) -> DataFrame:
    """(query_id, answer): what is said without a generator: the head of the best hit's text."""
    best = hits.where(F.col("rank") == 1).select("query_id", F.substring(body(hits), 1, chars).alias("head"))
    return queries.join(best, "query_id", "left").select("query_id", F.when(F.col("head").isNull(), F.lit(nothing)).otherwise(F.concat(F.lit(notice + "\n\n"), "head")).alias("answer"))


def summarize(queries: DataFrame, hits: DataFrame, generator: Generator | None = None, template: str = TEMPLATE) -> DataFrame:
    """(query_id, answer): the generator's answer, stripped; where it fails, or without one, the fallback."""
    plain = fallbacks(queries, hits)
    if generator is None:
        return plain
    asked = prompts(queries, hits, template).join(plain, "query_id").select("query_id", "prompt", "answer")
    names = ["query_id", "answer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = generator()
        for b in batches:
            out = []
            for prompt, fallback in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    out.append(answer(prompt).strip() if prompt is not None else fallback)
                except Exception:  # any failure of the generator
                    out.append(fallback)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names)

    return asked.mapInArrow(run, T.StructType([asked.schema["query_id"], T.StructField("answer", T.StringType())]))


def http_generator(url: str, model: str, timeout: float = 60.0) -> Generator:
    """A generator behind a local HTTP service that takes {model, prompt, stream} and returns {response}."""

    def load():
        import json
        from urllib.request import Request, urlopen

        def answer(prompt: str) -> str:
            data = json.dumps({"model": model, "prompt": prompt, "stream": False}).encode()
            with urlopen(Request(url, data=data, headers={"Content-Type": "application/json"}), timeout=timeout) as r:
                return json.load(r).get("response", "")

        return answer

    return load
