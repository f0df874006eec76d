"""A stream of queries, answered a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans.search import HybridSearch


def search_stream(queries: DataFrame, engine: HybridSearch, path: str, checkpoint: str, top_k: int = 10) -> DataStreamWriter:
    """A writer that appends each batch's hits to Parquet below ``path``, in a folder a batch.

    A batch that runs again after a failure overwrites its own folder, so hits are written once.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        engine.search(batch, top_k).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
