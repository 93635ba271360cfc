"""Incremental edge import from a stream: each micro-batch is appended to the edge table's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_edges(stream: DataFrame, folder: str, checkpoint: str, key: str = "_eid"):
    """Starts a query that adds the stream's edges (_eid, _sid, _tid, properties) to Parquet in folder, each batch once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
