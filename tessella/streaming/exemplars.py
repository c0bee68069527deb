"""Exemplars of a stream: each micro-batch's top rows are merged into a table of top k rows by feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.selection import NAME, SCORE, SOURCE, exemplars


def merge(known: DataFrame | None, batch: DataFrame, k: int) -> DataFrame:
    """Top k by feature of what is known and a batch of activations."""
    if known is None:
        return exemplars(batch, k=k)
    old = known.select(known[SOURCE].alias("table_name"), "row_idx", known[NAME].alias("feature"), known[SCORE].alias("score"))
    return exemplars(old.unionByName(batch.select("table_name", "row_idx", "feature", "score")), k=k)


def start(activations: DataFrame, path: str, checkpoint: str, k: int = 3) -> StreamingQuery:
    """Keeps versions under ``path``: batch i writes ``path/i`` from ``path/i-1``, so a repeated batch writes the same."""

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        known = spark.read.parquet(f"{path}/{number - 1}") if number else None
        merge(known, batch, k).write.mode("overwrite").parquet(f"{path}/{number}")

    return activations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
