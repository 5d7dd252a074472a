"""Junction counts over a stream of fragments' junctions: an extension for alignments that arrive while a sequencer runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, start, end, count so far. State is one count for each junction; use output mode update or complete."""
    return rows.groupBy(*by, "start", "end").agg(F.count("*").alias("count"))


def windowed_counts(rows: DataFrame, by: list[str], time: str, window: str, delay: str) -> DataFrame:
    """The same by windows of arrival time; rows later than delay are dropped and their state goes."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, window), *by, "start", "end").agg(F.count("*").alias("count"))


def append_batches(rows: DataFrame, by: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's counts under its batch id, so a repeated batch replaces itself; sum over batches to read totals."""

    def write(batch: DataFrame, batch_id: int) -> None:
        running_counts(batch, by).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(path_rows: DataFrame, by: list[str]) -> DataFrame:
    return path_rows.groupBy(*by, "start", "end").agg(F.sum("count").alias("count"))
