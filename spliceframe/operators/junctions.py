"""Junction counts, and their exact matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def junction_counts(rows: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """by, start, end, count: equal junctions counted; partial counts meet, so a junction that all reads share is one row for each task."""
    return rows.groupBy(*by, start, end).agg(F.count("*").alias("count"))


def junction_runs(rows: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The same by runs of sorted rows: number the rows of each run, keep each run's last. For sorted inputs that are needed in order."""
    run = Window.partitionBy(*by, start).orderBy(end)
    numbered = rows.withColumns({"_n": F.row_number().over(run), "_next": F.lead(end).over(run)}).where(F.col("_next").isNull() | (F.col("_next") != F.col(end)))
    before = F.lag("_n", 1, 0).over(run)
    return numbered.withColumn("count", (F.col("_n") - before).cast("long")).select(*by, start, end, "count")


def match_junctions(pairs: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """pairs(by, start, end, ...) with count of the junction that equals them, 0 if none does."""
    return pairs.join(counts, [*by, "start", "end"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
