"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceframe.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to the least of its neighbourhood. A hub's rows meet its one minimum in a join, which AQE can split."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b. Each node and its smaller neighbours join the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, ws: Workspace, max_rounds: int = 60) -> DataFrame:
    """edges(a, b): any comparable type, either direction, repeats, loops and nulls allowed.

    Returns node, component (the least node reachable) for each node with an edge to another one; no edges give no rows.
    Each round is written to the shared folder, so lineage stays short. Rounds needed grow with the logarithm of the longest chain."""
    now = ws.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, seen = None, [now]
    for _ in range(max_rounds):
        new = ws.save(_small_star(_large_star(now)), "stars")
        row = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        ws.drop(*seen)
        now, seen, same, mark = new, [new], (row[0], row[1]) == mark, (row[0], row[1])
        if same or row[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
