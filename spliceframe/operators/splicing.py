"""Alternative-splicing events: owners, counts and percent spliced in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceframe.functions import stats
from spliceframe.model import OWNERS_KEPT
from spliceframe.operators.intervals import containment_join, overlap_totals
from spliceframe.operators.junctions import match_junctions


def first_events(events: DataFrame, by: list[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Of events that share an ase_id, in all files, the first by file and line; of files that share a type, then, the first. events(ase_id, ase_type, file_idx, line_no, ...).

    files(ase_type, file_idx): all files, so that a type's first one counts even if none of its events is usable; by default those with events."""
    by = by or []
    once = events.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "ase_id").orderBy("file_idx", "line_no"))).where("_n = 1").drop("_n")
    lead = (events if files is None else files).groupBy("ase_type").agg(F.min("file_idx").alias("_file"))
    return once.join(lead, "ase_type").where(F.col("file_idx") == F.col("_file")).drop("_file")


def owners(events: DataFrame, genes: DataFrame, by: list[str], kept: int = OWNERS_KEPT, closed: bool = False) -> DataFrame:
    """ase_id, genes: up to kept genes that contain the event, in order of gene start. events(by, ase_id, e_start, e_end), genes(by, gene_id, g_start, g_end)."""
    met = containment_join(genes.select(*by, "gene_id", "g_start", "g_end"), events.select(*by, "ase_id", "e_start", "e_end"), by, ("g_start", "g_end"), ("e_start", "e_end"), closed)
    listed = F.slice(F.array_sort(F.collect_list(F.struct("g_start", "gene_id"))), 1, kept)
    found = met.groupBy("ase_id").agg(F.transform(listed, lambda x: x["gene_id"]).alias("genes"))
    return events.select("ase_id").join(found, "ase_id", "left")


def junction_support(events: DataFrame, junctions: DataFrame, by: list[str]) -> DataFrame:
    """events with count_in and count_out: junctions equal to their inn and out spans. events(by, ase_id, out, inn), the last two arrays of (s, e)."""
    tagged = lambda side: F.transform(side, lambda x: F.struct(F.lit(side).alias("side"), x["s"].alias("start"), x["e"].alias("end")))
    pairs = events.select(*by, "ase_id", F.explode(F.concat(tagged("out"), tagged("inn"))).alias("p"))
    n = match_junctions(pairs.select(*by, "ase_id", "p.side", "p.start", "p.end"), junctions, by)
    sums = n.groupBy(*by, "ase_id").agg(*[F.sum(F.when(F.col("side") == side, F.col("count")).otherwise(0)).cast("double").alias(name) for side, name in (("inn", "count_in"), ("out", "count_out"))])
    return events.join(sums, [*by, "ase_id"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("count_in", "count_out")})


def retention_support(events: DataFrame, frags: DataFrame, junctions: DataFrame, by: list[str]) -> DataFrame:
    """Retained introns: count_out by junctions as above; count_in is half the fragments without junctions that overlap the inn spans, gaps not regarded.

    Fragments are counted by ranks, without a pair of a fragment and an intron ever standing in a row."""
    spans = events.select(*by, "ase_id", F.explode("inn").alias("x")).select(*by, "ase_id", F.col("x.s").alias("i_start"), F.col("x.e").alias("i_end")).where("i_start <= i_end")
    plain = frags.where(~F.col("has_junction") & (F.col("start") <= F.col("end"))).select(*by, F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    n = overlap_totals(spans, plain, by, "ase_id", ("i_start", "i_end"), ("f_start", "f_end")).withColumn("_in", F.col("n") / 2).drop("n")
    out = junction_support(events, junctions, by).join(n, [*by, "ase_id"], "left")
    return out.withColumn("count_in", F.coalesce("_in", F.lit(0.0))).drop("_in")


def with_psi(counted: DataFrame, interval: bool = True) -> DataFrame:
    """Adds psi, psi_lb, psi_ub from counts by pair of junctions; count_in and count_out stay as they are. Without a span on a side psi and its bounds are NaN."""
    nan = F.lit(float("nan"))
    per = {c: F.coalesce(F.try_divide(F.col(n), F.nullif(F.size(c), F.lit(0))), nan) for c, n in (("inn", "count_in"), ("out", "count_out"))}
    out = counted.withColumns({"_in": per["inn"], "_out": per["out"]})
    whole = ~F.isnan("_in") & ~F.isnan("_out")
    out = out.withColumn("psi", F.when(whole, stats.psi(F.col("_in"), F.col("_out"))).otherwise(nan))
    if interval:
        out = out.withColumn("_ci", stats.interval(F.col("_in"), F.col("_out")))
        out = out.withColumns({"psi_lb": F.when(whole, F.col("_ci.lb")).otherwise(nan), "psi_ub": F.when(whole, F.col("_ci.ub")).otherwise(nan)}).drop("_ci")
    return out.drop("_in", "_out")
