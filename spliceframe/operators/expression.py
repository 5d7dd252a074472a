"""Fragment counts of genes, and transcripts per million."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceframe.operators.intervals import BIN, overlap_join, weighed

def swallowed() -> Column:
    """Whether a fragment's gap strictly holds the gene."""
    return (F.col("gap_start") < F.col("g_start")) & (F.col("gap_end") > F.col("g_end"))


def gene_counts(genes: DataFrame, frags: DataFrame, by: list[str], width: int = BIN) -> DataFrame:
    """genes(by, gene_id, g_start, g_end, ...) with with_junction, without_junction, total: fragments that overlap the gene, unless the gap between
    their mates swallows it. One join serves the overlap and the gap; genes that nothing overlaps have 0.

    by: ref_id, or sample_id and ref_id (genes then are to hold a row for each sample)."""
    f = weighed(frags.select(*by, F.col("start").alias("f_start"), F.col("end").alias("f_end"), "has_junction", "gap_start", "gap_end"), [*by, "f_start", "f_end", "has_junction", "gap_start", "gap_end"])
    met = overlap_join(f, genes.select(*by, "gene_id", "g_start", "g_end"), by, width, ("f_start", "f_end"), ("g_start", "g_end"))
    counted = ~F.coalesce(swallowed(), F.lit(False))
    total = lambda cond: F.coalesce(F.sum(F.when(cond & counted, F.col("weight"))), F.lit(0)).cast("long")
    key = [*by, "gene_id", "g_start", "g_end"]
    n = met.groupBy(*key).agg(total(F.col("has_junction")).alias("with_junction"), total(~F.col("has_junction")).alias("without_junction"))
    zero = F.lit(0).cast("long")
    out = genes.join(n, key, "left").withColumns({c: F.coalesce(c, zero) for c in ("with_junction", "without_junction")})
    return out.withColumn("total", F.col("with_junction") + F.col("without_junction"))


def with_tpm(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds tpm: count by length, as a share of all genes' (of a sample), times a million; 0 where a length or the sum is 0.

    The sum is one row for each sample, joined back: genes aren't gathered in one task. Rates are exact decimals, so it doesn't depend on order."""
    rate = F.when(F.col("length") != 0, F.col("total") / F.nullif(F.col("length"), F.lit(0))).otherwise(F.lit(0.0))
    counts = counts.withColumn("rate", rate)
    exact = F.sum(F.col("rate").cast("decimal(30,12)")).cast("double")
    if by:
        counts = counts.join(counts.groupBy(*by).agg(exact.alias("_all")), by)
    else:
        counts = counts.crossJoin(F.broadcast(counts.agg(exact.alias("_all"))))  # one row
    return counts.withColumn("tpm", F.coalesce(F.try_divide(F.lit(1e6) * F.col("rate"), "_all"), F.lit(0.0))).drop("rate", "_all")


def gap_exclusions(genes: DataFrame, frags: DataFrame, by: list[str], width: int = BIN) -> DataFrame:
    """gene_id, swallowed, by: fragments whose gap strictly holds the gene."""
    gaps = weighed(frags.where("gap_start is not null").select(*by, "gap_start", "gap_end"), [*by, "gap_start", "gap_end"])
    met = overlap_join(gaps, genes.select(*by, "gene_id", "g_start", "g_end"), by, width, ("gap_start", "gap_end"), ("g_start", "g_end")).where(swallowed())
    return _per_gene(genes, met, by, "swallowed")


def inner_gaps(genes: DataFrame, frags: DataFrame, by: list[str], width: int = BIN) -> DataFrame:
    """gene_id, inner, by: gaps that start within the gene, before its end, and end in it."""
    gaps = weighed(frags.where("gap_start is not null").select(*by, "gap_start", "gap_end"), [*by, "gap_start", "gap_end"])
    met = overlap_join(gaps, genes.select(*by, "gene_id", "g_start", "g_end"), by, width, ("gap_start", "gap_end"), ("g_start", "g_end"))
    met = met.where("gap_start >= g_start and gap_start < g_end and gap_end <= g_end")
    return _per_gene(genes, met, by, "inner")


def _per_gene(genes: DataFrame, met: DataFrame, by: list[str], name: str) -> DataFrame:
    """The weights met by each row of genes, 0 where nothing is met."""
    key = [*by, "gene_id", "g_start", "g_end"]
    n = met.groupBy(*key).agg(F.sum("weight").alias(name))
    return genes.select(*key).join(n, key, "left").select("gene_id", F.coalesce(name, F.lit(0).cast("long")).alias(name), *by)
