"""Fusion candidates: fragments whose ends fall to different, distant genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceframe.functions.coords import decode_ref, encode
from spliceframe.operators.intervals import as_of


def fusion_pairs(genes: DataFrame, frags: DataFrame, by: list[str], max_gap: int, same_ref_only: bool = False) -> DataFrame:
    """by, gene_a, gene_b, count. genes(by, gene_id, ref_id, g_start, g_end), frags(by, ref_id, start, end).

    Each end belongs to the last gene that starts at or before it on the line of all references, so an end before its chromosome's first gene falls to
    the chromosome before; same_ref_only leaves such pairs out. A pair counts when the genes are more than max_gap apart, or overlap."""
    line = genes.select(*by, encode(F.col("ref_id"), F.col("g_start")).alias("m"), F.struct(encode(F.col("ref_id"), F.col("g_start")).alias("s"), encode(F.col("ref_id"), F.col("g_end")).alias("e"), "gene_id").alias("g"))
    ends = frags.select(*by, encode(F.col("ref_id"), F.col("start")).alias("s"), encode(F.col("ref_id"), F.col("end")).alias("e")).groupBy(*by, "s", "e").agg(F.count("*").alias("n"))
    got = as_of(as_of(ends, line, by, "s", "m", "g", "a"), line, by, "e", "m", "g", "b").where("a is not null and b is not null and a <> b")
    apart = F.col("b.s") - F.col("a.e")
    got = got.where((apart > max_gap) | (apart < 0))
    if same_ref_only:
        got = got.where((decode_ref(F.col("a.s")) == decode_ref(F.col("s"))) & (decode_ref(F.col("b.s")) == decode_ref(F.col("e"))))
    return got.groupBy(*by, F.col("a.gene_id").alias("gene_a"), F.col("b.gene_id").alias("gene_b")).agg(F.sum("n").alias("count"))
