"""Result tables as text: tab-separated with three decimals, one folder for each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceframe.functions.coords import encode
from spliceframe.sources.reports import write_reports


def three(c: str) -> Column:
    """Three decimals, without separators; NaN as nan."""
    return F.when(F.isnan(c), "nan").otherwise(F.format_string("%.3f", F.col(c).cast("double"))).alias(c)


def _gene_columns(tpm: DataFrame) -> list:
    own = [c for c in ("sample_id",) if c in tpm.columns]
    return [*own, "gene_id", "gene_name", F.col("ref_name").alias("reference"), "strand", F.col("g_start").alias("start"), F.col("g_end").alias("end"), F.col("with_junction").alias("reads_with_junction"), F.col("without_junction").alias("reads_without_junction"), F.col("total").alias("total_reads"), three("tpm")]


def gene_rows(tpm: DataFrame) -> DataFrame:
    """In order of reference and start. Range-sorted: each task writes one stretch."""
    own = [c for c in ("sample_id",) if c in tpm.columns]
    return tpm.orderBy(*own, encode(F.col("ref_id"), F.col("g_start"))).select(*_gene_columns(tpm))


def write_gene_reports(tpm: DataFrame, path: str) -> None:
    """One file for each sample, in order of reference and start, then id."""
    rows = tpm.select(*_gene_columns(tpm), encode(F.col("ref_id"), F.col("g_start")).alias("_at"))
    write_reports(rows, path, ["sample_id"], ["_at", "gene_id", "end"], hidden=["_at"])


def write_event_reports(psi: DataFrame, owners: DataFrame, genes: DataFrame, path: str, by: list[str]) -> None:
    """One file for each event type and sample, in order of reference and start, then id."""
    rows = _named_events(psi, owners, genes, []).select(*_event_columns(by), encode(F.col("ref_id"), F.col("e_start")).alias("_at"))
    write_reports(rows, path, by, ["_at", "ase_id"], ["ase_type"], ["_at"])


def names_of(genes: DataFrame) -> DataFrame:
    """gene_id, gene_name: one row for each id. An id that stands in several places has one name from gff.gene_table(); of other tables the least counts."""
    return genes.groupBy("gene_id").agg(F.min("gene_name").alias("gene_name"))


def fusion_rows(fusions: DataFrame, genes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fusion candidates with their genes' names, one row each, in order of both names."""
    by = by or []
    name = lambda x: names_of(genes).select(F.col("gene_id").alias(f"gene_{x}"), F.col("gene_name").alias(f"name_{x}"))
    named = fusions.join(name("a"), "gene_a").join(name("b"), "gene_b")
    return named.select(*by, F.col("name_a").alias("gene_A"), F.col("name_b").alias("gene_B"), F.col("count").alias("read_count")).orderBy(*by, "gene_A", "gene_B")


def _named_events(psi: DataFrame, owners: DataFrame, genes: DataFrame, by: list[str]) -> DataFrame:
    """psi with its genes' ids and names, joined by commas, null where none owns the event."""
    names = owners.select(*by, "ase_id", F.posexplode("genes").alias("i", "gene_id")).join(names_of(genes), "gene_id", "left")
    listed = F.array_sort(F.collect_list(F.struct("i", "gene_id", "gene_name")))
    joined = names.groupBy(*by, "ase_id").agg(listed.alias("x")).select(*by, "ase_id", *[F.array_join(_field("x", c), ",").alias(c) for c in ("gene_id", "gene_name")])
    return psi.join(joined, [*by, "ase_id"], "left")


def _event_columns(by: list[str]) -> list:
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c)
    return ["ase_type", *by, "ase_id", null("gene_id"), null("gene_name"), *[three(c) for c in ("count_in", "count_out", "psi", "psi_lb", "psi_ub")]]


def event_rows(psi: DataFrame, owners: DataFrame, genes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """psi with its genes, in order of reference and start."""
    by = by or []
    return _named_events(psi, owners, genes, by).orderBy("ase_type", *by, encode(F.col("ref_id"), F.col("e_start"))).select(*_event_columns(by))


def _field(array: str, name: str) -> Column:
    return F.transform(array, lambda v: v[name])


def write_tsv(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = rows.write.mode("overwrite").option("sep", "\t").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_lengths(lengths: DataFrame, path: str) -> None:
    lengths.select("gene_id", "length").write.mode("overwrite").csv(path, header=False)


def write_gene_lines(lines: DataFrame, path: str) -> None:
    """The annotation's lines that hold 'gene' before a tab; pseudogenes as well."""
    lines.where(F.col("value").contains("gene\t")).select("value").write.mode("overwrite").text(path)
