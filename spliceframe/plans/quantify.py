"""Whole runs: alignments and annotation in, gene and event tables out, for one sample or many."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceframe.model import Options
from spliceframe.operators import annotation, expression, fusion, junctions, reads, splicing
from spliceframe.sources import alignments as al
from spliceframe.sources import gff, sinks, tables
from spliceframe.sources.reports import write_reports

KEY = ["sample_id", "ref_id"]


@dataclass
class Result:
    genes: DataFrame
    events: DataFrame
    owners: DataFrame
    junctions: DataFrame
    fusions: DataFrame
    log: DataFrame


def load_alignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Records and reference dictionary of BAM files, SAM text or a Parquet folder that has a refs folder beside it; of BAM files also the samples, as in reads.with_policy()."""
    if ".bam" in path:
        files = al.probe(spark, path)
        return al.read_bam(spark, path, files=files), al.bam_refs(spark, path), al.bam_samples(spark, files)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path), spark.read.parquet(path.rstrip("/").removesuffix(".parquet") + ".refs.parquet"), None
    return al.read_sam(spark, path), al.sam_refs(spark, path), None


def per_sample(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """rows once for each sample: genes or events, dealt out, and the samples' ids, one for each input file."""
    return rows.crossJoin(F.broadcast(samples))


def once(rows: DataFrame) -> DataFrame:
    """rows, written to the checkpoint folder where the session has one, else kept by the executors: what several results read is computed once."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.persist()


def quantify(records: DataFrame, genes: DataFrame, events: DataFrame, opt: Options = Options(), files: DataFrame | None = None, samples: DataFrame | None = None) -> Result:
    """genes as from gff.gene_table(), events as from tables.parse_events(), files as in splicing.first_events(). All counts are by sample; a sample without
    fragments has rows with zero counts. samples(sample_id, unmarked), where the source tells them: then the alignments are decoded once, for the records that are kept for
    pairing; else also for the samples and their first records."""
    frags = once(reads.fragments(records, opt, samples, once))
    rows = reads.fragment_junctions(frags)
    counts = junctions.junction_counts(rows, KEY)
    samples = once(records.select("sample_id").distinct()) if samples is None else samples.select("sample_id").distinct()
    own_genes = per_sample(genes, samples)
    tpm = expression.with_tpm(expression.gene_counts(own_genes, frags, KEY, 16_384), ["sample_id"])
    firsts = splicing.first_events(events, files=files)
    own_events = per_sample(firsts, samples)
    plain = splicing.junction_support(own_events.where("ase_type <> 'RI'"), counts, KEY)
    kept = splicing.retention_support(own_events.where("ase_type = 'RI'"), frags, counts, KEY)
    psi = splicing.with_psi(plain.unionByName(kept))
    owned = splicing.owners(firsts, genes, ["ref_id"])
    fused = fusion.fusion_pairs(own_genes, frags, ["sample_id"], opt.gene_max_gap)
    return Result(tpm, psi, owned, counts, fused, reads.run_log(frags))


def run(spark: SparkSession, gff_path: str, length_path: str, event_files: list[tuple[str, str]], read_path: str, output: str, opt: Options = Options()) -> Result:
    """Reads the files, quantifies, and writes gene, ase, fusion and log tables under output: one ordered file for each sample (and event type), all of a table at once."""
    records, refs, samples = load_alignments(spark, read_path)
    lengths = tables.parse_lengths(tables.lines_of(spark, length_path))
    genes = gff.gene_table(gff.read_gff(spark, gff_path), refs, lengths)
    events = tables.read_events(spark, event_files, refs)
    out = quantify(records, genes, events, opt, spark.createDataFrame([(kind, i) for i, (kind, _) in enumerate(event_files)], "ase_type string, file_idx int"), samples)
    sinks.write_gene_reports(out.genes, f"{output}/gene")
    sinks.write_event_reports(out.events, out.owners, genes, f"{output}/ase", ["sample_id"])
    write_reports(sinks.fusion_rows(out.fusions, genes, ["sample_id"]), f"{output}/fusion", ["sample_id"], ["gene_A", "gene_B", "read_count"])
    sinks.write_tsv(out.log, f"{output}/log")
    return out


def prepare(spark: SparkSession, gff_path: str, output: str) -> None:
    """Gene lines of an annotation, and the length table: each gene's longest transcript."""
    lines = spark.read.text(gff_path)
    sinks.write_gene_lines(lines, f"{output}/gene.annotation.gff3")
    features = gff.parse_lines(lines)
    transcripts, exons = gff.tree(features)
    genes = features.where("kind = 'gene' and gene_id is not null").select("gene_id").distinct()
    sinks.write_lengths(annotation.gene_lengths(genes, transcripts.select("tx_id", "seqid", "gene_id"), exons), f"{output}/length_table.csv")
