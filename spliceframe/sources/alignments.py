"""SAM text as rows of model.ALIGNMENTS, and its reference dictionary. BAM files: bam.py, whose readers can be had from here as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceframe.functions import cigar
from spliceframe.sources.bam import bam_refs, bam_samples, probe, read_bam, scan_bam, write_bam  # noqa: F401
from spliceframe.sources.tables import sample_id


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text files; header lines are left out. '=' as the mate's reference needs no care: only positions are used."""
    lines = spark.read.text(path).select("value", sample_id(F.col("_metadata.file_path")).alias("sample_id"), F.monotonically_increasing_id().alias("ord"))
    return parse_sam(lines, sam_refs(spark, path))


def parse_sam(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """lines(value, sample_id, ord), refs(ref_name, ref_id) -> model.ALIGNMENTS. Header lines and lines of fewer than eleven fields are left out; an unknown reference is -1."""
    f = F.split("value", "\t")
    g = lambda i: F.get("f", F.lit(i))
    rows = lines.where(~F.col("value").startswith("@")).withColumn("f", f).where(F.size("f") >= 11)
    nh = F.regexp_extract(F.array_join(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), "\t"), r"(?:^|\t)NH:i:(\d+)", 1).try_cast("int")
    rows = rows.select(
        "sample_id", "ord", g(0).alias("qname"), g(1).cast("int").alias("flag"), g(2).alias("ref_name"), (g(3).cast("bigint") - 1).alias("pos"), (g(7).cast("bigint") - 1).alias("mpos"),
        g(8).cast("int").alias("isize"), F.when(g(9) == "*", 0).otherwise(F.length(g(9))).cast("int").alias("l_seq"), nh.alias("nh"), cigar.parse(g(5)).alias("cigar"),
    )
    # refs have a header's length; a shuffle would deal all rows by their few names.
    rows = rows.join(F.broadcast(refs), "ref_name", "left").withColumn("ref_id", F.coalesce("ref_id", F.lit(-1)))
    return rows.select("sample_id", "ord", "qname", "flag", "ref_id", "pos", "mpos", "isize", "l_seq", "nh", "cigar")


def sam_refs(spark: SparkSession, path: str) -> DataFrame:
    """ref_name, ref_id from the @SQ lines; all files of one run have the same ones. Without such lines, the names that records have, in order of name."""
    lines = spark.read.text(path)
    sq = lines.where(F.col("value").startswith("@SQ")).select(F.regexp_extract("value", r"\tSN:([^\t]*)", 1).alias("ref_name"), F.monotonically_increasing_id().alias("at"))
    if sq.isEmpty():
        field = F.split("value", "\t")
        named = lines.where(~F.col("value").startswith("@") & (F.size(field) >= 11)).select(F.get(field, F.lit(2)).alias("ref_name")).where("ref_name <> '*'")
        names = named.distinct().withColumn("at", F.col("ref_name"))
    else:
        names = sq.groupBy("ref_name").agg(F.min("at").alias("at"))
    listed = names.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref_name"))), lambda x: x["ref_name"]).alias("names"))  # a header's length, not the data's
    return listed.select(F.posexplode("names").alias("ref_id", "ref_name")).select("ref_name", "ref_id")
