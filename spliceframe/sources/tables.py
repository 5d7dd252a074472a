"""Length tables and splicing events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceframe.functions.coords import pair_up, span_max, span_min

_NUMBER = r"^\s*([+-]?\d+)"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """value, line_no of a text file or folder: numbers follow file order within a partition, so they order lines but have gaps."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def parse_lengths(lines: DataFrame) -> DataFrame:
    """gene_id, length from lines(value, line_no) without a header; of a repeated id the first line counts, and lines without a number none."""
    f = F.split("value", ",", 2)
    rows = lines.select(F.get(f, F.lit(0)).alias("gene_id"), F.regexp_extract(F.get(f, F.lit(1)), _NUMBER, 1).try_cast("bigint").alias("length"), "line_no").where("length is not null")
    return rows.groupBy("gene_id").agg(F.min_by("length", "line_no").alias("length"))


def leading_int(text: Column) -> Column:
    """The number at the start of a text, 0 without one."""
    return F.coalesce(F.regexp_extract(text, _NUMBER, 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def parse_events(lines: DataFrame, refs: DataFrame, check_pairs: bool = False) -> DataFrame:
    """lines(value, line_no, ase_type, file_idx), header lines already gone -> ase_id, ase_type, file_idx, line_no, ref_id, strand, e_start, e_end, out, inn.

    Fields: id, chromosome, strand, donor and acceptor of the skipping junction (a mark stands behind each number), the rest of the line the inner
    junctions' places, split at ^ and -. Unknown chromosomes go. On the minus strand the pair is turned and the places reversed. Marks that aren't all
    digits are skipped; with check_pairs an odd number of places raises."""
    f = F.split("value", ",", 6)
    g = lambda i: F.get("f", F.lit(i))
    plus = F.col("strand") == "+"
    cut = lambda c: leading_int(F.left(c, F.length(c) - 1))
    rows = lines.withColumn("f", f).where(F.size("f") == 6)
    rows = rows.select("ase_type", "file_idx", "line_no", g(0).alias("ase_id"), g(1).alias("ref_name"), g(2).alias("strand"), cut(g(3)).alias("d"), cut(g(4)).alias("a"), g(5).alias("rest"))
    rows = rows.join(F.broadcast(refs), "ref_name")  # as in parse_sam()
    places = F.transform(F.filter(F.split("rest", r"[\^-]"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("bigint"))
    rows = rows.withColumn("p", F.when(plus, places).otherwise(F.reverse(places)))
    if check_pairs:
        rows = rows.withColumn("p", F.when(F.size("p") % 2 == 0, F.col("p")).otherwise(F.raise_error("an event has an odd number of inner places")))
    out = F.array(F.when(plus, F.struct(F.col("d").alias("s"), F.col("a").alias("e"))).otherwise(F.struct(F.col("a").alias("s"), F.col("d").alias("e"))))
    rows = rows.withColumns({"out": out, "inn": pair_up(F.col("p"))})
    low = F.least(span_min(F.col("out")), F.coalesce(F.array_min("p"), span_min(F.col("out"))))
    high = F.greatest(span_max(F.col("out")), F.coalesce(F.array_max("p"), span_max(F.col("out"))))
    return rows.select("ase_id", "ase_type", "file_idx", "line_no", "ref_id", "strand", low.alias("e_start"), high.alias("e_end"), "out", "inn")


def read_events(spark: SparkSession, files: list[tuple[str, str]], refs: DataFrame) -> DataFrame:
    """files: (type, path) in the order that counts for repeated ids; each has one header line, its first."""
    all_lines = None
    for i, (kind, path) in enumerate(files):
        # The header is the line that begins its file; a file read in several blocks has one first line.
        raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"), F.col("_metadata.file_block_start").alias("_at"), F.col("_metadata.file_path").alias("_of"))
        heads = raw.where("_at = 0").groupBy("_of").agg(F.min("line_no").alias("_head"))  # one row for each file
        lines = raw.join(F.broadcast(heads), "_of", "left").where("line_no <> _head").select("value", "line_no").withColumns({"ase_type": F.lit(kind), "file_idx": F.lit(i)})
        all_lines = lines if all_lines is None else all_lines.unionByName(lines)
    return parse_events(all_lines, refs)


def sample_list(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_id for each file that a list names, separated by white space; a sample's id is its file's name without the last extension."""
    words = spark.read.text(path).select(F.explode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("path"))
    return words.withColumn("sample_id", sample_id(F.col("path")))


def sample_id(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


