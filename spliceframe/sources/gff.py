"""GFF3 and GTF lines as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def attribute(text: Column, name: str, gtf: bool = False) -> Column:
    """The value of name in column nine: name=value, or with gtf name "value". Quotes are taken off, a ';' inside quotes belongs to the value; null if absent or empty."""
    pattern = rf"""(?i)(?:^|;)\s*{name}\s+("[^"]*"|[^;]*)""" if gtf else rf"""(?i)(?:^|;)\s*{name}\s*=\s*("[^"]*"|[^;]*)"""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, pattern, 1), '^"|"$', "")), F.lit(""))


def attributes(text: Column) -> Column:
    """All name=value pairs as a map; of a name that repeats the first counts."""
    pairs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.split(F.trim(x), "=", 2)), lambda p: F.size(p) == 2)
    keys = F.array_distinct(F.transform(pairs, lambda p: F.trim(F.get(p, F.lit(0)))))
    first = lambda k: F.get(F.filter(pairs, lambda p: F.trim(F.get(p, F.lit(0))) == k), F.lit(0))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.regexp_replace(F.trim(F.get(first(k), F.lit(1))), '^"|"$', "")))


def once(value: Column, use) -> Column:
    """use(value), value computed once however often it occurs in it."""
    return F.transform(F.array(value), use)[0]


def with_attribute(attrs: Column, name: str, value: Column) -> Column:
    """The map with name set to value: in its place if it is there, else at the end. A null value leaves the map as it is."""
    at = F.lit(name)

    def put(m: Column) -> Column:
        changed = F.when(F.map_contains_key(m, at), F.transform_values(m, lambda k, v: F.when(k == at, value).otherwise(v))).otherwise(F.map_concat(m, F.create_map(at, value)))
        return F.when(value.isNull(), m).otherwise(changed)

    return once(attrs, put)


def without_attribute(attrs: Column, name: str, value: Column | None = None) -> Column:
    """The map without name, or without it only where it has that value."""
    return F.map_filter(attrs, lambda k, v: (k != name) if value is None else ~((k == name) & v.eqNullSafe(value)))


def copied_attributes(attrs: Column, source: Column) -> Column:
    """The map followed by what only source has. A description that the map already holds as its product isn't copied. A null source has nothing."""

    def lacking(m: Column) -> Column:
        twice = lambda k, v: (k == "description") & v.eqNullSafe(F.try_element_at(m, F.lit("product")))
        return F.coalesce(F.map_concat(m, F.map_filter(source, lambda k, v: ~F.map_contains_key(m, k) & ~twice(k, v))), m)

    return once(attrs, lacking)


def attribute_text(attrs: Column) -> Column:
    """Column nine of a GFF3 line from a map, in its order. A value that holds a ';' is put in quotes."""
    pair = lambda e: F.concat(e["key"], F.lit("="), F.when(e["value"].contains(";"), F.concat(F.lit('"'), e["value"], F.lit('"'))).otherwise(e["value"]))
    return F.array_join(F.transform(F.map_entries(attrs), pair), ";")


def kind_of(feature: Column) -> Column:
    """exon, utr, stop, start, cds, intron, gene, transcript or other, by the feature's lower-cased name; the first that fits."""
    t = F.lower(feature)
    codon = t.contains("codon") | t.contains("cds")
    return (
        F.when(t.contains("utr"), "utr")
        .when(t.endswith("exon"), "exon")
        .when(t.contains("stop") & codon, "stop")
        .when(t.contains("start") & codon, "start")
        .when(t == "cds", "cds")
        .when(t.startswith("intron") | t.endswith("intron"), "intron")
        .when(t.endswith("gene") | t.startswith("gene"), "gene")
        .when(t.endswith("rna") | t.endswith("transcript"), "transcript")
        .otherwise("other")
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines(value, ...) -> one row for each feature: seqid, source, type, kind, start, end, score, strand, phase, attrs, id, parents, gene_id, gene_name; other columns of lines stay.

    Skipped: comments, lines under 10 characters or 8 columns, starts or ends that aren't numbers. Reversed ends are swapped. A strand other than + - . gives null."""
    own = [c for c in lines.columns if c != "value"]
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.length("value") >= 10)).withColumn("f", f).where(F.size("f") >= 8)
    a, b = F.get("f", F.lit(3)).try_cast("bigint"), F.get("f", F.lit(4)).try_cast("bigint")
    rows = rows.withColumns({"a": a, "b": b}).where("a is not null and b is not null")
    g = lambda i: F.get("f", F.lit(i))
    strand = F.substring(g(6), 1, 1)
    rows = rows.select(*own, g(0).alias("seqid"), g(1).alias("source"), g(2).alias("type"), kind_of(g(2)).alias("kind"), F.least("a", "b").alias("start"), F.greatest("a", "b").alias("end"), g(5).try_cast("double").alias("score"), F.when(strand.isin("+", "-", "."), strand).alias("strand"), g(7).alias("phase"), F.coalesce(g(8), F.lit("")).alias("attrs"))
    at = F.col("attrs")
    three = F.coalesce(attribute(at, "ID"), attribute(at, "Parent")).isNotNull()
    gene = F.col("kind") == "gene"
    name3 = F.coalesce(*[attribute(at, n) for n in ("gene_name", "geneName", "gene_sym", "gene")], F.when(gene, attribute(at, "Name")))
    id3 = F.coalesce(attribute(at, "geneID"), attribute(at, "gene_id"), F.when(gene, attribute(at, "ID")))
    parents3 = F.when(~gene, F.filter(F.transform(F.split(attribute(at, "Parent"), ","), lambda p: F.trim(p)), lambda p: p != ""))
    tx = attribute(at, "transcript_id", True)
    has_id = attribute(at, "ID").isNotNull()
    return rows.select(
        "*",
        F.when(three, attribute(at, "ID")).otherwise(F.when(F.col("kind") == "transcript", tx).when(gene, attribute(at, "gene_id", True))).alias("id"),
        F.coalesce(F.when(three, parents3).otherwise(F.when(F.col("kind") == "transcript", F.array(attribute(at, "gene_id", True))).when(~gene, F.array(tx))), F.array().cast("array<string>")).alias("parents"),
        F.when(three, F.when(has_id, id3)).otherwise(attribute(at, "gene_id", True)).alias("gene_id"),
        F.when(three, F.when(has_id, name3)).otherwise(attribute(at, "gene_name", True)).alias("gene_name"),
    )


def without_pseudogenes(features: DataFrame) -> DataFrame:
    """Features without pseudogenes (a type that begins with pseudo, or an attribute pseudo... or ispseudo... that begins with t, y or 1) and without locus features that list transcripts."""
    marked = F.col("attrs").rlike(r'(?i)(?:^|;)\s*(?:is)?pseudo[^=;]*=\s*"?[ty1]')
    locus = (F.col("type") == "locus") & F.col("attrs").rlike(r"(?:^|;)\s*transcripts\s*=")
    return features.where(~F.col("type").startswith("pseudo") & ~marked & ~locus)


def locus_order() -> list[Column]:
    """Sort keys of features: contig, start, level (gene, transcript, part), end, id."""
    level = F.when(F.col("kind") == "gene", 0).when(F.col("kind") == "transcript", 1).otherwise(2)
    return [F.col("seqid"), F.col("start"), level, F.col("end"), F.coalesce("id", F.lit(""))]


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()))


def gene_table(features: DataFrame, refs: DataFrame, lengths: DataFrame, length_key: str = "gene_id") -> DataFrame:
    """gene_id, gene_name, ref_id, ref_name, strand, g_start, g_end, length: genes on a known reference that have a length. A missing name is the id.

    refs(ref_name, ref_id), lengths(gene_id, length). length_key: gene_id, or gene_name for tables by name. Rows that repeat an id keep their places, but name, reference name and strand are
    those of the first of them on a known reference: by line_no if features have it, else by place."""
    g = features.where("kind = 'gene' and gene_id is not null").withColumn("gene_name", F.coalesce("gene_name", "gene_id"))
    g = g.join(F.broadcast(refs), g["seqid"] == refs["ref_name"])
    order = F.struct(*[c for c in ("line_no", "ref_id", "start", "end", "gene_name", "strand") if c in g.columns])
    first = g.groupBy("gene_id").agg(F.min_by(F.struct("gene_name", "ref_name", "strand"), order).alias("_first"))
    g = g.join(first, "gene_id").withColumns({c: F.col(f"_first.{c}") for c in ("gene_name", "ref_name", "strand")})
    size = lengths.select(F.col("gene_id").alias("_key"), "length")
    out = g.join(size, F.col(length_key) == F.col("_key"))
    return out.select("gene_id", "gene_name", "ref_id", "ref_name", "strand", F.col("start").alias("g_start"), F.col("end").alias("g_end"), "length")


def tree(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """transcripts(tx_id, gene_id, seqid, strand, start, end), exons(tx_id, seqid, start, end): two levels over parent links, each on one contig and strand.

    A transcript id that stands on several contigs is a transcript on each; of repeats on one contig the least strand and gene count. Exons of
    transcripts without exon features are their coding and untranslated segments; a transcript is shrunk to its exons' span."""
    key = ["tx_id", "seqid"]
    genes = features.where("kind = 'gene'").groupBy(F.col("id").alias("gid"), "seqid").agg(F.min(F.coalesce("gene_id", "id")).alias("gene_id"))
    tx = features.where("kind = 'transcript' and id is not null").select(F.col("id").alias("tx_id"), "seqid", "strand", F.explode_outer("parents").alias("gid"))
    tx = tx.join(genes, ["gid", "seqid"], "left").groupBy(*key).agg(F.min("strand").alias("strand"), F.min("gene_id").alias("gene_id"))
    parts = features.where("kind in ('exon', 'utr', 'cds')").select(F.explode("parents").alias("tx_id"), "seqid", F.col("strand").alias("_strand"), "kind", "start", "end")
    parts = parts.join(tx.select(*key, "strand"), key).where("_strand = strand")
    whole = parts.where("kind = 'exon'").select(*key).distinct()
    exons = parts.where("kind = 'exon'").unionByName(parts.where("kind <> 'exon'").join(whole, key, "left_anti")).select(*key, "start", "end")
    span = exons.groupBy(*key).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return tx.join(span, key).select("tx_id", "gene_id", "seqid", "strand", "start", "end"), exons


def to_gff3() -> Column:
    """A GFF3 line from the parsed columns."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return F.concat_ws("\t", dot("seqid"), dot("source"), dot("type"), dot("start"), dot("end"), dot("score"), dot("strand"), dot("phase"), "attrs")


def to_gtf(tx_id: Column, gene_id: Column) -> Column:
    """A GTF line from the parsed columns: transcript and gene ids, and the gene's name if there is one."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    pair = lambda name, v: F.concat(F.lit(f'{name} "'), v, F.lit('";'))
    ids = F.concat_ws(" ", pair("transcript_id", tx_id), pair("gene_id", gene_id), pair("gene_name", F.col("gene_name")))
    return F.concat_ws("\t", dot("seqid"), dot("source"), dot("type"), dot("start"), dot("end"), dot("score"), dot("strand"), dot("phase"), ids)
