"""Queries of parsers, printers, gene models and file-level rules: their text inputs are built from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spliceframe.model import Options
from spliceframe.operators import annotation, expression, intervals, models, reads, sequences, splicing
from spliceframe.plans import fixtures as fx
from spliceframe.queries import BY, _COUNTS, _MATES, _mates, _records, query
from spliceframe.sources import alignments as al
from spliceframe.sources import fasta, gff, sinks, tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _refs(spark: SparkSession, n: int) -> DataFrame:
    return spark.createDataFrame([(f"chr{i}", i) for i in range(n)], "ref_name string, ref_id int")


#: Feature lines: six types, some with reversed ends, a strand that isn't one, comments and short lines.
_TYPES = "CASE p_partkey % 6 WHEN 0 THEN 'gene' WHEN 1 THEN 'pseudogene' WHEN 2 THEN 'mRNA' WHEN 3 THEN 'exon' WHEN 4 THEN 'CDS' ELSE 'five_prime_UTR' END"
_ENDS = "CASE WHEN p_partkey % 7 = 0 THEN p_partkey * 20 + p_size ELSE p_partkey * 20 END", "CASE WHEN p_partkey % 7 = 0 THEN p_partkey * 20 ELSE p_partkey * 20 + p_size END"
_STRAND = "CASE p_partkey % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '.' ELSE '?' END"
_ATTRS = """CASE p_partkey % 6 WHEN 0 THEN concat('ID=G', p_partkey, ';Name="', p_name, '"') WHEN 1 THEN concat('ID=P', p_partkey, '; gene_id=Q', p_partkey, ';gene_name=', p_brand)
 WHEN 2 THEN concat('ID=T', p_partkey, ';Parent=G', p_partkey - 2, ', G', p_partkey, ';geneID=G', p_partkey - 2) WHEN 3 THEN concat('Parent=T', p_partkey - 1) WHEN 4 THEN concat('ID=C', p_partkey, ';Parent=T', p_partkey - 2)
 ELSE concat('Parent=T', p_partkey - 3) END"""


def _gff_lines(spark, sf_dir) -> DataFrame:
    line = f"concat_ws('\\t', concat('chr', p_partkey % 5), 'src', {_TYPES}, {_ENDS[0]}, {_ENDS[1]}, '.', {_STRAND}, '0', {_ATTRS})"
    return _table(spark, sf_dir, "part").selectExpr("p_partkey AS line_no", f"CASE WHEN p_partkey % 11 = 5 THEN concat('#', {line}) WHEN p_partkey % 11 = 6 THEN 'chr1' ELSE {line} END AS value")


@query(f"""SELECT p_partkey AS line_no, 'chr' || p_partkey % 5 AS seqid, CASE p_partkey % 6 WHEN 0 THEN 'gene' WHEN 1 THEN 'gene' WHEN 2 THEN 'transcript' WHEN 3 THEN 'exon' WHEN 4 THEN 'cds' ELSE 'utr' END AS kind,
 p_partkey * 20 AS start, p_partkey * 20 + p_size AS "end", CASE p_partkey % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '.' END AS strand,
 CASE p_partkey % 6 WHEN 0 THEN 'G' || p_partkey WHEN 1 THEN 'P' || p_partkey WHEN 2 THEN 'T' || p_partkey WHEN 4 THEN 'C' || p_partkey END AS id,
 CASE p_partkey % 6 WHEN 2 THEN 'G' || (p_partkey - 2) || ',G' || p_partkey WHEN 3 THEN 'T' || (p_partkey - 1) WHEN 4 THEN 'T' || (p_partkey - 2) WHEN 5 THEN 'T' || (p_partkey - 3) ELSE '' END AS parents,
 CASE p_partkey % 6 WHEN 0 THEN 'G' || p_partkey WHEN 1 THEN 'Q' || p_partkey WHEN 2 THEN 'G' || (p_partkey - 2) END AS gene_id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_brand END AS gene_name
 FROM part WHERE p_partkey % 11 NOT IN (5, 6)""")
def gff_parse(spark, sf_dir):
    got = gff.parse_lines(_gff_lines(spark, sf_dir))
    return got.select("line_no", "seqid", "kind", "start", "end", "strand", "id", F.array_join("parents", ",").alias("parents"), "gene_id", "gene_name")


@query(f"""SELECT p_partkey AS line_no, 'chr' || p_partkey % 5 || chr(9) || 'src' || chr(9) || {_TYPES} || chr(9) || p_partkey * 20 || chr(9) || (p_partkey * 20 + p_size) || chr(9) || '.' || chr(9)
 || CASE p_partkey % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END || chr(9) || '0' || chr(9) || {_ATTRS} AS line FROM part WHERE p_partkey % 11 NOT IN (5, 6)""")
def gff_print(spark, sf_dir):
    return gff.parse_lines(_gff_lines(spark, sf_dir)).select("line_no", gff.to_gff3().alias("line"))


_GTF_ATTRS = """concat('gene_id "G', p_partkey % 9, '"; transcript_id "T', p_partkey, '"; gene_name "a;', p_brand, '";')"""


@query("""SELECT p_partkey AS line_no, CASE p_partkey % 3 WHEN 0 THEN 'gene' WHEN 1 THEN 'transcript' ELSE 'exon' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'G' || p_partkey % 9 WHEN 1 THEN 'T' || p_partkey END AS id,
 CASE p_partkey % 3 WHEN 1 THEN 'G' || p_partkey % 9 WHEN 2 THEN 'T' || p_partkey ELSE '' END AS parents, 'G' || p_partkey % 9 AS gene_id, 'a;' || p_brand AS gene_name,
 'chr1' || chr(9) || 's' || chr(9) || CASE p_partkey % 3 WHEN 0 THEN 'gene' WHEN 1 THEN 'transcript' ELSE 'exon' END || chr(9) || p_partkey + 1 || chr(9) || p_partkey + 9 || chr(9) || '.' || chr(9) || '+' || chr(9) || '.' || chr(9)
 || 'transcript_id "T' || p_partkey || '"; gene_id "G' || p_partkey % 9 || '"; gene_name "a;' || p_brand || '";' AS line FROM part""")
def gtf_parse_print(spark, sf_dir):
    line = f"concat_ws('\\t', 'chr1', 's', CASE p_partkey % 3 WHEN 0 THEN 'gene' WHEN 1 THEN 'transcript' ELSE 'exon' END, p_partkey + 9, p_partkey + 1, '.', '+', '.', {_GTF_ATTRS})"
    got = gff.parse_lines(_table(spark, sf_dir, "part").selectExpr("p_partkey AS line_no", f"{line} AS value"))
    return got.select("line_no", "kind", "id", F.array_join("parents", ",").alias("parents"), "gene_id", "gene_name", gff.to_gtf(gff.attribute(F.col("attrs"), "transcript_id", True), F.col("gene_id")).alias("line"))


@query("""SELECT p_partkey AS line_no, CAST(2 + CAST(p_partkey % 3 > 0 AS INT) AS INT) AS n, 'i' || p_partkey AS id, 'a=b' AS note, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS brand FROM part""")
def attribute_map(spark, sf_dir):
    text = "concat('ID=i', p_partkey, '; Note=\"a=b\";broken;ID=second', CASE WHEN p_partkey % 3 > 0 THEN concat(';brand = ', p_brand) ELSE '' END)"
    got = _table(spark, sf_dir, "part").selectExpr("p_partkey AS line_no", f"{text} AS t").withColumn("m", gff.attributes(F.col("t")))
    return got.select("line_no", F.size("m").alias("n"), *[F.try_element_at("m", F.lit(k)).alias(c) for k, c in (("ID", "id"), ("Note", "note"), ("brand", "brand"))])


@query("""SELECT t.p_partkey AS line_no, 'ID=T' || t.p_partkey || ';Parent=G' || (t.p_partkey - t.p_partkey % 3) || ';product=' || t.p_brand || CASE WHEN g.p_brand <> t.p_brand THEN ';description=' || g.p_brand ELSE '' END
 || CASE WHEN g.p_size <> 7 THEN ';biotype="b;' || g.p_size || '"' ELSE '' END || ';status=checked' AS attrs FROM part t LEFT JOIN part g ON g.p_partkey = t.p_partkey - t.p_partkey % 3 WHERE t.p_partkey % 3 <> 0""")
def attribute_edits(spark, sf_dir):
    gene, top = "p_partkey % 3 = 0", "concat('G', p_partkey - p_partkey % 3)"
    attrs = f"if({gene}, concat('ID=', {top}, ';description=', p_brand, ';biotype=b:', p_size, ';status=raw;note=n'), concat('ID=T', p_partkey, ';Parent=', {top}, ';product=', p_brand, if(p_partkey % 2 = 0, ';note=mine', '')))"
    features = _table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS line_no", f"if({gene}, 'gene', 'transcript') AS kind", f"if({gene}, {top}, concat('T', p_partkey)) AS id", f"if({gene}, array(), array({top})) AS parents",
        "'chr1' AS seqid", "'+' AS strand", "p_partkey * 20 AS start", f"p_partkey * 20 + if({gene}, 100, 10) AS end", f"{attrs} AS attrs",
    )
    got = models.with_copied_attributes(features).where("kind = 'transcript'")
    m = gff.without_attribute(gff.without_attribute(F.col("attributes"), "note"), "biotype", F.lit("b:7"))
    m = F.transform_values(gff.without_attribute(m, "status"), lambda k, v: F.when(k == "biotype", F.regexp_replace(v, ":", ";")).otherwise(v))
    return got.select("line_no", gff.attribute_text(gff.with_attribute(m, "status", F.lit("checked"))).alias("attrs"))


@query("""l AS (SELECT p_partkey % 50 AS k, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END AS n, p_partkey AS line FROM part) SELECT 'G' || k AS gene_id, CAST(arg_min(n, line) AS BIGINT) AS length FROM l WHERE n IS NOT NULL GROUP BY 1""")
def length_table(spark, sf_dir):
    value = "concat('G', p_partkey % 50, ',', CASE WHEN p_partkey % 13 = 0 THEN 'none' ELSE concat(' ', p_size, 'bp,rest') END)"
    return tables.parse_lengths(_table(spark, sf_dir, "part").selectExpr("p_partkey AS line_no", f"{value} AS value"))


_PLACES = "l_partkey * 20 + 10", "l_partkey * 20 + 20", "l_partkey * 20 + 30", "l_partkey * 20 + 40"


@query("""SELECT l_orderkey * 10 + l_linenumber AS line_no, CAST(l_partkey % 5 AS INT) AS ref_id, p + 5 AS e_start, p + 60 AS e_end, CASE WHEN plus THEN (p + 5) || '-' || (p + 60) ELSE (p + 5) || '-' || (p + 60) END AS out,
 CASE WHEN two AND plus THEN (p + 10) || '-' || (p + 20) || ',' || (p + 30) || '-' || (p + 40) WHEN two THEN (p + 10) || '-' || (p + 20) || ',' || (p + 30) || '-' || (p + 40) ELSE (p + 10) || '-' || (p + 20) END AS inn
 FROM (SELECT *, l_partkey * 20 AS p, l_suppkey % 2 = 0 AS plus, l_suppkey % 3 > 0 AS two FROM lineitem WHERE l_partkey % 5 < 4)""")
def ase_parse(spark, sf_dir):
    a, b, c, d = _PLACES
    inner = f"CASE WHEN l_suppkey % 2 = 0 THEN concat({a}, '^', {b}, '-', CASE WHEN l_suppkey % 3 > 0 THEN concat({c}, '^x^', {d}, '-') ELSE '' END) ELSE concat(CASE WHEN l_suppkey % 3 > 0 THEN concat({d}, '^', {c}, '-') ELSE '' END, {b}, '^', {a}, '-') END"
    ends = "CASE WHEN l_suppkey % 2 = 0 THEN concat(l_partkey * 20 + 5, '^,', l_partkey * 20 + 60, '-') ELSE concat(l_partkey * 20 + 60, '^,', l_partkey * 20 + 5, '-') END"
    value = f"concat_ws(',', concat('E', l_orderkey), concat('chr', l_partkey % 5), CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END, {ends}, {inner})"
    lines = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS line_no", "'SE' AS ase_type", "0 AS file_idx", f"{value} AS value")
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ",").alias(c)
    return tables.parse_events(lines, _refs(spark, 4)).select("line_no", "ref_id", "e_start", "e_end", spans("out"), spans("inn"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS ord, 's' || l_suppkey % 3 AS sample_id, 'q' || l_orderkey AS qname, CAST(l_partkey % 300 AS INT) AS flag, CAST(CASE WHEN l_partkey % 6 < 5 THEN l_partkey % 6 ELSE -1 END AS INT) AS ref_id,
 l_partkey * 20 - 1 AS pos, l_partkey * 20 + 39 AS mpos, CAST(l_linenumber - 3 AS INT) AS isize, CAST(CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE l_linenumber * 3 END AS INT) AS l_seq, CAST(CASE WHEN l_suppkey % 5 > 0 THEN l_partkey % 3 + 1 ELSE -1 END AS INT) AS nh,
 CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '5S20M100N25M' WHEN 2 THEN '50M' ELSE '3H12=5D20X' END AS cigar FROM lineitem WHERE l_partkey % 17 > 0""")
def sam_parse(spark, sf_dir):
    text = "CASE l_linenumber % 4 WHEN 0 THEN '*' WHEN 1 THEN '5S20M100N25M' WHEN 2 THEN '50M' ELSE '3H12=5D20X' END"
    line = f"""concat_ws('\\t', concat('q', l_orderkey), l_partkey % 300, concat('chr', l_partkey % 6), l_partkey * 20, 60, {text}, '=', l_partkey * 20 + 40, l_linenumber - 3,
      CASE WHEN l_suppkey % 4 = 0 THEN '*' ELSE repeat('ACG', l_linenumber) END, '*', 'XN:Z:NH:i:9', CASE WHEN l_suppkey % 5 > 0 THEN concat('NH:i:', l_partkey % 3 + 1) END)"""
    lines = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS ord", "concat('s', l_suppkey % 3) AS sample_id", f"CASE WHEN l_partkey % 17 = 0 THEN '@CO\\tx' ELSE {line} END AS value")
    shown = F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    return al.parse_sam(lines, _refs(spark, 5)).withColumns({"cigar": shown, "nh": F.coalesce("nh", F.lit(-1))})


@query("SELECT s_suppkey, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS sample_id FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '/data/run.' || s_suppkey || '/a' || s_suppkey || '.sorted.bam' WHEN 1 THEN 'b' || s_suppkey ELSE 's3://x/c' || s_suppkey || '.sam' END AS path FROM supplier)")
def sample_names(spark, sf_dir):
    path = "CASE s_suppkey % 3 WHEN 0 THEN concat('/data/run.', s_suppkey, '/a', s_suppkey, '.sorted.bam') WHEN 1 THEN concat('b', s_suppkey) ELSE concat('s3://x/c', s_suppkey, '.sam') END"
    return _table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{path} AS path").select("s_suppkey", tables.sample_id(F.col("path")).alias("sample_id"))


def _gene_features(spark, sf_dir) -> DataFrame:
    """Genes of which ids repeat, some on references that the header doesn't have."""
    return _table(spark, sf_dir, "part").selectExpr("p_partkey AS line_no", "'gene' AS kind", "concat('G', p_partkey % 700) AS gene_id", "CASE WHEN p_partkey % 3 > 0 THEN concat(p_name, p_partkey) END AS gene_name", "concat('chr', p_partkey % 5) AS seqid",
                                                 "CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand", "p_partkey * 20 AS start", "p_partkey * 20 + p_size AS end")


@query("""f AS (SELECT p_partkey AS k, 'G' || p_partkey % 700 AS gene_id, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_name || p_partkey END, 'G' || p_partkey % 700) AS gene_name, p_partkey % 5 AS r, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
 p_partkey * 20 AS g_start, p_partkey * 20 + p_size AS g_end FROM part WHERE p_partkey % 5 < 4), a AS (SELECT gene_id, arg_min(gene_name, k) AS n, arg_min(r, k) AS c, arg_min(strand, k) AS s FROM f GROUP BY 1)
SELECT gene_id, a.n AS gene_name, CAST(r AS INT) AS ref_id, 'chr' || c AS ref_name, a.s AS strand, g_start, g_end, CAST(substr(gene_id, 2) AS BIGINT) + 7 AS length FROM f JOIN a USING (gene_id) WHERE CAST(substr(gene_id, 2) AS BIGINT) % 9 > 0""")
def gene_table(spark, sf_dir):
    lengths = spark.range(700).where("id % 9 > 0").selectExpr("concat('G', id) AS gene_id", "id + 7 AS length")
    return gff.gene_table(_gene_features(spark, sf_dir), _refs(spark, 4), lengths)


def _model_features(spark, sf_dir) -> DataFrame:
    """Genes, transcripts whose ids stand on two contigs, and exons of which some lie on the other strand; every fifth transcript has coding segments only."""
    nil = "CAST(array() AS array<string>)"
    genes = spark.range(40).selectExpr("'gene' AS kind", "concat('G', id) AS id", f"{nil} AS parents", "concat('H', id) AS gene_id", "concat('chr', id % 2) AS seqid", "'+' AS strand", "0L AS start", "1L AS end")
    tx = spark.range(400).selectExpr("'transcript'", "concat('T', id div 2)", "array(concat('G', id % 50))", "CAST(NULL AS string)", "concat('chr', id % 2)", "CASE WHEN id div 2 % 3 = 0 THEN '-' ELSE '+' END", "0L", "1L")
    kind = "CASE WHEN l_orderkey % 200 % 5 = 0 THEN 'cds' WHEN l_suppkey % 4 = 0 THEN 'utr' ELSE 'exon' END"
    exons = _table(spark, sf_dir, "lineitem").selectExpr(kind, "CAST(NULL AS string)", "array(concat('T', l_orderkey % 200))", "CAST(NULL AS string)", "concat('chr', l_linenumber % 2)", "CASE WHEN l_orderkey % 200 % 3 = 0 THEN '-' WHEN l_suppkey % 7 = 0 THEN '-' ELSE '+' END", "l_partkey * 20", "l_partkey * 20 + CAST(l_quantity AS bigint)")
    return genes.union(tx).union(exons)


_TREE = """x AS (SELECT l_orderkey % 200 AS t, l_linenumber % 2 AS c, l_partkey * 20 AS s, l_partkey * 20 + CAST(l_quantity AS BIGINT) AS e FROM lineitem WHERE (l_orderkey % 200 % 3 = 0 OR l_suppkey % 7 > 0) AND (l_orderkey % 200 % 5 = 0 OR l_suppkey % 4 > 0)),
m AS (SELECT t, c, CASE WHEN (2 * t + c) % 50 < 40 THEN 'H' || (2 * t + c) % 50 END AS gene_id FROM (SELECT DISTINCT t, c FROM x))"""


@query(f"""{_TREE} SELECT 'T' || t AS tx_id, any_value(gene_id) AS gene_id, 'chr' || c AS seqid, CASE WHEN t % 3 = 0 THEN '-' ELSE '+' END AS strand, min(s) AS start, max(e) AS "end" FROM x JOIN m USING (t, c) GROUP BY t, c""")
def transcript_tree(spark, sf_dir):
    return gff.tree(_model_features(spark, sf_dir))[0]


@query(f"""{_TREE}, o AS (SELECT *, max(e) OVER (PARTITION BY t, c ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY t, c ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM o),
r AS (SELECT t, c, isle, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2, 3), n AS (SELECT t, c, sum(e - s) AS n FROM r GROUP BY 1, 2) SELECT 'H' || g AS gene_id, CAST(coalesce(max(n), 0) AS BIGINT) AS length FROM range(40) z(g) LEFT JOIN m ON m.gene_id = 'H' || g LEFT JOIN n USING (t, c) GROUP BY 1""")
def prepared_lengths(spark, sf_dir):
    transcripts, exons = gff.tree(features := _model_features(spark, sf_dir))
    genes = features.where("kind = 'gene'").select("gene_id")
    return annotation.gene_lengths(genes, transcripts.select("tx_id", "seqid", "gene_id"), exons)


@query("""x AS (SELECT l_orderkey AS t, l_partkey * 20 AS s, l_partkey * 20 + CAST(l_quantity AS BIGINT) * 8 AS e FROM lineitem), o AS (SELECT *, max(e) OVER (PARTITION BY t ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM o), r AS (SELECT t, isle, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2), n AS (SELECT *, lead(s) OVER (PARTITION BY t ORDER BY s) AS nxt FROM r)
SELECT t AS tx_id, min(s) AS start, max(e) AS "end", coalesce(string_agg((e + 1) || '-' || (nxt - 1), ',' ORDER BY s) FILTER (WHERE nxt IS NOT NULL), '') AS introns FROM n GROUP BY 1""")
def intron_chains(spark, sf_dir):
    exons = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS tx_id", "l_partkey * 20 AS start", "l_partkey * 20 + CAST(l_quantity AS bigint) * 8 AS end")
    got = annotation.intron_chains(exons, ["tx_id"])
    return got.select("tx_id", "start", "end", F.array_join(F.transform("introns", lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ",").alias("introns"))


@query("""x AS (SELECT DISTINCT l_orderkey AS t, l_partkey * 20 AS s, CASE WHEN l_orderkey % 2 = 0 THEN '-' ELSE '+' END AS strand, l_partkey % 90 + 1 AS n FROM lineitem),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY t ORDER BY CASE WHEN strand = '-' THEN -(s + n - 1) ELSE s END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x) SELECT t AS tx_id, s AS start, CAST((3 - b % 3) % 3 AS INT) AS phase FROM o""")
def cds_phases(spark, sf_dir):
    cds = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS tx_id", "l_partkey * 20 AS start", "l_partkey * 20 + l_partkey % 90 AS end", "CASE WHEN l_orderkey % 2 = 0 THEN '-' ELSE '+' END AS strand").distinct()
    return annotation.cds_phases(cds, ["tx_id"]).select("tx_id", "start", "phase")


_DNA = "translate(CAST(p_partkey * 7919 * 104729 + p_size * 15485863 AS STRING), '0123456789', 'ACGTTRYAGN')"

@query(f"""k AS (SELECT x || y || z AS c, substr('{annotation.CODE}', 16 * (instr('TCAG', x) - 1) + 4 * (instr('TCAG', y) - 1) + instr('TCAG', z), 1) AS a FROM (SELECT unnest(['T','C','A','G']) AS x), (SELECT unnest(['T','C','A','G']) AS y), (SELECT unnest(['T','C','A','G']) AS z)),
s AS (SELECT p_partkey, {_DNA.replace('STRING', 'VARCHAR')} AS seq FROM part), u AS (SELECT p_partkey, i, substr(seq, 3 * i - 2, 3) AS c FROM s, range(1, 9) t(i) WHERE 3 * i <= len(seq)),
d AS (SELECT c, regexp_replace(regexp_replace(regexp_replace(c, 'R', '[AG]', 'g'), 'Y', '[CT]', 'g'), 'N', '.', 'g') AS p FROM (SELECT DISTINCT c FROM u)),
m AS (SELECT d.c, list_sort(list(DISTINCT k.a)) AS aa FROM d JOIN k ON regexp_matches(k.c, '^' || d.p || '$') GROUP BY 1), e AS (SELECT c, CASE WHEN len(aa) = 1 THEN aa[1] WHEN aa = ['D', 'N'] THEN 'B' WHEN aa = ['E', 'Q'] THEN 'Z' ELSE 'X' END AS a FROM m),
j AS (SELECT p_partkey, string_agg(a, '' ORDER BY i) AS protein FROM u JOIN e USING (c) GROUP BY 1) SELECT p_partkey, coalesce(protein, '') AS protein, reverse(translate(seq, '{annotation.LETTERS}', '{annotation.COMPLEMENTS}')) AS other FROM s LEFT JOIN j USING (p_partkey)""")
def translate_revcomp(spark, sf_dir):
    return _table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_DNA} AS seq").select("p_partkey", annotation.translate(F.col("seq")).alias("protein"), annotation.reverse_complement(F.col("seq")).alias("other"))


_PAIRS = f"""{_MATES} SELECT ref_id, least(s1, s2) AS start, greatest(e1, e2) AS "end", count(*) AS n FROM m WHERE {{}} GROUP BY ALL"""


def _fragment_counts(spark, sf_dir, opt: Options) -> DataFrame:
    return reads.fragments(_mates(spark, sf_dir), opt).groupBy("ref_id", "start", "end").agg(F.count("*").alias("n"))


@query(_PAIRS.format("NOT (c % 2 <> 0 AND c % 3 = 0)"))
def strand_filter(spark, sf_dir):
    return _fragment_counts(spark, sf_dir, Options(strandness=2))


@query(_PAIRS.format("NOT coalesce(e1 < s2 AND s2 - e1 > 15, false)"))
def gap_filter(spark, sf_dir):
    return _fragment_counts(spark, sf_dir, Options(max_gap=15))


@query(f"""{_MATES} SELECT 's' AS sample_id, CAST(0 AS BIGINT) + count(*) FILTER (WHERE r = 0) AS with_junctions, count(*) FILTER (WHERE r <> 0) AS without_junctions, CAST(sum(CASE WHEN r <> 0 THEN 0 WHEN c % 5 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS junctions FROM m""")
def run_log(spark, sf_dir):
    return reads.run_log(reads.fragments(_mates(spark, sf_dir)))


@query("""r AS (SELECT 's' || l_orderkey % 2 AS sample_id, CASE WHEN l_orderkey % 2 = 1 THEN l_partkey % 3 + 1 END AS nh, l_suppkey % 11 = 0 AS sec, l_suppkey % 3 = 0 AS proper, l_partkey % 13 > 0 AND l_partkey % 6 > 0 AS ok FROM lineitem)
SELECT sample_id, count(*) AS n FROM r WHERE ok AND CASE WHEN sample_id = 's0' THEN NOT sec OR proper ELSE NOT sec AND nh <= 1 END GROUP BY 1""")
def nh_absent(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("k", F.substring("qname", 2, 20).cast("long") % 2)
    rows = rows.withColumn("sample_id", F.concat(F.lit("s"), F.col("k").cast("string"))).withColumn("nh", F.when(F.col("k") == 1, (F.col("pos") / 20).cast("int") % 3 + 1))
    return reads.with_policy(rows, Options()).where("keep").groupBy("sample_id").agg(F.count("*").alias("n"))


@query("""SELECT CAST(l_partkey % 6 - 1 AS INT) AS ref_id, l_partkey * 20 + 1 AS start, l_partkey * 20 + 1 + CASE l_linenumber % 4 WHEN 0 THEN 50 WHEN 1 THEN 145 WHEN 2 THEN 118 ELSE 37 END AS "end", CAST(CASE l_linenumber % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS INT) AS n_junctions, count(*) AS n
FROM lineitem WHERE l_partkey % 6 > 0 AND l_partkey % 13 > 0 AND l_suppkey % 11 > 0 GROUP BY ALL""")
def single_end(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("flag", F.col("flag").bitwiseAND(~193))
    return reads.fragments(rows, Options(mode=1, multi=True, primary=True)).groupBy("ref_id", "start", "end", F.size("js").alias("n_junctions")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, f.ref_id, f.f_start, coalesce(g.gene_id, -1) AS gene_id FROM fragments f ASOF LEFT JOIN genes g ON f.ref_id = g.ref_id AND f.f_start >= g.g_start""")
def last_gene_before(spark, sf_dir):
    points, marks = fx.fragments(spark, sf_dir).select("ref_id", "l_orderkey", "l_linenumber", F.col("start").alias("f_start")), fx.genes(spark, sf_dir).select("ref_id", "g_start", "gene_id")
    got = intervals.as_of(points, marks, BY, "f_start", "g_start", "gene_id", "gene", 1 << 12)
    return got.select("ref_id", "l_orderkey", "l_linenumber", "f_start", F.coalesce("gene", F.lit(-1)).alias("gene_id"))


@query("""f AS (SELECT *, 's' || l_linenumber % 2 AS sample_id FROM fragments) SELECT s.sample_id, g.gene_id, count(f.f_start) AS swallowed FROM genes g CROSS JOIN (SELECT unnest(['s0', 's1']) AS sample_id) s
 LEFT JOIN f ON g.ref_id = f.ref_id AND s.sample_id = f.sample_id AND f.gap_start < g.g_start AND f.gap_end > g.g_end GROUP BY 1, 2""".replace("f AS (SELECT *", "h AS (SELECT *").replace("LEFT JOIN f ON", "LEFT JOIN h f ON"))
def gap_exclusions_by_sample(spark, sf_dir):
    frags = fx.fragments(spark, sf_dir).withColumn("sample_id", F.concat(F.lit("s"), (F.col("l_linenumber") % 2).cast("string")))
    genes = fx.genes(spark, sf_dir).withColumn("sample_id", F.explode(F.array(F.lit("s0"), F.lit("s1"))))
    return expression.gap_exclusions(genes, frags, ["sample_id", "ref_id"]).select("sample_id", "gene_id", "swallowed")


@query("""r AS (SELECT ase_id, 'T' || (ase_id % 3) AS ase_type, CAST(ase_id % 7 AS INT) AS file_idx, out_start AS line_no FROM events_raw), d AS (SELECT *, row_number() OVER (PARTITION BY ase_id ORDER BY file_idx, line_no) AS n FROM r)
SELECT ase_id, ase_type, file_idx, line_no FROM d WHERE n = 1 AND file_idx = CASE ase_type WHEN 'T0' THEN 2 WHEN 'T1' THEN 4 END""")
def first_file_of_a_type(spark, sf_dir):
    rows = fx.raw_events(spark, sf_dir, True).selectExpr("ase_id", "concat('T', ase_id % 3) AS ase_type", "CAST(ase_id % 7 AS INT) AS file_idx", "e_start AS line_no")
    files = spark.createDataFrame([("T0", 2), ("T0", 5), ("T1", 4), ("T2", 99)], "ase_type string, file_idx int")
    return splicing.first_events(rows, files=files).select("ase_id", "ase_type", "file_idx", "line_no")


@query(f"""{_COUNTS}, t AS (SELECT g.*, c.with_junction AS w, c.without_junction AS o FROM genes g JOIN c USING (gene_id))
SELECT CAST(gene_id AS VARCHAR) || chr(9) || gene_name || chr(9) || 'chr' || ref_id || chr(9) || strand || chr(9) || g_start || chr(9) || g_end || chr(9) || w || chr(9) || o || chr(9) || (w + o) || chr(9) || printf('%.3f', (w + o) / 8.0) AS line FROM t""")
def gene_lines(spark, sf_dir):
    counts = expression.gene_counts(fx.genes(spark, sf_dir), fx.fragments(spark, sf_dir), BY).withColumns({"tpm": F.col("total") / 8, "ref_name": F.concat(F.lit("chr"), F.col("ref_id").cast("string"))})
    rows = sinks.gene_rows(counts)
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("line"))


@query(f"""w AS ({fx.GENES.format(w=30)}), m AS (SELECT e.ase_id, w.g_start, w.gene_id, w.gene_name FROM events e JOIN w ON w.ref_id = e.ref_id AND e.out_start >= w.g_start AND e.out_start < w.g_end AND e.out_end <= w.g_end), k AS (SELECT *, row_number() OVER (PARTITION BY ase_id ORDER BY g_start) AS n FROM m),
l AS (SELECT ase_id, string_agg(CAST(gene_id AS VARCHAR), ',' ORDER BY g_start) AS i, string_agg(gene_name, ',' ORDER BY g_start) AS g FROM k WHERE n <= 5 GROUP BY 1)
SELECT 'SE' AS ase_type, ase_id, coalesce(i, 'null') AS gene_id, coalesce(g, 'null') AS gene_name, printf('%.3f', ase_id % 4 / 4.0) AS count_in, printf('%.3f', ase_id % 8 / 8.0) AS count_out, CASE WHEN ase_id % 3 = 0 THEN 'nan' ELSE '0.500' END AS psi, '0.000' AS psi_lb, '1.000' AS psi_ub FROM events LEFT JOIN l USING (ase_id)""")
def event_lines(spark, sf_dir):
    genes, events = fx.genes(spark, sf_dir, wide=True), fx.events(spark, sf_dir)
    psi = events.withColumns({"ase_type": F.lit("SE"), "count_in": F.col("ase_id") % 4 / 4, "count_out": F.col("ase_id") % 8 / 8, "psi": F.when(F.col("ase_id") % 3 == 0, F.lit(float("nan"))).otherwise(0.5), "psi_lb": F.lit(0.0), "psi_ub": F.lit(1.0)})
    return sinks.event_rows(psi, splicing.owners(events, genes, BY), genes)


#: Exons of transcripts in blocks of 16, of which some share structures: the same places, some shifted.
_AT = "CAST(floor(l_orderkey / 16) AS BIGINT) * 2000 + CAST(floor(l_orderkey % 16 / 4) AS BIGINT) * 250 + l_linenumber * 50 + CASE WHEN l_suppkey % 5 = 0 THEN 3 ELSE 0 END"
_EXONS = f"x AS (SELECT l_orderkey AS t, CASE WHEN l_orderkey % 2 = 0 THEN '-' ELSE '+' END AS strand, {_AT} AS s, {_AT} + 20 + l_partkey % 3 * 10 AS e FROM lineitem)"


def _blocks(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS tx_id", "CASE WHEN l_orderkey % 2 = 0 THEN '-' ELSE '+' END AS strand", f"{_AT} AS start", f"{_AT} + 20 + l_partkey % 3 * 10 AS end")


@query(f"""SELECT strand, t AS tx_id, min(u) AS locus FROM (WITH RECURSIVE {_EXONS}, p AS (SELECT DISTINCT a.strand, a.t, b.t AS u FROM x a JOIN x b ON a.strand = b.strand AND a.s <= b.e AND b.s <= a.e),
 r AS (SELECT * FROM p UNION SELECT r.strand, r.t, p.u FROM r JOIN p ON p.strand = r.strand AND p.t = r.u) SELECT * FROM r) GROUP BY 1, 2""")
def exon_loci(spark, sf_dir):
    return annotation.exon_loci(_blocks(spark, sf_dir), ["strand"], "tx_id")


_RUNS = f"""{_EXONS}, o AS (SELECT *, max(e) OVER (PARTITION BY t ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM o), m AS (SELECT strand, t, isle, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2, 3)"""


@query(f"""{_RUNS}, n AS (SELECT *, lead(s) OVER (PARTITION BY t ORDER BY s) AS nxt FROM m),
c AS (SELECT strand, t, min(s) AS s, max(e) AS e, coalesce(list({{s: e + 1, e: nxt - 1}} ORDER BY s) FILTER (WHERE nxt IS NOT NULL), []) AS i, coalesce(string_agg(',' || (e + 1) || '-' || (nxt - 1), '' ORDER BY s) FILTER (WHERE nxt IS NOT NULL), '') || ',' AS k FROM n GROUP BY 1, 2)
SELECT a.strand, a.t AS a, b.t AS b, CASE WHEN len(a.i) = 0 AND len(b.i) = 0 THEN (least(a.e, b.e) - greatest(a.s, b.s) + 1) * 10 >= (greatest(a.e - a.s, b.e - b.s) + 1) * 8 ELSE a.k = b.k END AS same,
 a.s >= b.s AND a.e <= b.e AND CASE WHEN len(a.i) = 0 THEN len(list_filter(b.i, lambda v: v.s <= a.e AND v.e >= a.s)) = 0 ELSE contains(b.k, a.k) END AS within
FROM c a JOIN c b ON a.strand = b.strand AND a.t <> b.t AND a.s <= b.e AND b.s <= a.e""")
def transcript_matches(spark, sf_dir):
    exons = _blocks(spark, sf_dir)
    tasks = intervals.tasks_for(exons)
    chains = annotation.intron_chains(intervals.dealt(exons, tasks, "strand", "tx_id"), ["strand", "tx_id"])
    return annotation.transcript_matches(chains, ["strand"], "tx_id", tasks)


@query(f"""{_RUNS}, g AS (SELECT t, strand, min(s) + t % 150 AS c0, max(e) - t % 70 AS c1, t % 4 AS phase FROM m GROUP BY 1, 2),
j AS (SELECT g.*, b, unnest(range(m.s, m.e + 1)) AS pos FROM g JOIN (SELECT *, 1 AS b FROM m) m USING (t)),
n AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY CASE WHEN strand = '-' THEN -pos ELSE pos END) AS place FROM j), k AS (SELECT *, CASE WHEN phase IN (1, 2) THEN phase ELSE 0 END AS skip FROM n)
SELECT t AS tx_id, c0 + CASE WHEN strand = '+' THEN skip ELSE 0 END AS cds_start, c1 - CASE WHEN strand = '-' THEN skip ELSE 0 END AS cds_end,
 coalesce(max(place + skip) FILTER (WHERE pos = CASE WHEN strand = '-' THEN c1 ELSE c0 END), 0) AS mrna_start, coalesce(max(place) FILTER (WHERE pos = CASE WHEN strand = '-' THEN c0 ELSE c1 END), 0) AS mrna_end FROM k GROUP BY t, strand, c0, c1, skip""")
def cds_coordinates(spark, sf_dir):
    exons = annotation.merged_exons(_blocks(spark, sf_dir), ["tx_id", "strand"])
    cds = exons.groupBy("tx_id").agg((F.min("start") + F.col("tx_id") % 150).alias("c_start"), (F.max("end") - F.col("tx_id") % 70).alias("c_end")).withColumn("phase", F.col("tx_id") % 4)
    return annotation.cds_coordinates(exons, cds, ["tx_id"])


@query("""SELECT p_partkey AS line_no FROM part WHERE p_partkey % 5 <> 1 AND NOT (p_partkey % 5 = 2 AND p_partkey % 3 = 0) AND NOT (p_partkey % 5 = 3 AND p_partkey % 3 < 2) AND NOT (p_partkey % 5 = 4 AND p_partkey % 3 = 1)""")
def pseudogene_filter(spark, sf_dir):
    kind = "CASE p_partkey % 5 WHEN 1 THEN 'pseudogene' WHEN 4 THEN 'locus' ELSE 'gene' END"
    attrs = "CASE p_partkey % 5 WHEN 2 THEN concat('ID=a;pseudo=', element_at(array('true', 'no', 'false'), CAST(p_partkey % 3 AS INT) + 1)) WHEN 3 THEN concat('IsPseudogene=\"', element_at(array('Yes', '1', '0'), CAST(p_partkey % 3 AS INT) + 1), '\";ID=b') WHEN 4 THEN CASE WHEN p_partkey % 3 = 1 THEN 'ID=c;transcripts=t1,t2' ELSE 'ID=c;note=pseudo' END ELSE 'ID=d' END"
    lines = _table(spark, sf_dir, "part").selectExpr("p_partkey AS line_no", f"concat_ws('\\t', 'chr1', 's', {kind}, p_partkey, p_partkey + 9, '.', '+', '.', {attrs}) AS value")
    return gff.without_pseudogenes(gff.parse_lines(lines)).select("line_no")


@query("""SELECT p_partkey AS line_no, 'chr' || p_partkey % 5 AS seqid, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey % 40, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, p_partkey % 40 + p_size, 'i' || p_partkey) AS place FROM part""")
def locus_order(spark, sf_dir):
    line = "concat_ws('\\t', concat('chr', p_partkey % 5), 's', CASE p_partkey % 3 WHEN 0 THEN 'gene' WHEN 1 THEN 'mRNA' ELSE 'exon' END, p_partkey % 40, p_partkey % 40 + p_size, '.', '+', '.', concat('ID=i', p_partkey))"
    got = gff.parse_lines(_table(spark, sf_dir, "part").selectExpr("p_partkey AS line_no", f"{line} AS value"))
    return got.select("line_no", "seqid", F.row_number().over(Window.partitionBy("seqid").orderBy(*gff.locus_order())).cast("long").alias("place"))


@query(f"""{_MATES} SELECT 's' AS sample_id, count(*) FILTER (WHERE r = 0) * 2 AS with_junctions, count(*) FILTER (WHERE r <> 0) * 2 AS without_junctions FROM m""")
def mate_log(spark, sf_dir):
    return reads.mate_log(reads.adjacent_mates(_mates(spark, sf_dir), Options()))


@query(f"""g AS (SELECT ref_id, gene_name, g_start, sum(CASE WHEN reach IS NULL OR g_start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id ORDER BY g_start, g_end ROWS UNBOUNDED PRECEDING) AS locus FROM
 (SELECT *, max(g_end) OVER (PARTITION BY ref_id ORDER BY g_start, g_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM genes)) SELECT ref_id, CAST(locus AS BIGINT) AS locus, upper(gene_name) AS name, count(*) AS n FROM g GROUP BY ALL""")
def locus_names(spark, sf_dir):
    tx = fx.genes(spark, sf_dir).selectExpr("ref_id", "gene_name", "g_start AS start", "g_end AS end")
    return annotation.locus_names(annotation.loci(tx, BY), BY).withColumn("locus", F.col("locus").cast("long"))


@query(f"""{_EXONS}, q AS (SELECT DISTINCT t, strand, s % 2000 + 1 AS s, e - s AS n FROM x), j AS (SELECT t, strand, string_agg(substr(repeat('ACGTRGTTCA', 300), s, n + 1), '' ORDER BY s, n) AS v FROM q GROUP BY 1, 2)
SELECT t AS tx_id, CASE WHEN strand = '-' THEN reverse(translate(v, '{annotation.LETTERS}', '{annotation.COMPLEMENTS}')) ELSE v END AS sequence FROM j""")
def spliced_sequence(spark, sf_dir):
    exons = _blocks(spark, sf_dir).distinct().selectExpr("tx_id", "strand", "floor(start / 2000) AS ref_name", "start % 2000 + 1 AS start", "start % 2000 + 1 + end - start AS end")
    contigs = exons.select("ref_name").distinct().withColumn("seq", F.repeat(F.lit("ACGTRGTTCA"), 300))
    return annotation.spliced_sequence(exons, contigs, ["tx_id"])


#: Features of four levels and odd ones: a gene, a transcript below it, a feature of another kind below that, and an exon; an exon of the transcript; a transcript without a parent and
#: its exon; a feature that doesn't overlap its parent in every other group. Ids repeat, within a contig farther away than a parent may be.
_NEST = "p_partkey div 8"


def _nested(spark, sf_dir) -> DataFrame:
    p = _table(spark, sf_dir, "part").selectExpr("p_partkey AS line_no", f"{_NEST} AS g", "p_partkey % 8 AS k", "p_name").withColumn("r", F.col("g") % 210)
    at = F.col("g") * 40_000 + F.col("k") * 10
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("gene", "transcript", "other", "exon", "exon", "transcript", "exon", "other")]), (F.col("k") + 1).cast("int"))
    up = F.element_at(F.array(*[F.lit(x).cast("int") for x in (None, 0, 1, 2, 1, 9, 5, 1)]), (F.col("k") + 1).cast("int"))
    name = lambda c: F.concat(F.lit("F"), F.col("r"), F.lit("_"), c)
    far = F.when((F.col("k") == 7) & (F.col("g") % 2 == 0), 5000).otherwise(0)
    return p.select(
        "line_no", name(F.col("k")).alias("id"), F.when(up.isNull(), F.array().cast("array<string>")).otherwise(F.array(name(up))).alias("parents"), kinds.alias("kind"), F.concat(F.lit("chr"), F.col("g") % 3).alias("seqid"),
        F.when((F.col("k") == 0) & (F.col("g") % 4 == 1), ".").otherwise(F.when(F.col("g") % 5 == 0, "-").otherwise("+")).alias("strand"), (at + far).alias("start"), (at + far + F.when(F.col("k") < 2, 1000).otherwise(300)).alias("end"),
        F.when(F.col("k") == 0, F.concat(F.lit("G"), F.col("g"))).when((F.col("k") == 1) & (F.col("g") % 6 == 0), F.lit("own")).alias("gene_id"), F.when((F.col("k") == 0) & (F.col("g") % 7 > 0), F.col("p_name")).alias("gene_name"),
    )


_NESTED = """p AS (SELECT p_partkey AS line_no, p_partkey // 8 AS g, p_partkey % 8 AS k, p_name, p_partkey // 8 % 210 AS r FROM part),
f AS (SELECT *, 'F' || r || '_' || k AS id, 'F' || r || '_' || [NULL, 0, 1, 2, 1, 9, 5, 1][k + 1] AS up, ['gene', 'transcript', 'other', 'exon', 'exon', 'transcript', 'exon', 'other'][k + 1] AS kind, 'chr' || g % 3 AS seqid,
 CASE WHEN k = 0 AND g % 4 = 1 THEN '.' WHEN g % 5 = 0 THEN '-' ELSE '+' END AS strand, g * 40000 + k * 10 + CASE WHEN k = 7 AND g % 2 = 0 THEN 5000 ELSE 0 END AS s,
 g * 40000 + k * 10 + CASE WHEN k = 7 AND g % 2 = 0 THEN 5000 ELSE 0 END + CASE WHEN k < 2 THEN 1000 ELSE 300 END AS e,
 CASE WHEN k = 0 THEN 'G' || g WHEN k = 1 AND g % 6 = 0 THEN 'own' END AS gene_id, CASE WHEN k = 0 AND g % 7 > 0 THEN p_name END AS gene_name FROM p),
l AS (SELECT c.line_no, min(u.line_no) AS parent FROM f c JOIN f u ON u.id = c.up AND u.seqid = c.seqid AND u.line_no <> c.line_no AND u.strand IN ('.', c.strand) AND abs(u.s - c.s) <= 7000000
 AND (c.kind = 'exon' OR (u.s <= c.e AND u.e >= c.s)) GROUP BY 1)"""


@query(f"{_NESTED} SELECT line_no, parent FROM l")
def parent_links(spark, sf_dir):
    return models.parent_links(_nested(spark, sf_dir))


@query(f"""{_NESTED}, w AS (WITH RECURSIVE w AS (SELECT l.line_no, l.parent, 1 AS d FROM l UNION ALL SELECT w.line_no, l.parent, d + 1 FROM w JOIN f ON f.line_no = w.parent AND f.kind <> 'gene' JOIN l ON l.line_no = w.parent) SELECT * FROM w),
n AS (SELECT w.line_no, u.line_no AS gene_line, u.gene_id, u.gene_name, row_number() OVER (PARTITION BY w.line_no ORDER BY d, u.line_no) AS o FROM w JOIN f u ON u.line_no = w.parent AND u.kind = 'gene')
SELECT f.line_no, f.kind, n.gene_line, coalesce(f.gene_id, n.gene_id) AS gene_id, coalesce(f.gene_name, n.gene_name) AS gene_name FROM f LEFT JOIN n ON n.line_no = f.line_no AND o = 1""")
def inherited_names(spark, sf_dir):
    return models.inherited(_nested(spark, sf_dir)).select("line_no", "kind", "gene_line", "gene_id", "gene_name")


@query(f"""{_NESTED}, w AS (WITH RECURSIVE w AS (SELECT l.line_no, l.parent FROM l UNION ALL SELECT w.line_no, l.parent FROM w JOIN f ON f.line_no = w.parent AND f.kind <> 'transcript' JOIN l ON l.line_no = w.parent) SELECT * FROM w)
SELECT u.line_no AS tx_line, u.id AS tx_id, count(*) AS n, min(f.s) AS start, max(f.e) AS "end" FROM w JOIN f USING (line_no) JOIN f u ON u.line_no = w.parent AND u.kind = 'transcript' WHERE f.kind = 'exon' GROUP BY ALL""")
def deep_tree(spark, sf_dir):
    transcripts, exons = models.assembled(_nested(spark, sf_dir))
    return transcripts.join(exons.groupBy("tx_line").agg(F.count("*").alias("n")), "tx_line").select("tx_line", "tx_id", "n", "start", "end")


@query(f"""{_RUNS}, c AS (SELECT strand, t, list({{s: s, e: e}} ORDER BY s) AS x, min(s) AS s, max(e) AS e FROM m GROUP BY 1, 2), d AS (SELECT *, [{{s: x[j].e + 1, e: x[j + 1].s - 1}} for j in range(1, len(x))] AS i FROM c),
b AS (SELECT a.strand, a.t, u.t AS c, len(u.i) AS n, a.s AS al, a.e AS ah, len(a.i) AS an, u.x AS ux, a.i AS ai, list_position(u.i, a.i[1]) AS p, u.i AS ui FROM d a JOIN d u ON a.strand = u.strand AND a.t <> u.t AND u.s <= a.s AND u.e >= a.e),
h AS (SELECT strand, t, c, n, al, ah, an, ux[p].s AS low, ux[p + an].e AS high FROM b WHERE an > 0 AND p > 0 AND ui[p:p + an - 1] = ai
 UNION ALL SELECT strand, t, c, n, al, ah, an, y.s, y.e FROM (SELECT *, unnest(ux) AS y FROM b WHERE an = 0)),
k AS (SELECT *, row_number() OVER (PARTITION BY strand, t ORDER BY high DESC, n DESC, low, c) AS o FROM h WHERE low <= al AND high >= ah AND NOT (low = al AND high = ah AND n = an AND c > t)),
held AS (SELECT d.strand, d.t, k.c FROM d LEFT JOIN k ON k.strand = d.strand AND k.t = d.t AND o = 1),
w AS (WITH RECURSIVE w AS (SELECT strand, t, t AS keeper FROM held WHERE c IS NULL UNION ALL SELECT held.strand, held.t, w.keeper FROM w JOIN held ON held.strand = w.strand AND held.c = w.t) SELECT * FROM w)
SELECT strand, t AS tx_id, keeper FROM w""")
def transcript_collapse(spark, sf_dir):
    exons = annotation.merged_exons(_blocks(spark, sf_dir), ["strand", "tx_id"])
    return models.collapsed(exons, ["strand"], "tx_id")


#: Contigs from digests of part keys, 32 bases each; exons and a coding part for each order's lines.
_HEX, _BASES = "0123456789abcdef", "ACGTTGCAACGTGTCA"


def _contigs(spark, sf_dir) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey")
    return fasta.blocks_of(p.select(F.concat(F.lit("chr"), F.col("p_partkey") % 5).alias("ref_name"), (F.floor(F.col("p_partkey") / 5) * 32).alias("offset"), F.translate(F.md5(F.col("p_partkey").cast("string")), _HEX, _BASES).alias("text")), 1000)


def _placed(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS tx_id", "concat('chr', l_orderkey % 5) AS ref_name", "CASE WHEN l_orderkey % 3 = 0 THEN '-' ELSE '+' END AS strand", "l_partkey * 6 AS start", "l_partkey * 6 + CAST(l_quantity AS BIGINT) AS end")


def _on_contigs(spark, sf_dir) -> DataFrame:
    """Merged exons, dealt by transcript alone, so that what is grouped or joined by transcript needs no further shuffle."""
    return annotation.merged_exons(_placed(spark, sf_dir).repartition("tx_id"), ["tx_id", "ref_name", "strand"])


def _coding_part(exons: DataFrame) -> DataFrame:
    return exons.groupBy("tx_id").agg((F.min("start") + F.col("tx_id") % 23).alias("c_start"), (F.max("end") - F.col("tx_id") % 17).alias("c_end")).withColumn("phase", F.col("tx_id") % 4)


_CONTIGS = f"""q AS (SELECT 'chr' || p_partkey % 5 AS ref, string_agg(translate(md5(p_partkey::VARCHAR), '{_HEX}', '{_BASES}'), '' ORDER BY p_partkey) AS seq FROM part GROUP BY 1),
x AS (SELECT l_orderkey AS t, 'chr' || l_orderkey % 5 AS ref, CASE WHEN l_orderkey % 3 = 0 THEN '-' ELSE '+' END AS strand, l_partkey * 6 AS s, l_partkey * 6 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
o AS (SELECT *, max(e) OVER (PARTITION BY t ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM o),
m AS (SELECT t, ref, strand, isle, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2, 3, 4), g AS (SELECT t, min(s) + t % 23 + CASE WHEN strand = '+' AND t % 4 IN (1, 2) THEN t % 4 ELSE 0 END AS lo, max(e) - t % 17 - CASE WHEN strand = '-' AND t % 4 IN (1, 2) THEN t % 4 ELSE 0 END AS hi, min(s) AS s, max(e) AS e, ref, strand FROM m GROUP BY t, ref, strand)"""
_TURN = "CASE WHEN strand = '-' THEN reverse(translate(v, 'ACGT', 'TGCA')) ELSE v END"
_CODING = f"""{_CONTIGS}, j AS (SELECT m.t, m.strand, string_agg(substr(seq, greatest(m.s, lo), least(m.e, hi) - greatest(m.s, lo) + 1), '' ORDER BY m.s) AS v FROM m JOIN g USING (t) JOIN q ON q.ref = m.ref WHERE greatest(m.s, lo) <= least(m.e, hi) GROUP BY 1, 2), k AS (SELECT t, {_TURN} AS v FROM j WHERE v <> '')"""


@query(f"{_CONTIGS}, j AS (SELECT t, strand, substr(seq, s, e - s + 1) AS v FROM g JOIN q USING (ref)) SELECT t AS tx_id, {_TURN} AS sequence FROM j WHERE v <> ''")
def unspliced_sequence(spark, sf_dir):
    return sequences.unspliced(_on_contigs(spark, sf_dir), _contigs(spark, sf_dir), ["tx_id"], 1000)


@query(f"{_CODING} SELECT t AS tx_id, v AS sequence FROM k")
def coding_sequence(spark, sf_dir):
    return sequences.coding(_on_contigs(spark, sf_dir), _coding_part(_placed(spark, sf_dir)), _contigs(spark, sf_dir), ["tx_id"], 1000)


@query(f"""{_CODING} SELECT t AS tx_id, array_to_string([substr('{annotation.CODE}', 16 * (instr('TCAG', v[n]) - 1) + 4 * (instr('TCAG', v[n + 1]) - 1) + instr('TCAG', v[n + 2]), 1) for n in range(1, len(v) - 1, 3)], '') AS sequence FROM k""")
def protein_sequence(spark, sf_dir):
    return sequences.translated(_on_contigs(spark, sf_dir), _coding_part(_placed(spark, sf_dir)), _contigs(spark, sf_dir), ["tx_id"], 1000)
