"""A small genome worked by hand, over SAM, BAM and whole runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from spliceframe.model import Options
from spliceframe.operators import junctions, reads
from spliceframe.plans import quantify
from spliceframe.sources import alignments as al
from spliceframe.sources import gff, sinks, tables

GFF = """##gff-version 3
chr1\tx\tgene\t100\t500\t.\t+\t.\tID=G1;gene_name=one
chr1\tx\tmRNA\t100\t500\t.\t+\t.\tID=T1;Parent=G1
chr1\tx\texon\t100\t250\t.\t+\t.\tParent=T1
chr1\tx\texon\t240\t400\t.\t+\t.\tParent=T1
chr1\tx\tmRNA\t100\t300\t.\t+\t.\tID=T2;Parent=G1
chr1\tx\texon\t100\t300\t.\t+\t.\tParent=T2
chr1\tx\tgene\t350\t360\t.\t+\t.\tID=G3
chr1\tx\tpseudogene\t900\t600\t.\t-\t.\tID=G2;Name=two
chr9\tx\tgene\t1\t9\t.\t+\t.\tID=G9
chr1\tx\tgene\t10\t20\t.\t+\t.\tID=nolength
"""
LENGTHS = "G1,300\nG3,50\nG2,200\nG1,999\nG9,5\n"
EVENTS = "id,chr,strand,donor,acceptor,in\nE1,chr1,+,149^,250-,149^200-220^250-\nE1,chr1,+,1^,2-,1^2-\nE9,chr9,+,1^,2-,1^2-\n"
#: qname, flag, pos (from 0), cigar, mate pos, isize
READS = [
    ("A", 67, 99, [("M", 50)], 399, 350), ("A", 131, 399, [("M", 50)], 99, -350),
    ("B", 67, 119, [("M", 30), ("N", 100), ("M", 20)], 279, 210), ("B", 131, 279, [("M", 50)], 119, -210),
    ("C", 67, 598, [("S", 2), ("M", 48)], 620, 72), ("C", 131, 620, [("M", 50)], 598, -72),
    ("D", 73, 549, [("M", 50)], 549, 0),
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("genome")
    (d / "g.gff3").write_text(GFF)
    (d / "l.csv").write_text(LENGTHS)
    (d / "se.csv").write_text(EVENTS)
    sam = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:10000\n@SQ\tSN:chr2\tLN:10000\n"
    for q, flag, pos, ops, mpos, isize in READS:
        sam += "\t".join([q, str(flag), "chr1", str(pos + 1), "60", "".join(f"{n}{o}" for o, n in ops), "=", str(mpos + 1), str(isize), "A" * 50, "*", "AS:i:3", "NH:i:1"]) + "\n"
    (d / "s.sam").write_text(sam)
    rows = [(q, flag, 0, pos, ops, 0, mpos, isize, 50, 1) for q, flag, pos, ops, mpos, isize in READS]
    al.write_bam(str(d / "s.bam"), [("chr1", 10000), ("chr2", 10000)], rows, 90)
    return d


def test_sam_and_bam_give_the_same_fragments(spark, files):
    sam, bam = al.read_sam(spark, str(files / "s.sam")), al.read_bam(spark, str(files / "s.bam"))
    assert al.sam_refs(spark, str(files / "s.sam")).collect() == al.bam_refs(spark, str(files / "s.bam")).collect()
    got = [{tuple(r) for r in reads.fragments(x).select("start", "end", "gap_start", "gap_end", F.to_json(F.struct("js"))).collect()} for x in (sam, bam)]
    assert got[0] == got[1]
    assert {r[:4] for r in got[0]} == {(100, 450, 150, 400), (120, 330, 270, 280), (599, 671, None, None), (550, 600, None, None)}
    j = junctions.junction_counts(reads.fragment_junctions(reads.fragments(bam)), ["ref_id"]).collect()
    assert [tuple(x) for x in j] == [(0, 149, 250, 1)]


def test_bam_splits_lose_no_record(spark, tmp_path):
    rows = [(f"read{i}", 0, i % 2, i * 3, [("M", 20), ("N", i % 7 + 1), ("M", 5)], -1, -1, 0, 25, i % 4 or None) for i in range(4000)]
    path = str(tmp_path / "many.bam")
    al.write_bam(path, [("a", 10**6), ("b", 10**6)], rows, 1500)
    for split in (1 << 26, 3000, 20_000):
        got = al.read_bam(spark, path, split).orderBy("ord").select("qname", "ref_id", "pos", "nh", F.col("cigar")[1]["len"]).collect()
        assert [tuple(r) for r in got] == [(r[0], r[2], r[3], r[9], r[4][1][1]) for r in rows], split


def test_genes_events_and_tables(spark, files, tmp_path):
    out = quantify.run(spark, str(files / "g.gff3"), str(files / "l.csv"), [("SE", str(files / "se.csv"))], str(files / "s.sam"), str(tmp_path / "out"))
    genes = {r["gene_id"]: r for r in out.genes.collect()}
    assert set(genes) == {"G1", "G2", "G3"} and genes["G1"]["gene_name"] == "one" and genes["G3"]["gene_name"] == "G3"
    counts = {k: (r["with_junction"], r["without_junction"], r["total"], round(r["tpm"], 3)) for k, r in genes.items()}
    assert counts == {"G1": (1, 1, 2, 400000.0), "G3": (0, 0, 0, 0.0), "G2": (0, 2, 2, 600000.0)}
    lines = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / "ase")).collect()
    assert len(lines) == 1
    assert [lines[0][c] for c in ("ase_id", "gene_id", "gene_name", "count_in", "count_out", "psi", "psi_lb", "psi_ub")] == ["E1", "G1", "one", "0.000", "1.000", "0.000", "0.000", "1.000"]
    gene_lines = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / "gene")).collect()
    assert [r["gene_id"] for r in gene_lines] == ["G1", "G3", "G2"] and gene_lines[0]["tpm"] == "400000.000"
    log = out.log.collect()[0]
    assert (log["with_junctions"], log["without_junctions"], log["junctions"]) == (1, 3, 1)


def test_five_reads_move_the_lower_bound(spark, files):
    sam = al.read_sam(spark, str(files / "s.sam"))
    b = sam.where("qname = 'B'")
    more = b
    for i in range(4):
        more = more.unionByName(b.withColumn("qname", F.lit(f"B{i}")))
    refs = al.sam_refs(spark, str(files / "s.sam"))
    genes = gff.gene_table(gff.read_gff(spark, str(files / "g.gff3")), refs, tables.parse_lengths(tables.lines_of(spark, str(files / "l.csv"))))
    events = tables.read_events(spark, [("SE", str(files / "se.csv"))], refs)
    r = quantify.quantify(more, genes, events).events.collect()[0]
    assert (r["count_out"], r["psi"], r["psi_lb"], r["psi_ub"]) == (5.0, 0.0, 1.0, 1.0)


def test_prepare(spark, files, tmp_path):
    quantify.prepare(spark, str(files / "g.gff3"), str(tmp_path))
    got = {tuple(x.value.split(",")) for x in spark.read.text(str(tmp_path / "length_table.csv")).collect()}
    assert got == {("G1", "300"), ("G3", "0"), ("G2", "0"), ("G9", "0"), ("nolength", "0")}
    assert all("gene\t" in x.value for x in spark.read.text(str(tmp_path / "gene.annotation.gff3")).collect())


def test_samples_dont_mix(spark, files):
    a = al.read_sam(spark, str(files / "s.sam"))
    two = a.unionByName(a.withColumn("sample_id", F.lit("other")).where("qname <> 'D'"))
    refs = al.sam_refs(spark, str(files / "s.sam"))
    genes = gff.gene_table(gff.read_gff(spark, str(files / "g.gff3")), refs, tables.parse_lengths(tables.lines_of(spark, str(files / "l.csv"))))
    events = tables.read_events(spark, [("SE", str(files / "se.csv"))], refs)
    out = quantify.quantify(two, genes, events)
    n = {(r["sample_id"], r["gene_id"]): r["total"] for r in out.genes.collect()}
    assert n["s", "G2"] == 2 and n["other", "G2"] == 1 and n["s", "G1"] == n["other", "G1"] == 2
    assert out.events.count() == 2


def test_filters_and_strandness(spark, files):
    sam = al.read_sam(spark, str(files / "s.sam"))
    assert reads.fragments(sam, Options(max_gap=100)).count() == 3  # A's gap is 250
    assert reads.fragments(sam, Options(strandness=1)).count() == 4
    assert reads.fragments(sam, Options(strandness=2)).count() == 4  # a pair goes only if both its reads are on the wrong strand
    turned = sam.withColumn("flag", F.when(F.col("flag") == 131, 147).otherwise(F.col("flag")))
    assert reads.fragments(turned, Options(strandness=1)).count() == 4
    assert reads.fragments(turned, Options(strandness=2)).count() == 1  # single reads always stay
    assert reads.fragments(sam, Options(mode=1)).count() == 0
    assert reads.fragments(sam, Options(pairing="keyed")).count() == 4


def test_repeated_ids_and_contigs(spark):
    lines = "chr1\tx\tgene\t10\t20\t.\t+\t.\tID=G10;Name=first\nchr2\tx\tgene\t5\t9\t.\t-\t.\tID=G10;Name=second\n"
    for c in ("chr1", "chr2"):
        lines += f"{c}\tx\tmRNA\t1\t9\t.\t+\t.\tID=T10;Parent=G10\n{c}\tx\texon\t1\t101\t.\t+\t.\tParent=T10\n"
    rows = [(i, v) for i, v in enumerate(lines.splitlines())]
    features = gff.parse_lines(spark.createDataFrame(rows, "line_no long, value string"))
    assert {tuple(r["parents"]) for r in features.where("kind <> 'gene'").collect()} == {("G10",), ("T10",)}
    refs = spark.createDataFrame([("chr1", 0), ("chr2", 1)], "ref_name string, ref_id int")
    got = gff.gene_table(features, refs, spark.createDataFrame([("G10", 7)], "gene_id string, length long")).orderBy("g_start").collect()
    assert [(r["gene_name"], r["ref_id"], r["ref_name"], r["strand"], r["g_start"]) for r in got] == [("first", 1, "chr1", "+", 5), ("first", 0, "chr1", "+", 10)]
    transcripts, exons = gff.tree(features)
    assert transcripts.count() == 2
    from spliceframe.operators import annotation

    assert annotation.gene_lengths(spark.createDataFrame([("G10",)], "gene_id string"), transcripts.select("tx_id", "seqid", "gene_id"), exons).first()["length"] == 100


def test_a_type_is_judged_by_its_first_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,chr,strand,donor,acceptor,in\n")
    (tmp_path / "b.csv").write_text("id,chr,strand,donor,acceptor,in\nE2,chr1,+,1^,2-,1^2-\n")
    refs = spark.createDataFrame([("chr1", 0)], "ref_name string, ref_id int")
    events = tables.read_events(spark, [("SE", str(tmp_path / "a.csv")), ("SE", str(tmp_path / "b.csv"))], refs)
    from spliceframe.operators.splicing import first_events

    assert first_events(events).count() == 1
    assert first_events(events, files=spark.createDataFrame([("SE", 0), ("SE", 1)], "ase_type string, file_idx int")).count() == 0


def test_alignments_are_decoded_once(spark, files, tmp_path):
    """A whole run opens each BAM file twice for its header and first record, and reads its blocks once for the records."""
    from spliceframe.sources import bam

    opened = tmp_path / "opened"
    opened.mkdir()
    path = f"{files}/s.bam"
    where = str(opened)

    class Counted(bam.BamReader):
        def read(self, part):
            open(f"{where}/{os.urandom(8).hex()}", "w").close()
            yield from super().read(part)

    class CountedSource(bam.BamDataSource):
        def reader(self, schema):
            return Counted(json.loads(self.options["files"]), 1 << 26, self._columns(), True)

    files_ = al.probe(spark, path)
    spark.dataSource.register(CountedSource)
    records = spark.read.format("bam").options(files=json.dumps(files_), columns=",".join(bam.COLUMNS)).load()
    refs = al.bam_refs(spark, path)
    genes = gff.gene_table(gff.read_gff(spark, str(files / "g.gff3")), refs, tables.parse_lengths(tables.lines_of(spark, str(files / "l.csv"))))
    out = quantify.quantify(records, genes, tables.read_events(spark, [("SE", str(files / "se.csv"))], refs), samples=al.bam_samples(spark, files_))
    counted = {r["gene_id"]: r["total"] for r in out.genes.collect()}
    for rows in (out.events, out.fusions, out.log, out.junctions):
        rows.collect()
    assert counted["G1"] == 2 and len(os.listdir(opened)) == 1


def test_exon_loci_join_through_shared_exons_only(spark):
    from spliceframe.operators import annotation

    rows = [("c", "t4", 100, 110), ("c", "t4", 500, 510), ("c", "t2", 110, 120), ("c", "t3", 120, 130), ("c", "in", 300, 310), ("d", "t2", 500, 510), ("c", "z", 505, 506), ("c", "t2", 110, 120)]
    got = annotation.exon_loci(spark.createDataFrame(rows, "seqid string, tx string, start long, end long"), ["seqid"], "tx")
    assert sorted(map(tuple, got.select("seqid", "tx", "locus").collect())) == [("c", "in", "in"), ("c", "t2", "t2"), ("c", "t3", "t2"), ("c", "t4", "t2"), ("c", "z", "t2"), ("d", "t2", "t2")]
    # A long chain settles in few rounds, as labels take their own labels.
    chain = spark.range(400).selectExpr("'c' AS seqid", "id AS tx", "id * 10 AS start", "id * 10 + 10 AS end")
    assert annotation.exon_loci(chain, ["seqid"], "tx", max_rounds=20).select("locus").distinct().count() == 1
    assert annotation.exon_loci(chain.limit(0), ["seqid"], "tx").count() == 0


def test_cds_coordinates_on_both_strands(spark):
    from spliceframe.operators import annotation

    exons = spark.createDataFrame([(t, s, a, b) for t, s in (("p", "+"), ("m", "-"), ("o", "+")) for a, b in ((11, 20), (31, 40))], "tx string, strand string, start long, end long")
    cds = spark.createDataFrame([("p", 15, 33, 1), ("m", 15, 33, 2), ("o", 25, 33, 0)], "tx string, c_start long, c_end long, phase int")
    got = {r["tx"]: tuple(r)[1:] for r in annotation.cds_coordinates(exons, cds, ["tx"]).collect()}
    assert got == {"p": (16, 33, 6, 13), "m": (15, 31, 10, 16), "o": (25, 33, 0, 13)}


def test_mate_log_counts_reads_not_fragments(spark):
    js = "array<struct<s:bigint,e:bigint>>"
    read = f"struct<start:bigint,end:bigint,forward:boolean,js:{js}>"
    one, two = (1, 50, True, [(5, 9)]), (60, 90, False, [])
    rows = spark.createDataFrame([("s", 0, one, two), ("s", 0, one, None), ("s", 0, None, two)], f"sample_id string, ref_id int, r1 {read}, r2 {read}")
    assert tuple(reads.mate_log(rows).first()) == ("s", 2, 4)


def walked(recs):
    """Which records open a fragment, and which record each takes: [(ord, ord of its mate or None)]."""
    out, i = [], 0
    while i < len(recs):
        o, keep, lone = recs[i]
        if keep:
            follower = recs[i + 1][0] if not lone and i + 1 < len(recs) else None
            out.append((o, follower))
            i += 1 if lone else 2
        else:
            i += 1
    return out


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 34])
def test_mates_are_scanned_in_two_steps(spark, stretch):
    """Equal to the walk, for many short names and for one that has a third of all rows, however records are dealt."""
    import random

    rng = random.Random(6)
    rows = []
    for i in range(3000):
        name = "hot" if rng.random() < 0.35 else f"n{rng.randrange(600)}"
        rows.append(("s", name, i * 3, rng.random() < 0.8, rng.random() < 0.15))
    d = spark.createDataFrame(rows, "sample_id string, qname string, ord long, keep boolean, lone boolean")
    got = reads.taken_or_free(d, ["sample_id", "qname"], "ord", F.col("keep") & ~F.col("lone"), F.col("ord"), stretch)
    opened = got.where("keep and not taken").select("ord", F.when(~F.col("lone"), F.col("next")).alias("mate"))
    want = []
    for name in {r[1] for r in rows}:
        want += walked([r[2:] for r in rows if r[1] == name])
    assert sorted(map(tuple, opened.collect()), key=str) == sorted(want, key=str)
    assert "collect_list" not in got._jdf.queryExecution().analyzed().toString()


def test_records_without_names_pair_up(spark, files):
    sam = al.read_sam(spark, str(files / "s.sam"))
    for name in ("*", None):
        one = sam.withColumn("qname", F.lit(name).cast("string"))
        assert reads.fragments(one).count() == reads.fragments(one.withColumn("qname", F.lit("x"))).count() == 4


def test_fusion_names_make_one_row_each(spark):
    genes = spark.createDataFrame([("GA", "a", 0), ("GA", "a", 1), ("GB", "b", 0), ("GB", "z", 2)], "gene_id string, gene_name string, ref_id int")
    fusions = spark.createDataFrame([("s", "GA", "GB", 7), ("s", "GB", "GA", 2)], "sample_id string, gene_a string, gene_b string, count long")
    assert [tuple(r) for r in sinks.fusion_rows(fusions, genes, ["sample_id"]).collect()] == [("s", "a", "b", 7), ("s", "b", "a", 2)]


def test_sam_without_a_dictionary(spark, files, tmp_path):
    text = "".join(line for line in open(files / "s.sam") if not line.startswith("@")).replace("chr1", "chrB", 2)
    (tmp_path / "n.sam").write_text(text)
    refs = {r["ref_name"]: r["ref_id"] for r in al.sam_refs(spark, str(tmp_path / "n.sam")).collect()}
    assert refs == {"chr1": 0, "chrB": 1}
    assert {r["ref_id"] for r in al.read_sam(spark, str(tmp_path / "n.sam")).select("ref_id").collect()} == {0, 1}


def test_few_samples_and_references_are_no_shuffle_keys(spark):
    """Rows aren't dealt by sample or reference name, of which there may be one."""
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    records = spark.range(10).selectExpr("concat('s', id % 2) AS sample_id", "id AS ord", "concat('q', id) AS qname", "67 AS flag", "0 AS ref_id", "id AS pos", "CAST(1 AS INT) AS nh")
    refs = spark.createDataFrame([("chr0", 0)], "ref_name string, ref_id int")
    sam = al.parse_sam(spark.range(10).selectExpr("id AS ord", "'s' AS sample_id", "concat_ws('\\t', id, 0, 'chr0', 1, 0, '5M', '=', 1, 0, 'A', '*') AS value"), refs)
    events = tables.parse_events(spark.range(10).selectExpr("id AS line_no", "'SE' AS ase_type", "0 AS file_idx", "concat('E', id, ',chr0,+,5^,60-,10^20-') AS value"), refs)
    for d in (reads.with_policy(records, Options()), sam, events):
        assert d.count() == 10 and "BroadcastHashJoin" in plan(d) and "SortMergeJoin" not in plan(d)


def test_unknown_references_are_minus_one(spark):
    """Named but not in the header, and '*'; such records go on as rows, not as nulls."""
    refs = spark.createDataFrame([("chr0", 0), ("chr1", 1)], "ref_name string, ref_id int")
    lines = [(i, "s", "\t".join(["q", "0", ref, "1", "0", "5M", "=", "1", "0", "ACGTA", "*"])) for i, ref in enumerate(["chr1", "chr9", "*", "chr0"])]
    sam = al.parse_sam(spark.createDataFrame(lines, "ord long, sample_id string, value string"), refs)
    assert [r["ref_id"] for r in sam.orderBy("ord").collect()] == [1, -1, -1, 0]
