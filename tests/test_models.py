"""FASTA blocks, sequences, ancestors and the collapse of redundant transcripts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spliceframe.operators import annotation, models, sequences
from spliceframe.operators.annotation import BLOCK
from spliceframe.sources import fasta, gff


def test_fasta_in_ranges(spark, tmp_path):
    rng = random.Random(3)
    want, text = {}, "ACGT\n;a comment\n"  # bases before the first name belong to none
    for i, n in enumerate([0, 1, 59, 60, 61, 7000, 5, 0, 1234]):
        seq = "".join(rng.choice("ACGTacgtN") for _ in range(n))
        want[f"c{i}"] = seq
        text += f">c{i} some words\n" + "".join(seq[j : j + 60] + rng.choice(["\n", "\r\n"]) for j in range(0, n, 60))
    (tmp_path / "a.fa").write_text(text, newline="")
    (tmp_path / "b.fa").write_text(">d0\nAC GT\n\n>d1\nGGG", newline="")
    (tmp_path / "empty.fa").write_text("")
    want |= {"d0": "ACGT", "d1": "GGG"}
    paths = [str(tmp_path / p) for p in ("a.fa", "b.fa", "empty.fa")]
    for split, size in ((37, 50), (1000, 64), (1 << 25, 1 << 16)):
        rows = fasta.read_fasta(spark, paths, size, split).collect()
        assert all(len(r["seq"]) <= size for r in rows) and len({(r["ref_name"], r["block"]) for r in rows}) == len(rows)
        got = {}
        for r in sorted(rows, key=lambda r: r["block"]):
            assert r["block"] * size == len(got.get(r["ref_name"], ""))
            got[r["ref_name"]] = got.get(r["ref_name"], "") + r["seq"]
        assert got == {k: v for k, v in want.items() if v}


def test_sequences_over_block_borders(spark, tmp_path):
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(500))
    (tmp_path / "g.fa").write_text(">chr1\n" + "\n".join(seq[i : i + 70] for i in range(0, 500, 70)) + "\n")
    blocks = fasta.read_fasta(spark, str(tmp_path / "g.fa"), 32)
    ex = [("p", "chr1", "+", 11, 50), ("p", "chr1", "+", 90, 200), ("m", "chr1", "-", 11, 50), ("m", "chr1", "-", 90, 200), ("over", "chr1", "+", 490, 600), ("none", "chr9", "+", 1, 5), ("gone", "chr1", "+", 700, 800)]
    exons = spark.createDataFrame(ex, "tx string, ref_name string, strand string, start long, end long")
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    whole, joined = seq[10:200], seq[10:50] + seq[89:200]
    got = lambda d: {r["tx"]: r["sequence"] for r in d.collect()}
    assert got(sequences.unspliced(exons, blocks, ["tx"], 32)) == {"p": whole, "m": turn(whole), "over": seq[489:]}
    assert got(sequences.spliced(exons, blocks, ["tx"], 32)) == {"p": joined, "m": turn(joined), "over": seq[489:]}
    cds = spark.createDataFrame([("p", 30, 120, 1), ("m", 30, 120, 2), ("over", 1, 9, 0)], "tx string, c_start long, c_end long, phase int")
    part = {"p": seq[30:50] + seq[89:120], "m": turn(seq[29:50] + seq[89:118])}
    assert got(sequences.coding(exons, cds, blocks, ["tx"], 32)) == part
    table = annotation._codons()
    assert got(sequences.translated(exons, cds, blocks, ["tx"], 32)) == {k: "".join(table[v[i : i + 3]] for i in range(0, len(v) - 2, 3)) for k, v in part.items()}
    assert sequences.spliced(exons.limit(0), blocks, ["tx"], 32).collect() == []


LINES = """chr1\tx\tgene\t100\t900\t.\t+\t.\tID=G;Name=top
chr1\tx\tmRNA\t100\t900\t.\t+\t.\tID=T;Parent=G
chr1\tx\tfeature\t100\t400\t.\t+\t.\tID=M;Parent=T
chr1\tx\texon\t100\t200\t.\t+\t.\tParent=M
chr1\tx\texon\t300\t400\t.\t+\t.\tParent=T,U
chr1\tx\tmRNA\t250\t900\t.\t+\t.\tID=U;Parent=lost
chr1\tx\texon\t500\t600\t.\t-\t.\tParent=U
chr1\tx\tmRNA\t8000500\t8000900\t.\t+\t.\tID=T;Parent=G
chr2\tx\tgene\t1\t50\t.\t.\t.\tID=G;Name=other
chr2\tx\tmRNA\t1\t50\t.\t-\t.\tID=T;Parent=G;gene_name=mine
chr2\tx\texon\t1\t50\t.\t-\t.\tParent=T
chr3\tx\tmRNA\t1\t9\t.\t+\t.\tID=R1;Parent=R2
chr3\tx\tmRNA\t1\t9\t.\t+\t.\tID=R2;Parent=R1
chr3\tx\tlnc\t1\t9\t.\t+\t.\tID=R3;Parent=R1
"""


def test_ancestors_at_any_depth(spark):
    features = gff.parse_lines(spark.createDataFrame(list(enumerate(LINES.splitlines())), "line_no long, value string"))
    links = {tuple(r) for r in models.parent_links(features).collect()}
    # A repeated id stands for the feature of its contig within reach; a part on the other strand, and a parent too far away, are no match.
    assert links == {(1, 0), (2, 1), (3, 2), (4, 1), (4, 5), (9, 8), (10, 9), (11, 12), (12, 11), (13, 11)}
    names = {r["line_no"]: (r["gene_line"], r["gene_id"], r["gene_name"]) for r in models.inherited(features).collect()}
    assert names[3] == names[4] == names[1] == (0, "G", "top") and names[9] == (8, "G", "mine") and names[10][0] == 8
    assert all(names[i][0] is None for i in (5, 6, 7, 11, 12, 13))
    transcripts, exons = models.assembled(features)
    assert sorted(map(tuple, exons.collect())) == [(1, "chr1", 100, 200), (1, "chr1", 300, 400), (5, "chr1", 300, 400), (9, "chr2", 1, 50)]
    assert sorted((r["tx_line"], r["tx_id"], r["gene_id"], r["start"], r["end"]) for r in transcripts.collect()) == [(1, "T", "G", 100, 400), (5, "U", None, 300, 400), (9, "T", "G", 1, 50)]


def test_a_long_line_of_parents_settles_in_few_rounds(spark):
    n = 300
    rows = [(0, "i0", [], "gene", "c", "+", 1, 9, "G", "name")] + [(i, f"i{i}", [f"i{i - 1}"], "other", "c", "+", 1, 9, None, None) for i in range(1, n)]
    features = spark.createDataFrame(rows, "line_no long, id string, parents array<string>, kind string, seqid string, strand string, start long, end long, gene_id string, gene_name string")
    got = models.nearest_ancestors(features, models.parent_links(features), "gene")
    assert sorted(map(tuple, got.collect())) == [(i, 0, i) for i in range(1, n)]
    assert models.nearest_ancestors(features, models.parent_links(features.limit(0)), "gene").collect() == []


def within(a, b):
    """Whether exons a are contained in exons b."""
    ia, ib = [[(x[k][1] + 1, x[k + 1][0] - 1) for k in range(len(x) - 1)] for x in (a, b)]
    if not ia:
        return any(s <= a[0][0] and e >= a[0][1] for s, e in b)
    return any(ib[p : p + len(ia)] == ia and b[p][0] <= a[0][0] and b[p + len(ia)][1] >= a[-1][1] for p in range(len(ib) - len(ia) + 1))


@pytest.mark.parametrize(("match_all", "block"), [(False, 30), (True, 1 << 20)])
def test_collapse_equals_all_pairs(spark, match_all, block):
    rng = random.Random(8)
    tx = {}
    for i in range(400):
        strand = rng.choice("+-")
        cuts = sorted(rng.sample(range(0, 60), 2 * rng.choice([1, 1, 2, 3, 4])))
        if rng.random() < 0.6 and tx:  # a part or an extension of another one
            strand, x = tx[rng.choice(list(tx))]
            k = rng.randrange(len(x))
            x = x[k : k + rng.randrange(1, 4)]
            lo, hi = x[0][0] + rng.choice([0, 0, 1, -1]), x[-1][1] + rng.choice([0, 0, -1, 1])
            x = [(lo, hi)] if len(x) == 1 else [(lo, x[0][1]), *x[1:-1], (x[-1][0], hi)]
            if any(s > e for s, e in x) or any(a[1] + 1 >= b[0] for a, b in zip(x, x[1:])):
                continue
        else:
            x = [(a * 10, b * 10 - 5) for a, b in zip(cuts[::2], cuts[1::2])]
        tx[f"t{i:03d}"] = (strand, x)
    holds = lambda a, b: tx[a][0] == tx[b][0] and within(tx[a][1], tx[b][1]) and (not match_all or len(tx[a][1]) == len(tx[b][1]))
    redundant = {a for a in tx for b in tx if a != b and holds(a, b) and (not holds(b, a) or b < a)}
    exons = spark.createDataFrame([(s, t, a, b) for t, (s, x) in tx.items() for a, b in x], "strand string, tx string, start long, end long")
    first = {r["tx"]: r["container"] for r in models.containers(exons, ["strand"], "tx", match_all, block).collect()}
    assert set(first) == redundant and all(holds(a, b) for a, b in first.items())
    got = {r["tx"]: r["keeper"] for r in models.collapsed(exons, ["strand"], "tx", match_all).collect()}
    assert set(got) == set(tx) and {t for t, k in got.items() if t == k} == set(tx) - redundant
    assert all(k not in redundant and (t == k or holds(t, k)) for t, k in got.items()) and 50 < len(redundant) < len(tx) - 50


def test_a_locus_of_many_isoforms(spark):
    """10,000 transcripts of one chain: as many rows, not pairs."""
    base = spark.range(10_000).select(F.lit("c").alias("seqid"), F.col("id").alias("tx"))
    one = base.select("seqid", "tx", (100 - F.col("tx") % 100).alias("start"), F.lit(200).cast("long").alias("end"))
    two = base.select("seqid", "tx", F.lit(301).cast("long").alias("start"), (400 + F.col("tx") % 77).alias("end"))
    got = models.collapsed(one.unionByName(two), ["seqid"], "tx")
    widest = [i for i in range(10_000) if i % 100 == 99 and i % 77 == 76]
    assert got.count() == 10_000 and {r["keeper"] for r in got.select("keeper").distinct().collect()} == {min(widest)}


def test_attribute_edits(spark):
    text = ['ID=a;product=p;x="1;2"', "x=1", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").withColumn("m", gff.attributes(F.col("t")))
    above = gff.attributes(F.lit("description=p;x=9;y=8;ID=z"))
    edits = [
        gff.with_attribute(F.col("m"), "x", F.lit("new")), gff.with_attribute(F.col("m"), "x", F.lit(None).cast("string")), gff.without_attribute(F.col("m"), "x"),
        gff.without_attribute(F.col("m"), "x", F.lit("1")), gff.copied_attributes(F.col("m"), above), gff.copied_attributes(F.col("m"), F.lit(None).cast("map<string,string>")),
    ]
    got = [tuple(r) for r in rows.orderBy("i").select(*[gff.attribute_text(e).alias(f"e{k}") for k, e in enumerate(edits)]).collect()]
    assert got[1] == ("x=new", "x=1", "", "", "x=1;description=p;y=8;ID=z", "x=1")
    assert got[2] == ("x=new", "", "", "", "description=p;x=9;y=8;ID=z", "")
    first = gff.attribute_text(F.create_map(F.lit("x"), F.lit("1;2")))
    assert got[0][0] == "ID=a;product=p;x=new" and got[0][2] == "ID=a;product=p" and got[0][4].endswith(";y=8") and "description" not in got[0][4]
    assert spark.range(1).select(first).first()[0] == 'x="1;2"'


def test_attributes_of_the_first_parent(spark):
    line = lambda kind, start, end, attrs: "\t".join(["c", "s", kind, str(start), str(end), ".", "+", ".", attrs])
    lines = [line("gene", 100, 900, "ID=g;biotype=b;note=n"), line("gene", 150, 800, "ID=h;biotype=late;other=o"), line("mRNA", 100, 500, "ID=t;Parent=h,g;note=mine"), line("mRNA", 5000, 5500, "ID=far;Parent=g")]
    got = models.with_copied_attributes(gff.parse_lines(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")))
    text = {r["id"]: r["a"] for r in got.select("id", gff.attribute_text(F.col("attributes")).alias("a")).collect()}
    assert text == {"g": "ID=g;biotype=b;note=n", "h": "ID=h;biotype=late;other=o", "t": "ID=t;Parent=h,g;note=mine;biotype=b", "far": "ID=far;Parent=g"}


def test_blocks_are_not_shuffled_for_each_span(spark, tmp_path, monkeypatch):
    """Whole spans over many blocks and regions, a missing block, and no rows of blocks where pieces are gathered."""
    rng = random.Random(8)
    seq = "".join(rng.choice("ACGT") for _ in range(5000))
    rows = [("c", i, seq[i * 16 : i * 16 + 16]) for i in range(-(-5000 // 16)) if i != 100]
    blocks = spark.createDataFrame(rows, "ref_name string, block long, seq string")
    left = lambda a, b: "".join(seq[i] for i in range(a - 1, min(b, 5000)) if i // 16 != 100)
    spans = [(i, a := rng.randrange(-20, 5100), a + rng.randrange(0, 3000)) for i in range(300)]
    exons = spark.createDataFrame([(i, "c", "+", a, b) for i, a, b in spans], "tx long, ref_name string, strand string, start long, end long")
    want = {i: s for i, a, b in spans if (s := left(max(a, 1), b))}
    for region in (16, 100, 1 << 16):
        monkeypatch.setattr(sequences, "REGION", region)
        for f in (sequences.unspliced, sequences.spliced):
            got = f(exons, blocks, ["tx"], 16)
            assert {r["tx"]: r["sequence"] for r in got.collect()} == want
    pieces = sequences.unspliced(exons, blocks, ["tx"], 16)._jdf.queryExecution().optimizedPlan().toString()
    assert pieces.count("collect_list") == 1 and "collect_list(struct(block" in pieces  # windows alone are gathered


def test_windows_are_turned_and_dealt_in_shares(spark, monkeypatch):
    """Spans of both strands of one region: each is one substring, and its rows don't all meet in one key of the join."""
    rng = random.Random(9)
    seq = "".join(rng.choice("ACGTRN") for _ in range(3000))
    blocks = spark.createDataFrame([("c", i, seq[i * 16 : i * 16 + 16]) for i in range(-(-3000 // 16)) if i != 100], "ref_name string, block long, seq string")
    left = lambda a, b: "".join(seq[i] for i in range(a - 1, min(b, 3000)) if i // 16 != 100)
    turn = lambda s: s[::-1].translate(str.maketrans("ACGTRN", "TGCAYN"))
    spans = [(i, rng.choice("+-"), a := rng.randrange(-20, 3100), a + rng.randrange(0, 2000)) for i in range(300)] + [(300, "-", 1601, 1616), (301, "+", 1605, 1610), (302, "-", 2500, 10**15), (303, "+", 10**12, 10**15)]
    exons = spark.createDataFrame([(i, "c", t, a, b) for i, t, a, b in spans], "tx long, ref_name string, strand string, start long, end long")
    want = {i: turn(s) if t == "-" else s for i, t, a, b in spans if (s := left(max(a, 1), b))}
    for share in (1 << 28, 5000):
        monkeypatch.setattr(sequences, "SHARE", share)
        got = {r["tx"]: r["sequence"] for r in sequences.unspliced(exons, blocks, ["tx"], 16).collect()}
        assert got == want
    met = sequences.unspliced(exons, blocks, ["tx"], 16)._jdf.queryExecution().optimizedPlan().toString()
    assert met.count("translate(") == 1 and "share" in met  # windows alone are turned


def test_merged_exons_hold_one_sort(spark):
    rng = random.Random(8)
    rows = [(t, s, s + rng.choice([0, 3, 40])) for t in range(60) for s in (rng.randrange(200) for _ in range(rng.randrange(1, 12)))]
    exons = spark.createDataFrame(rows, "tx_id long, start long, end long")
    expected = {}
    for t, s, e in sorted(rows):
        runs = expected.setdefault(t, [])
        if runs and s <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], max(e, runs[-1][1]))
        else:
            runs.append((s, e))
    merged, lengths, chains = annotation.merged_exons(exons, ["tx_id"]), annotation.transcript_lengths(exons, ["tx_id"]), annotation.intron_chains(exons, ["tx_id"])
    for df in (merged, lengths, chains):  # exons pass through one sort; no table of all runs is hashed or sorted again
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 1 and "HashAggregate" not in plan
    assert sorted(map(tuple, merged.collect())) == sorted((t, *r) for t, runs in expected.items() for r in runs)
    assert dict(map(tuple, lengths.collect())) == {t: sum(e - s for s, e in runs) for t, runs in expected.items()}
    got = {r["tx_id"]: (r["start"], r["end"], [tuple(i) for i in r["introns"]]) for r in chains.collect()}
    assert got == {t: (runs[0][0], runs[-1][1], [(a[1] + 1, b[0] - 1) for a, b in zip(runs, runs[1:])]) for t, runs in expected.items()}


def test_pieces_of_transcripts_are_sorted_once(spark):
    blocks = spark.createDataFrame([("c", k, "ACGTTGCAAC"[k:] + "ACGTTGCAAC"[:k]) for k in range(6)], "ref_name string, block long, seq string")
    exons = spark.createDataFrame([(t, "c", "+-"[t % 2], s, s + 12 + t) for t in range(3) for s in (5 + t, 31)], "tx_id long, ref_name string, strand string, start long, end long")
    whole = "".join(r["seq"] for r in blocks.orderBy("block").collect())
    got = sequences.spliced(exons, blocks, ["tx_id"], 10)
    assert "collect_list" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in x)
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    joined = {t: whole[4 + t : 17 + 2 * t] + whole[30 : 43 + t] for t in range(3)}
    assert dict(map(tuple, got.collect())) == {t: turn(s) if t % 2 else s for t, s in joined.items()}


def test_coding_parts_take_the_shuffle_of_exons(spark, tmp_path):
    from spliceframe import format_queries

    spark.range(40).selectExpr("id AS l_orderkey", "id % 7 + 1 AS l_partkey", "CAST(id % 9 + 1 AS double) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 30).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = format_queries.coding_sequence(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # Exons, the ends of coding parts and pieces, once each; before, five.
    assert sum("Exchange hashpartitioning(tx_id" in x for x in plan.splitlines()) == 3


def test_loci_hold_links_alone(spark, monkeypatch):
    held = []
    keep = annotation.checkpointed
    monkeypatch.setattr(annotation, "checkpointed", lambda df: held.append(keep(df)) or held[-1])
    lone = [("+", 1000 + i, i * 100, i * 100 + 20) for i in range(300)]
    chain = [("-", (i * 7) % 41, BLOCK - 400 + i * 20 + d, BLOCK - 400 + i * 20 + d + 25) for i in range(41) for d in (0, 5000)]  # each overlaps the next, over a block's border
    far = [("-", 90, 0, 3 * BLOCK), ("-", 91, 3 * BLOCK, 3 * BLOCK + 5), ("+", 5, 10**7, 10**7 + 9)]
    got = annotation.exon_loci(spark.createDataFrame(lone + chain + far, "strand string, t long, start long, end long"), ["strand"], "t")
    want = {("+", t): t for _, t, *_ in lone} | {("-", t): 0 for _, t, *_ in chain + far[:2]} | {("+", 5): 5}
    assert {(r["strand"], r["t"]): r["locus"] for r in got.collect()} == want
    assert max(df.count() for df in held) <= len(chain) + 2 and len(held) <= 8  # before, all 344 transcripts in each round


def test_tasks_of_matches_grow_with_the_exons(spark, tmp_path, monkeypatch):
    from spliceframe import format_queries
    from spliceframe.operators import intervals

    spark.range(900).selectExpr("id div 2 AS l_orderkey", "CAST(pmod(hash(id), 4) AS long) AS l_partkey", "CAST(pmod(hash(id, 1), 9) AS long) AS l_suppkey", "pmod(hash(id, 2), 3) + 1 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    merged = {}
    for r in annotation.merged_exons(format_queries._blocks(spark, str(tmp_path)), ["strand", "tx_id"]).orderBy("start").collect():
        merged.setdefault((r["strand"], r["tx_id"]), []).append((r["start"], r["end"]))

    def alike(x, y):
        if len(x) == len(y) == 1:
            return (min(x[0][1], y[0][1]) - max(x[0][0], y[0][0]) + 1) * 10 >= (max(x[0][1] - x[0][0], y[0][1] - y[0][0]) + 1) * 8
        return [a[1] for a in x[:-1]] == [a[1] for a in y[:-1]] and [a[0] for a in x[1:]] == [a[0] for a in y[1:]]

    def redundant(x, y):
        if len(x) > 1:
            return within(x, y)
        return y[0][0] <= x[0][0] and x[0][1] <= y[-1][1] and not any(a[1] + 1 <= x[0][1] and b[0] - 1 >= x[0][0] for a, b in zip(y, y[1:]))

    pairs = [(a, b) for a in merged for b in merged if a[0] == b[0] and a != b and merged[a][0][0] <= merged[b][-1][1] and merged[b][0][0] <= merged[a][-1][1]]
    want = sorted((a[0], a[1], b[1], alike(merged[a], merged[b]), redundant(merged[a], merged[b])) for a, b in pairs)
    assert len(want) > 300 and {x[3] for x in want} == {x[4] for x in want} == {True, False}
    for share, tasks in ((1 << 20, None), (225, None), (100, 9), (3, 200)):
        monkeypatch.setattr(intervals, "SHARE", share)
        got = format_queries.transcript_matches(spark, str(tmp_path))
        plan = got._jdf.queryExecution().executedPlan().toString()
        held = [int(n) for n in re.findall(r"Exchange hashpartitioning\(strand#\d+L?, (?:_bin|tx_id)#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]
        assert set(held) == ({tasks} if tasks else set())  # exons and chains in their bins
        assert sorted(map(tuple, got.collect())) == want
