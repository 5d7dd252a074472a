"""Interval joins and statistics against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceframe.functions import stats
from spliceframe.operators import annotation, expression, fusion, intervals, junctions


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(1)
    row = lambda i, most: (i, rng.randrange(2), (s := rng.randrange(-50, 400)), s + rng.randrange(most))
    genes, items = [row(i, 120) for i in range(60)], [row(i, 300) for i in range(150)]
    return (genes, spark.createDataFrame(genes, "gene_id long, ref_id int, g_start long, g_end long")), (items, spark.createDataFrame(items, "i long, ref_id int, start long, end long"))


@pytest.mark.parametrize("width", [7, 64, 1000])
def test_overlap_join_and_counts(spark, spans, width):
    (genes, g), (items, d) = spans
    want = {(a[0], b[0]) for a in genes for b in items if a[1] == b[1] and b[2] <= a[3] and b[3] >= a[2]}
    got = intervals.overlap_join(d, g, ["ref_id"], width, ("start", "end"), ("g_start", "g_end")).select("gene_id", "i").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    n = {r[0]: r[1] for r in intervals.overlap_counts(g, d, ["ref_id"], ("g_start", "g_end")).select("gene_id", "n").collect()}
    assert n == {a[0]: sum(x == a[0] for x, _ in want) for a in genes}


def test_gap_identity_and_containment(spark, spans):
    (genes, g), (items, d) = spans
    f = d.select("ref_id", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"))
    two = expression.gap_exclusions(g.unionByName(g.withColumn("ref_id", F.col("ref_id") + 2)), f, ["ref_id"], 32).collect()
    assert {(r[2], r[0]): r[1] for r in two if r[2] > 1} == {(a[1] + 2, a[0]): 0 for a in genes}  # each key counts for itself
    out = {r[0]: r[1] for r in intervals.outer_contained(g, f, ["ref_id"], ("g_start", "g_end"), ("gap_start", "gap_end")).select("gene_id", "n").collect()}
    inner = {r[0]: r[1] for r in expression.inner_gaps(g, f, ["ref_id"], 32).collect()}
    gone = {r[0]: r[1] for r in expression.gap_exclusions(g, f, ["ref_id"], 32).collect()}
    want = {a[0]: sum(b[1] == a[1] and b[2] < a[2] and b[3] > a[3] for b in items) for a in genes}
    assert gone == want
    assert {k: out[k] + inner[k] for k in out} == want
    held = intervals.containment_join(g, d, ["ref_id"], ("g_start", "g_end")).select("gene_id", "i").collect()
    assert len(held) == len({tuple(r) for r in held}) and {tuple(r) for r in held} == {(a[0], b[0]) for a in genes for b in items if a[1] == b[1] and a[2] <= b[2] < a[3] and b[3] <= a[3]}


@pytest.mark.parametrize(("share", "block", "closed"), [(1, 7, False), (5, 1 << 20, True), (64, 100, True)])
def test_points_in_spans(spark, spans, share, block, closed):
    (genes, g), (items, d) = spans
    g = g.unionByName(g.where("gene_id < 5")).unionByName(g.limit(1).withColumns({"g_start": F.lit(-(10**7)).cast("long"), "g_end": F.lit(10**7).cast("long"), "gene_id": F.lit(999).cast("long")}))
    every = [tuple(r) for r in g.collect()]
    got = sorted((r["gene_id"], r["i"]) for r in intervals.stabbing_join(d, g, ["ref_id"], "start", ("g_start", "g_end"), closed, share, block).collect())
    assert got == sorted((a[0], b[0]) for a in every for b in items if a[1] == b[1] and (a[2] <= b[2] < a[3] or (closed and a[2] <= b[2] == a[3])))


def test_long_spans_are_dealt_in_proportion(spark):
    """Spans of the whole axis that hold few points: neither their length nor empty stretches make rows."""
    spans = spark.range(300).selectExpr("0 AS ref_id", "id AS s_id", "id AS start", "cast(1e12 AS long) + id AS end")
    points = spark.range(40).selectExpr("0 AS ref_id", "id AS p_id", "id * 20000000000 + 500 AS at")
    got = intervals.stabbing_join(points, spans, ["ref_id"], "at", block=1 << 30)
    assert got.count() == 300 * 40
    met = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in met and "CartesianProduct" not in met


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_blocked_islands_equal_one_pass(spark, spans, block):
    _, (items, d) = spans
    d = d.unionByName(d.where("i % 7 = 0")).withColumn("end", F.col("start") + F.col("i") % 5)
    for touch in (0, 1, 30):
        one, two = (sorted(map(tuple, intervals.islands(d, ["ref_id"], touch=touch, block=b).select("ref_id", "i", "start", "end", "island").collect())) for b in (None, block))
        assert one == two and (touch or len({r[4] for r in one}) > 1)


def test_one_contig_uses_many_tasks(spark):
    """Blocks of one contig's axis are dealt over the partitions, and no window has a larger key."""
    rows = spark.range(4000).selectExpr("'c' AS seqid", "id * 1000 AS start", "id * 1000 + id % 1500 AS end")
    got = intervals.islands(rows, ["seqid"], block=1 << 14)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("_block") > 4
    spread = rows.withColumn("b", F.floor(F.col("start") / (1 << 14))).repartition(16, "seqid", "b").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 8 and got.select("island").distinct().count() == annotation.merged_exons(rows, ["seqid"]).count()


@pytest.mark.parametrize("block", [10, 1000])
def test_as_of_and_islands(spark, spans, block):
    (genes, g), (items, d) = spans
    got = {r[0]: r[1] for r in intervals.as_of(d, g.select("ref_id", F.col("g_start").alias("m"), "gene_id"), ["ref_id"], "start", "m", "gene_id", "last", block).select("i", "last").collect()}
    want = {b[0]: max(((a[2], a[0]) for a in genes if a[1] == b[1] and a[2] <= b[2]), default=(0, None))[1] for b in items}
    assert got == want
    merged = {tuple(r) for r in annotation.merged_exons(d, ["ref_id"]).collect()}
    for ref in (0, 1):
        cover = sorted({x for b in items if b[1] == ref for x in range(b[2], b[3] + 1)})
        runs, start = [], cover[0]
        for a, b in zip(cover, [*cover[1:], None]):
            if b != a + 1:
                runs.append((ref, start, a))
                start = b
        assert {m for m in merged if m[0] == ref} == set(runs)


def test_junction_forms_agree(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.randrange(6), rng.randrange(6, 9)) for _ in range(300)]
    d = spark.createDataFrame(rows, "ref_id int, start long, end long")
    a = {tuple(r) for r in junctions.junction_counts(d, ["ref_id"]).collect()}
    assert a == {tuple(r) for r in junctions.junction_runs(d, ["ref_id"]).collect()} == {(*k, rows.count(k)) for k in set(rows)}


def test_fusion_takes_the_chromosome_before(spark):
    genes = spark.createDataFrame([("a", 0, 100, 200), ("b", 1, 500, 600), ("c", 1, 550, 900)], "gene_id string, ref_id int, g_start long, g_end long")
    frags = spark.createDataFrame([(1, 50, 520), (1, 510, 560), (0, 120, 130), (0, 10, 50)], "ref_id int, start long, end long")
    got = {tuple(r) for r in fusion.fusion_pairs(genes, frags, [], 1000).collect()}
    assert got == {("a", "b", 1), ("b", "c", 1)}  # across references; and overlapping genes
    assert {tuple(r) for r in fusion.fusion_pairs(genes, frags, [], 1000, True).collect()} == {("b", "c", 1)}


def _tail(a, b, x):
    n = a + b - 1
    return sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))


def test_beta_functions():
    for a, b in [(1, 1), (2, 5), (30, 4), (17, 17)]:
        for x in (0.01, 0.3, 0.5, 0.93):
            assert abs(float(stats.regularized_beta(a, b, x)) - _tail(a, b, x)) < 1e-12
    a, b = np.array([0.5, 3, 5000, 1e5, 0, 2]), np.array([2.5, 1, 7000, 10, 1, 0])
    for p in (0.025, 0.975):
        x = stats.beta_quantile(p, a, b)
        assert np.allclose(stats.regularized_beta(a[:4], b[:4], x[:4]), p, atol=1e-9) and list(x[4:]) == [0, 1]


def test_intervals_of_counts(spark):
    want = [(10, 10, 0.500, 0.272, 0.728), (5, 1, 0.833, 0.359, 0.996), (1, 5, 0.167, 0.004, 0.641), (3, 4, 0.429, 0.099, 0.816), (0, 0, -1, 0, 1), (0, 5, 0, 1, 1), (4, 0, 1, 0, 1)]
    d = spark.createDataFrame([(float(i), float(o)) for i, o, *_ in want], "i double, o double")
    got = d.select("i", "o", F.round(stats.psi(F.col("i"), F.col("o")), 3), F.round(stats.interval(F.col("i"), F.col("o"))["lb"], 3), F.round(stats.interval(F.col("i"), F.col("o"))["ub"], 3)).collect()
    assert [tuple(r) for r in got] == [tuple(map(float, w)) for w in want]


def test_sequences(spark):
    d = spark.createDataFrame([("ATGGCNTAAg",)], "s string")
    assert d.select(annotation.translate(F.col("s")), annotation.reverse_complement(F.col("s"))).first()[:] == ("MA.", "cTTANGCCAT")
    assert spark.createDataFrame([("MGAYTARAYSARTRANNNacuGGNATHWWW-",)], "s string").select(annotation.translate(F.col("s"))).first()[0] == "RLBZ.XTGIX"
    exons = spark.createDataFrame([("t", "c", "-", 1, 3), ("t", "c", "-", 6, 8)], "tx string, ref_name string, strand string, start long, end long")
    assert annotation.spliced_sequence(exons, spark.createDataFrame([("c", "AACGGTTTGG")], "ref_name string, seq string"), ["tx"]).first()["sequence"] == "AAAGTT"
    cds = spark.createDataFrame([("t", "+", 1, 4), ("t", "+", 10, 14), ("t", "+", 20, 22)], "tx string, strand string, start long, end long")
    assert [r["phase"] for r in annotation.cds_phases(cds, ["tx"]).orderBy("start").collect()] == [0, 2, 0]


def test_counts_of_equal_and_incomplete_queries(spark):
    """Queries that are equal in all columns come out as often as they went in; a query without an end gives no row, an item without one counts where it has one."""
    q = spark.createDataFrame([(1, "a", 5, 9), (1, "a", 5, 9), (1, "b", 5, 9), (1, "c", 50, None), (2, "a", 5, 9), (None, "d", 5, 9), (1, "far", 200_000, 300_000), (1, "turned", 9, 5)], "ref_id int, k string, s long, e long")
    i = spark.createDataFrame([(1, 1, 5), (1, 9, 9), (1, 9, 9), (1, 10, 12), (1, 1, 4), (2, 6, 7), (1, 250_000, 250_001), (1, 4, None)], "ref_id int, start long, end long")
    got = sorted(tuple(r) for r in intervals.overlap_counts(q, i, ["ref_id"], ("s", "e")).where("k not in ('far', 'turned')").select("ref_id", "k", "n").collect())
    assert got == [(1, "a", 4), (1, "a", 4), (1, "b", 4), (2, "a", 1)]
    far = {r[0]: r[1] for r in intervals.overlap_counts(q, i, ["ref_id"], ("s", "e")).where("k in ('far', 'turned')").select("k", "n").collect()}
    assert far == {"far": 2, "turned": 1}
    totals = {tuple(r) for r in intervals.overlap_totals(q.where("k < 'd'"), i, ["ref_id"], "k", ("s", "e")).select("ref_id", "k", "n").collect()}
    assert totals == {(1, "a", 8), (1, "b", 4), (2, "a", 1)}
    assert intervals.overlap_counts(q, i.where("false"), ["ref_id"], ("s", "e")).agg({"n": "sum"}).first()[0] == 0
