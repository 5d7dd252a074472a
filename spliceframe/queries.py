"""One query for each operator over the driver tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceframe.functions import cigar, coords
from spliceframe.model import Options
from spliceframe.operators import annotation, expression, fusion, intervals, junctions, reads, splicing
from spliceframe.plans import fixtures as fx

BY = ["ref_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL over the fixture views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            ORACLES[f.__name__] = f"WITH {fx.VIEWS}\n{text}" if text.startswith("SELECT") else f"WITH {fx.VIEWS},\n{text}"
        return f

    return add


_OVERLAP = "g.ref_id = f.ref_id AND f.f_start <= g.g_end AND f.f_end >= g.g_start"
_KEPT = "NOT coalesce(f.gap_start < g.g_start AND f.gap_end > g.g_end, false)"
_COUNTS = f"""c AS (SELECT g.gene_id, count(*) FILTER (WHERE f.has_junction AND {_KEPT}) AS with_junction, count(*) FILTER (WHERE NOT f.has_junction AND {_KEPT}) AS without_junction
 FROM genes g LEFT JOIN fragments f ON {_OVERLAP} GROUP BY 1)"""


def _gene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression.gene_counts(fx.genes(spark, sf_dir), fx.fragments(spark, sf_dir), BY)


@query(f"""{_COUNTS}, r AS (SELECT g.*, c.with_junction, c.without_junction, c.with_junction + c.without_junction AS total FROM genes g JOIN c USING (gene_id)),
t AS (SELECT *, CASE WHEN length <> 0 THEN total / length ELSE 0 END AS rate FROM r), s AS (SELECT CAST(sum(CAST(rate AS DECIMAL(30,12))) AS DOUBLE) AS s FROM t)
SELECT gene_id, gene_name, ref_id, strand, g_start, g_end, with_junction, without_junction, total, round(CASE WHEN s.s > 0 THEN 1e6 * rate / s.s ELSE 0 END, 3) AS tpm FROM t, s""")
def gene_tpm(spark, sf_dir):
    return expression.with_tpm(_gene_counts(spark, sf_dir), []).select("gene_id", "gene_name", "ref_id", "strand", "g_start", "g_end", "with_junction", "without_junction", "total", F.round("tpm", 3).alias("tpm"))


@query(f"{_COUNTS} SELECT gene_id, with_junction, without_junction, with_junction + without_junction AS total FROM c")
def gene_overlap_counts(spark, sf_dir):
    return _gene_counts(spark, sf_dir).select("gene_id", "with_junction", "without_junction", "total")


@query(f"SELECT g.gene_id, count(f.f_start) AS n FROM genes g LEFT JOIN fragments f ON {_OVERLAP} GROUP BY 1")
def overlap_prefix_count(spark, sf_dir):
    return intervals.overlap_counts(fx.genes(spark, sf_dir), fx.fragments(spark, sf_dir), BY, ("g_start", "g_end")).select("gene_id", "n")


@query("SELECT g.gene_id, count(f.f_start) AS swallowed FROM genes g LEFT JOIN fragments f ON g.ref_id = f.ref_id AND f.gap_start < g.g_start AND f.gap_end > g.g_end GROUP BY 1")
def gap_exclusion_counts(spark, sf_dir):
    return expression.gap_exclusions(fx.genes(spark, sf_dir), fx.fragments(spark, sf_dir), BY).select("gene_id", "swallowed")


@query("SELECT g.gene_id, count(*) FILTER (WHERE f.gap_start < g.g_start) - count(*) FILTER (WHERE f.gap_end <= g.g_end) AS n FROM genes g LEFT JOIN fragments f ON g.ref_id = f.ref_id AND f.gap_start IS NOT NULL GROUP BY 1")
def gap_outer_rank(spark, sf_dir):
    gaps = fx.fragments(spark, sf_dir).where("gap_start is not null")
    return intervals.outer_contained(fx.genes(spark, sf_dir), gaps, BY, ("g_start", "g_end"), ("gap_start", "gap_end")).select("gene_id", "n")


@query("SELECT g.gene_id, count(f.f_start) AS \"inner\" FROM genes g LEFT JOIN fragments f ON g.ref_id = f.ref_id AND f.gap_start >= g.g_start AND f.gap_start < g.g_end AND f.gap_end <= g.g_end GROUP BY 1")
def gap_inner_contain(spark, sf_dir):
    return expression.inner_gaps(fx.genes(spark, sf_dir), fx.fragments(spark, sf_dir), BY).select("gene_id", "inner")


@query("SELECT ref_id, j_start AS start, j_end AS \"end\", cnt AS count FROM junctions")
def junction_counts(spark, sf_dir):
    return junctions.junction_counts(fx.junction_rows(spark, sf_dir), BY)


@query("SELECT ref_id, j_start AS start, j_end AS \"end\", cnt AS count FROM junctions")
def junction_segmented_scan(spark, sf_dir):
    return junctions.junction_runs(fx.junction_rows(spark, sf_dir), BY)


_WIDE = f"w AS ({fx.GENES.format(w=30)}), m AS (SELECT e.ase_id, w.g_start, w.gene_id FROM events e JOIN w ON w.ref_id = e.ref_id AND e.out_start >= w.g_start AND e.out_start < w.g_end AND e.out_end <= w.g_end), k AS (SELECT *, row_number() OVER (PARTITION BY ase_id ORDER BY g_start) AS n FROM m)"


@query(f"{_WIDE}, l AS (SELECT ase_id, string_agg(CAST(gene_id AS VARCHAR), ',' ORDER BY g_start) AS genes FROM k WHERE n <= 5 GROUP BY 1) SELECT ase_id, coalesce(genes, 'null') AS genes FROM events LEFT JOIN l USING (ase_id)")
def event_gene_containment(spark, sf_dir):
    got = splicing.owners(fx.events(spark, sf_dir), fx.genes(spark, sf_dir, wide=True), BY)
    return got.select("ase_id", F.coalesce(F.array_join(F.col("genes").cast("array<string>"), ","), F.lit("null")).alias("genes"))


_MATCH = "LEFT JOIN junctions {a} ON {a}.ref_id = e.ref_id AND {a}.j_start = e.{s}_start AND {a}.j_end = e.{s}_end"
_ONE = f"n AS (SELECT e.ase_id, CAST(coalesce(i.cnt, 0) AS DOUBLE) AS count_in, CAST(coalesce(o.cnt, 0) AS DOUBLE) AS count_out, 1 AS k FROM events e {_MATCH.format(a='i', s='in1')} {_MATCH.format(a='o', s='out')})"
_TWO = f"n AS (SELECT e.ase_id, CAST(coalesce(i.cnt, 0) + coalesce(j.cnt, 0) AS DOUBLE) AS count_in, CAST(coalesce(o.cnt, 0) AS DOUBLE) AS count_out, 2 AS k FROM events e {_MATCH.format(a='i', s='in1')} {_MATCH.format(a='j', s='in2')} {_MATCH.format(a='o', s='out')})"
_PSI = "p AS (SELECT *, CASE WHEN count_in = 0 AND count_out = 0 THEN -1 ELSE count_in / k / (count_in / k + count_out) END AS psi FROM n)"
_SELECT = "SELECT ase_id, count_in, count_out, round(psi, 3) AS psi FROM p"


def _counted(spark, sf_dir, two: bool) -> DataFrame:
    counts = junctions.junction_counts(fx.junction_rows(spark, sf_dir), BY)
    return splicing.junction_support(fx.events(spark, sf_dir, two), counts, BY)


def _psi(spark, sf_dir, two: bool) -> DataFrame:
    return splicing.with_psi(_counted(spark, sf_dir, two), interval=False).select("ase_id", "count_in", "count_out", F.round("psi", 3).alias("psi"))


@query(f"{_TWO}, {_PSI} {_SELECT}")
def psi_se(spark, sf_dir):
    return _psi(spark, sf_dir, True)


@query(f"{_ONE}, {_PSI} {_SELECT}")
def psi_a3ss(spark, sf_dir):
    return _psi(spark, sf_dir, False)


@query(f"""v AS (SELECT e.ase_id, count(f.f_start) / 2 AS count_in FROM events e LEFT JOIN fragments f ON f.ref_id = e.ref_id AND NOT f.has_junction AND f.f_start <= e.in1_end AND f.f_end >= e.in1_start GROUP BY 1),
n AS (SELECT e.ase_id, CAST(v.count_in AS DOUBLE) AS count_in, CAST(coalesce(o.cnt, 0) AS DOUBLE) AS count_out, 1 AS k FROM events e JOIN v USING (ase_id) {_MATCH.format(a='o', s='out')}), {_PSI} {_SELECT}""")
def psi_ri(spark, sf_dir):
    counts = junctions.junction_counts(fx.junction_rows(spark, sf_dir), BY)
    got = splicing.retention_support(fx.events(spark, sf_dir, False), fx.fragments(spark, sf_dir), counts, BY)
    return splicing.with_psi(got, interval=False).select("ase_id", "count_in", "count_out", F.round("psi", 3).alias("psi"))


def _tail(a: str, b: str, x: str) -> str:
    """I_x(a, b) for a whole a and any b > 0, as one less the first terms of its series."""
    return f"(1 - list_sum([exp(lgamma({b} + j) - lgamma({b}) - lgamma(j + 1) + j * ln({x}) + {b} * ln(1 - {x})) for j in range(0, CAST({a} AS BIGINT))]))"


def _interval_sql(counts: str) -> str:
    return f"""{counts}, d AS (SELECT DISTINCT count_in / k AS i, count_out AS o FROM n WHERE count_in > 0 AND count_out > 0),
b AS (SELECT i, o, 0 AS step, 0.0::DOUBLE AS l1, 1.0::DOUBLE AS h1, 0.0::DOUBLE AS l2, 1.0::DOUBLE AS h2 FROM d UNION ALL
 SELECT i, o, step + 1, CASE WHEN u < 0.025 THEN m1 ELSE l1 END, CASE WHEN u < 0.025 THEN h1 ELSE m1 END, CASE WHEN v < 0.975 THEN m2 ELSE l2 END, CASE WHEN v < 0.975 THEN h2 ELSE m2 END
 FROM (SELECT *, (l1 + h1) / 2 AS m1, (l2 + h2) / 2 AS m2, {_tail('o', '(i + 1)', '((l1 + h1) / 2)')} AS u, {_tail('(o + 1)', 'i', '((l2 + h2) / 2)')} AS v FROM b WHERE step < 45)),
q AS (SELECT i, o, 1 - m1 AS ub, 1 - m2 AS lb FROM (SELECT *, (l1 + h1) / 2 AS m1, (l2 + h2) / 2 AS m2 FROM b WHERE step = 45)), {_PSI}
SELECT ase_id, round(psi, 3) AS psi, round(coalesce(lb, CASE WHEN count_in / k + count_out >= 5 THEN 1 ELSE 0 END), 3) AS psi_lb, round(coalesce(ub, 1), 3) AS psi_ub FROM p LEFT JOIN q ON q.i = p.count_in / k AND q.o = p.count_out"""


@query(_interval_sql(_ONE))
def psi_ci_a3ss(spark, sf_dir):
    return splicing.with_psi(_counted(spark, sf_dir, False)).select("ase_id", *[F.round(c, 3).alias(c) for c in ("psi", "psi_lb", "psi_ub")])


@query(_interval_sql(_TWO))
def psi_ci_se(spark, sf_dir):
    return splicing.with_psi(_counted(spark, sf_dir, True)).select("ase_id", *[F.round(c, 3).alias(c) for c in ("psi", "psi_lb", "psi_ub")])


for _name in ("psi_ci_a3ss", "psi_ci_se"):
    ORACLES[_name] = ORACLES[_name].replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"""x AS ({fx.FRAGMENTS.format(x=10)}), t AS (SELECT (CAST(ref_id AS BIGINT) << 32) + f_start AS s, (CAST(ref_id AS BIGINT) << 32) + f_end AS e FROM x),
l AS (SELECT gene_id, (CAST(ref_id AS BIGINT) << 32) + g_start AS gs, (CAST(ref_id AS BIGINT) << 32) + g_end AS ge FROM genes),
a AS (SELECT t.s, t.e, l.gene_id AS ga, l.ge AS end_a FROM t ASOF JOIN l ON t.s >= l.gs), b AS (SELECT a.*, l.gene_id AS gb, l.gs AS start_b FROM a ASOF JOIN l ON a.e >= l.gs)
SELECT ga AS gene_a, gb AS gene_b, count(*) AS count FROM b WHERE ga <> gb AND (start_b - end_a > 20 OR start_b - end_a < 0) GROUP BY 1, 2""")
def fusion_pairs(spark, sf_dir):
    return fusion.fusion_pairs(fx.genes(spark, sf_dir), fx.fragments(spark, sf_dir, 10), [], 20).select("gene_a", "gene_b", F.col("count").cast("long").alias("count"))


@query("SELECT ase_id, ref_id, out_start AS e_start FROM events")
def event_dedup(spark, sf_dir):
    return fx.events(spark, sf_dir).select("ase_id", "ref_id", "e_start")


def _typed_events(spark, sf_dir) -> DataFrame:
    return fx.raw_events(spark, sf_dir, True).selectExpr("ase_id", "concat('T', ase_id % 3) AS ase_type", "CAST(ase_id % 7 AS INT) AS file_idx", "e_start AS line_no")


@query("""r AS (SELECT ase_id, 'T' || (ase_id % 3) AS ase_type, CAST(ase_id % 7 AS INT) AS file_idx, out_start AS line_no FROM events_raw), d AS (SELECT *, row_number() OVER (PARTITION BY ase_id ORDER BY file_idx, line_no) AS n FROM r)
SELECT ase_id, ase_type, file_idx, line_no FROM d WHERE n = 1 AND file_idx = (SELECT min(file_idx) FROM r WHERE r.ase_type = d.ase_type)""")
def repeated_type(spark, sf_dir):
    return splicing.first_events(_typed_events(spark, sf_dir)).select("ase_id", "ase_type", "file_idx", "line_no")


def _exons(spark, sf_dir) -> DataFrame:
    return fx.fragments(spark, sf_dir).selectExpr("l_orderkey AS tx_id", "start", "end")


_EXONS = "x AS (SELECT l_orderkey AS tx_id, f_start AS s, f_end AS e FROM fragments), o AS (SELECT *, max(e) OVER (PARTITION BY tx_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY tx_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM o), merged AS (SELECT tx_id, min(s) AS s, max(e) AS e FROM i GROUP BY tx_id, isle)"


@query(f"{_EXONS} SELECT tx_id, s AS start, e AS \"end\" FROM merged")
def exon_merge(spark, sf_dir):
    return annotation.merged_exons(_exons(spark, sf_dir), ["tx_id"])


@query(f"{_EXONS}, t AS (SELECT tx_id, sum(e - s) AS n FROM merged GROUP BY 1) SELECT gene_id, CAST(coalesce(max(n), 0) AS BIGINT) AS length FROM genes LEFT JOIN t ON t.tx_id % 1000 = gene_id GROUP BY 1")
def gene_length(spark, sf_dir):
    exons = _exons(spark, sf_dir)
    return annotation.gene_lengths(fx.genes(spark, sf_dir), exons.selectExpr("tx_id", "tx_id % 1000 AS gene_id").distinct(), exons)


@query("""o AS (SELECT ref_id, gene_id, g_start, g_end, max(g_end) OVER (PARTITION BY ref_id ORDER BY g_start, g_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM genes)
SELECT ref_id, gene_id, CAST(sum(CASE WHEN reach IS NULL OR g_start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id ORDER BY g_start, g_end ROWS UNBOUNDED PRECEDING) AS BIGINT) AS locus FROM o""")
def locus_cluster(spark, sf_dir):
    tx = fx.genes(spark, sf_dir).selectExpr("ref_id", "gene_id", "g_start AS start", "g_end AS end")
    return annotation.loci(tx, BY).select("ref_id", "gene_id", F.col("locus").cast("long").alias("locus"))


@query("SELECT gene_id, (CAST(ref_id AS BIGINT) << 32) + g_start AS enc, ref_id AS ref, g_start AS pos FROM genes")
def encode_decode(spark, sf_dir):
    enc = coords.encode(F.col("ref_id"), F.col("g_start"))
    return fx.genes(spark, sf_dir).select("gene_id", enc.alias("enc"), coords.decode_ref(enc).alias("ref"), coords.decode_pos(enc).alias("pos"))


#: SAM-like records from lineitem: flags, NH, positions and CIGARs that take all branches of the filters.
_FLAG = "CAST(CASE WHEN l_linenumber % 2 = 1 THEN 65 ELSE 129 END + CASE WHEN l_suppkey % 11 = 0 THEN 256 ELSE 0 END + CASE WHEN l_partkey % 13 = 0 THEN 4 ELSE 0 END + CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 2 = 0 THEN 16 ELSE 0 END AS INT)"
_NH = "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 3 + 1 AS INT) END"
_CIGAR = "CASE l_linenumber % 4 WHEN 0 THEN '50M' WHEN 1 THEN '5S20M100N25M' WHEN 2 THEN '10M2I8M30N10M40N20M' ELSE '3H12M5D20M' END"


def _records(spark, sf_dir) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    got = li.selectExpr("'s' AS sample_id", "l_orderkey * 10 + l_linenumber AS ord", "concat('q', l_orderkey) AS qname", f"{_FLAG} AS flag", "CAST(l_partkey % 6 - 1 AS INT) AS ref_id", "l_partkey * 20 AS pos", "l_partkey * 20 + 40 AS mpos",
                       "CAST(l_linenumber % 3 - 1 AS INT) AS isize", "CAST(50 AS INT) AS l_seq", f"{_NH} AS nh", f"{_CIGAR} AS cigar_text")
    return got.withColumn("cigar", cigar.parse(F.col("cigar_text")))


_MAPPED = f"CAST(l_partkey % 6 - 1 AS INT) >= 0 AND ({_FLAG} & 4) = 0 AND ({_FLAG} & 1) = 1"


def _filter_query(name: str, policy: str, sql: str) -> None:
    def run(spark, sf_dir):
        kept = _records(spark, sf_dir).where(reads.mapped_in_layout(2) & reads.policy_filter(policy))
        return kept.groupBy("ref_id", "flag").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"))

    run.__name__ = name
    query(f"SELECT CAST(l_partkey % 6 - 1 AS INT) AS ref_id, {_FLAG} AS flag, count(*) AS n, CAST(sum(l_partkey * 20) AS BIGINT) AS pos FROM lineitem WHERE {_MAPPED} AND {sql} GROUP BY 1, 2")(run)


_filter_query("read_filter_unique", "unique", f"({_FLAG} & 256) = 0 AND coalesce({_NH}, 0) <= 1")
_filter_query("read_filter_primary", "primary", f"({_FLAG} & 256) = 0")
_filter_query("read_filter_multi", "multi", f"(({_FLAG} & 256) = 0 OR ({_FLAG} & 2) <> 0)")


_JS = "CASE l_linenumber % 4 WHEN 1 THEN [{s: 20, e: 120}] WHEN 2 THEN [{s: 20, e: 50}, {s: 60, e: 100}] ELSE [] END"


@query(f"j AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_partkey * 20 + 1 AS start, unnest({_JS}) AS x FROM lineitem) SELECT ord, start + x.s - 1 AS j_start, start + x.e AS j_end FROM j")
def cigar_junctions(spark, sf_dir):
    js = _records(spark, sf_dir).select("ord", (F.col("pos") + 1).alias("start"), F.explode(cigar.junction_offsets(F.col("cigar"))).alias("j"))
    return js.select("ord", (F.col("start") + F.col("j.s") - 1).alias("j_start"), (F.col("start") + F.col("j.e")).alias("j_end"))


@query("SELECT l_orderkey * 10 + l_linenumber AS ord, CAST(CASE l_linenumber % 4 WHEN 0 THEN 50 WHEN 1 THEN 145 WHEN 2 THEN 118 ELSE 37 END AS BIGINT) AS span FROM lineitem")
def cigar_span(spark, sf_dir):
    return _records(spark, sf_dir).select("ord", cigar.reference_length(F.col("cigar")).cast("long").alias("span"))


@query("SELECT 'q' || l_orderkey || CASE l_linenumber % 5 WHEN 0 THEN '.3' WHEN 4 THEN '.1.2x' ELSE '' END AS name, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1")
def qname_strip(spark, sf_dir):
    mark = F.element_at(F.array(*[F.lit(x) for x in (".3", "/1", ".1", ".2", ".1.2x")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("q"), F.col("l_orderkey"), mark).alias("qname"), "l_linenumber")
    return li.groupBy(reads.bare_name(F.col("qname")).alias("name")).agg(F.count("*").alias("n"))


def _mates(spark, sf_dir) -> DataFrame:
    """Pairs of a record and its mate from orders: both mapped to one reference, every third with junctions on both sides."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", "o_custkey AS c")
    base = o.selectExpr("'s' AS sample_id", "concat('q', k) AS qname", "CAST(k % 4 AS INT) AS ref_id", "c * 100 AS at", "k", "c", "k % 3 AS r")
    one = base.selectExpr("sample_id", "k * 2 AS ord", "qname", "CAST(67 + CASE WHEN c % 2 = 0 THEN 16 ELSE 0 END AS INT) AS flag", "ref_id", "at AS pos", "at + 30 AS mpos", "CAST(1 AS INT) AS isize", "50 AS l_seq", "CAST(1 AS INT) AS nh", "CASE WHEN r = 0 THEN '40M120N10M' ELSE '50M' END AS t")
    two = base.selectExpr("sample_id", "k * 2 + 1 AS ord", "qname", "CAST(131 + CASE WHEN c % 3 = 0 THEN 16 ELSE 0 END AS INT) AS flag", "ref_id", "at + 30 + c % 5 * 10 AS pos", "at AS mpos", "CAST(-1 AS INT) AS isize", "50 AS l_seq", "CAST(1 AS INT) AS nh", "CASE WHEN r = 0 AND c % 5 = 0 THEN '10M120N40M' WHEN r = 0 THEN '20M60N30M' ELSE '50M' END AS t")
    return one.unionByName(two).withColumn("cigar", cigar.parse(F.col("t"))).drop("t")


_MATES = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 3 AS r FROM orders), m AS (SELECT k, c, CAST(k % 4 AS INT) AS ref_id, c*100 + 1 AS s1, c*100 + 51 + CASE WHEN r = 0 THEN 120 ELSE 0 END AS e1,
 c*100 + 31 + c % 5 * 10 AS s2, c*100 + 81 + c % 5 * 10 + CASE WHEN r = 0 AND c % 5 = 0 THEN 120 WHEN r = 0 THEN 60 ELSE 0 END AS e2, r FROM o)"""


@query(f"""{_MATES} SELECT ref_id, least(s1, s2) AS start, greatest(e1, e2) AS "end", CASE WHEN e1 < s2 THEN e1 ELSE -1 END AS gap_start, CASE WHEN e1 < s2 THEN s2 ELSE -1 END AS gap_end,
 CAST(CASE WHEN r <> 0 THEN 0 WHEN c % 5 = 0 THEN 1 ELSE 2 END AS INT) AS n_junctions, count(*) AS n FROM m WHERE NOT (c % 2 = 0 AND c % 3 <> 0) GROUP BY ALL""")
def mate_pairs(spark, sf_dir):
    f = reads.fragments(_mates(spark, sf_dir), Options(strandness=1))
    return f.fillna(-1, ["gap_start", "gap_end"]).groupBy("ref_id", "start", "end", "gap_start", "gap_end", F.size("js").alias("n_junctions")).agg(F.count("*").alias("n"))


def _keyed_records(spark, sf_dir) -> DataFrame:
    """The same pairs with the mate's position on both sides, so that a key of name and positions finds them in any order."""
    both = _mates(spark, sf_dir)
    other = both.select("sample_id", "qname", F.col("pos").alias("other"), (F.col("flag").bitwiseAND(64) == 0).alias("is_first"))
    return both.withColumn("is_first", F.col("flag").bitwiseAND(64) != 0).join(other, ["sample_id", "qname", "is_first"]).withColumn("mpos", F.col("other")).drop("other", "is_first")


@query(f"""{_MATES} SELECT ref_id, least(s1, s2) AS start, greatest(e1, e2) AS "end", count(*) AS n FROM m GROUP BY ALL""")
def mate_pairs_keyed(spark, sf_dir):
    f = reads.fragments(_keyed_records(spark, sf_dir), Options(pairing="keyed"))
    return f.groupBy("ref_id", "start", "end").agg(F.count("*").alias("n"))


@query(f"""{_MATES}, p AS (SELECT k, least(s1, s2) AS start, s1, s2, c FROM m WHERE r = 0), j AS (SELECT k, s1 + 40 - 1 AS a, s1 + 160 AS b FROM p UNION SELECT k, s2 + CASE WHEN c % 5 = 0 THEN 10 ELSE 20 END - 1, s2 + CASE WHEN c % 5 = 0 THEN 130 ELSE 80 END FROM p)
SELECT CAST(k % 4 AS INT) AS ref_id, a AS start, b AS "end", count(*) AS count FROM j GROUP BY ALL""")
def mate_union(spark, sf_dir):
    return junctions.junction_counts(reads.fragment_junctions(reads.fragments(_mates(spark, sf_dir))), ["ref_id"])
