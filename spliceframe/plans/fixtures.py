"""Genes, fragments, junctions and events derived from the part and lineitem tables, for queries that have a SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_START = "l_partkey * 20 + l_suppkey % 7 - 3"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def genes(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS gene_id", "p_name AS gene_name", "CAST(p_partkey % 5 AS INT) AS ref_id", "CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand",
        "p_partkey * 20 AS g_start", f"p_partkey * 20 + p_size * {30 if wide else 3} AS g_end", "CAST(p_size * 50 AS BIGINT) AS length",
    )


def fragments(spark: SparkSession, sf_dir: str, stretch: int = 1) -> DataFrame:
    q = "CAST(l_quantity AS BIGINT)"
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CAST(l_partkey % 5 AS INT) AS ref_id", f"{_START} AS start", f"{_START} + {q} * {stretch} AS end", "l_returnflag = 'R' AS has_junction",
        "CASE WHEN l_linestatus = 'F' AND l_quantity >= 12 THEN l_partkey * 20 + l_suppkey % 7 - 1 END AS gap_start",
        f"CASE WHEN l_linestatus = 'F' AND l_quantity >= 12 THEN l_partkey * 20 + l_suppkey % 7 - 5 + {q} END AS gap_end",
    )


def junction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments(spark, sf_dir).where("has_junction").selectExpr("ref_id", "start + 2 AS start", "start + 2 + (l_linenumber % 3 + 1) * 10 AS end")


def raw_events(spark: SparkSession, sf_dir: str, two: bool) -> DataFrame:
    """Events with one span in, or two; ase_id repeats."""
    span = "named_struct('s', start + 2, 'e', start + {})"
    inn = f"array({span.format(12)}" + (f", {span.format(22)})" if two else ")")
    return fragments(spark, sf_dir).where("l_linenumber = 1").selectExpr("ref_id", "l_orderkey * 10 + l_linenumber AS ase_id", "start + 2 AS e_start", "start + 32 AS e_end", f"array({span.format(32)}) AS out", f"{inn} AS inn")


def events(spark: SparkSession, sf_dir: str, two: bool = True) -> DataFrame:
    from spliceframe.operators.splicing import first_events

    return first_events(raw_events(spark, sf_dir, two).selectExpr("*", "'SE' AS ase_type", "0 AS file_idx", "e_start AS line_no")).drop("ase_type", "file_idx", "line_no")


GENES = "SELECT p_partkey AS gene_id, p_name AS gene_name, CAST(p_partkey % 5 AS INT) AS ref_id, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey*20 AS g_start, p_partkey*20 + p_size*{w} AS g_end, CAST(p_size*50 AS BIGINT) AS length FROM part"
FRAGMENTS = """SELECT l_orderkey, l_linenumber, CAST(l_partkey % 5 AS INT) AS ref_id, l_partkey*20 + l_suppkey % 7 - 3 AS f_start, l_partkey*20 + l_suppkey % 7 - 3 + CAST(l_quantity AS BIGINT)*{x} AS f_end,
 l_returnflag = 'R' AS has_junction, CASE WHEN l_linestatus='F' AND l_quantity>=12 THEN l_partkey*20 + l_suppkey % 7 - 1 END AS gap_start,
 CASE WHEN l_linestatus='F' AND l_quantity>=12 THEN l_partkey*20 + l_suppkey % 7 - 5 + CAST(l_quantity AS BIGINT) END AS gap_end FROM lineitem"""
VIEWS = f"""genes AS ({GENES.format(w=3)}), fragments AS ({FRAGMENTS.format(x=1)}),
junctions AS (SELECT ref_id, f_start+2 AS j_start, f_start+2+(l_linenumber%3+1)*10 AS j_end, count(*) AS cnt FROM fragments WHERE has_junction GROUP BY 1,2,3),
events_raw AS (SELECT ref_id, l_orderkey*10+l_linenumber AS ase_id, f_start+2 AS out_start, f_start+32 AS out_end, f_start+2 AS in1_start, f_start+12 AS in1_end, f_start+2 AS in2_start, f_start+22 AS in2_end FROM fragments WHERE l_linenumber = 1),
events AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY ase_id ORDER BY out_start) AS n FROM events_raw) WHERE n = 1)"""
