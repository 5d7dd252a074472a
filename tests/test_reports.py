"""One ordered file for each group, all of a table at once or nothing of it."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spliceframe.sources import sinks
from spliceframe.sources.reports import write_reports


def texts(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(path) for f in names}


def test_one_file_for_each_group_in_order(spark, tmp_path):
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 7).alias("sample"), F.concat(F.lit("T"), F.col("id") % 2).alias("kind"), (3000 - F.col("id")).alias("v"), F.lit("a\tb\n").alias("t"), F.col("id").alias("_at"))
    path = str(tmp_path / "out")
    for limit in (3000, 100):  # a table is replaced as a whole
        write_reports(rows.where(f"_at < {limit}").repartition(11), path, ["sample"], ["_at"], ["kind"], ["_at"])
        got = texts(path)
        want = {f"kind=T{k}/s{s}.tsv": "sample\tv\tt\n" + "".join(f"s{s}\t{3000 - i}\ta b \n" for i in range(limit) if i % 7 == s and i % 2 == k) for s in range(7) for k in range(2)}
        assert got == want
    read = spark.read.option("header", True).option("sep", "\t").csv(path)
    assert read.count() == 100 and set(read.columns) == {"sample", "v", "t", "kind"}
    write_reports(rows.where("_at < 0"), path, ["sample"], ["_at"], ["kind"], ["_at"])
    assert texts(path) == {}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(500).select(F.concat(F.lit("s"), F.col("id") % 5).alias("sample"), "id")
    write_reports(rows.where("id < 10"), path, ["sample"], ["id"])
    before = texts(path)
    bad = rows.withColumn("id", F.when(F.col("id") == 250, F.raise_error("broken")).otherwise(F.col("id")).cast("long"))
    with pytest.raises(PySparkException, match="broken"):
        write_reports(bad, path, ["sample"], ["id"])
    assert texts(path) == before and len(before) == 5 and not [d for d in os.listdir(path) if d.startswith("_writing")]


def test_names_that_are_no_file_names(spark, tmp_path):
    rows = spark.createDataFrame([("../a/b", 1), (None, 2), ("..", 3), ("x%2f y", 4)], "sample string, v int")
    write_reports(rows, str(tmp_path / "out"), ["sample"], ["v"])
    assert set(texts(tmp_path / "out")) == {"__a_b.tsv", "null.tsv", "_.tsv", "x_2f_y.tsv"}


def test_event_and_gene_reports(spark, tmp_path):
    psi = spark.createDataFrame([("SE", "s1", 1, 50, "E2", 1.0, 2.0, 0.3, 0.1, 0.5), ("SE", "s1", 0, 90, "E1", 1.0, 2.0, float("nan"), 0.1, 0.5), ("RI", "s2", 0, 9, "E3", 0.0, 0.0, -1.0, 0.0, 1.0)], "ase_type string, sample_id string, ref_id int, e_start long, ase_id string, count_in double, count_out double, psi double, psi_lb double, psi_ub double")
    owners = spark.createDataFrame([("E1", ["G1", "G2"]), ("E2", None), ("E3", ["G2"])], "ase_id string, genes array<string>")
    genes = spark.createDataFrame([("G1", "one"), ("G2", "two"), ("G2", "two")], "gene_id string, gene_name string")
    sinks.write_event_reports(psi, owners, genes, str(tmp_path / "ase"), ["sample_id"])
    head = "sample_id\tase_id\tgene_id\tgene_name\tcount_in\tcount_out\tpsi\tpsi_lb\tpsi_ub\n"
    assert texts(tmp_path / "ase") == {
        "ase_type=SE/s1.tsv": head + "s1\tE1\tG1,G2\tone,two\t1.000\t2.000\tnan\t0.100\t0.500\ns1\tE2\tnull\tnull\t1.000\t2.000\t0.300\t0.100\t0.500\n",
        "ase_type=RI/s2.tsv": head + "s2\tE3\tG2\ttwo\t0.000\t0.000\t-1.000\t0.000\t1.000\n",
    }
