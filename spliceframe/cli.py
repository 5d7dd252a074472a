"""python -m spliceframe.cli prepare|quantify ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from spliceframe.model import ASE_TYPES, Options
from spliceframe.plans import quantify


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spliceframe")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("prepare", help="gene lines and length table of an annotation")
    p.add_argument("-g", "--gene", required=True)
    p.add_argument("-o", "--output", default="./")
    q = sub.add_parser("quantify", help="gene and splicing tables of alignments")
    q.add_argument("-g", "--gene", required=True)
    q.add_argument("-l", "--length", required=True)
    q.add_argument("-x", "--ase-types", required=True)
    q.add_argument("-y", "--ase-files", required=True)
    q.add_argument("-r", "--read", required=True, help="a file, several separated by commas, or with --list a list of them")
    q.add_argument("--list", action="store_true")
    q.add_argument("-o", "--output", default="./")
    q.add_argument("-a", "--read-max-gap", type=int, default=500_000)
    q.add_argument("-q", "--gene-max-gap", type=int, default=500_000)
    q.add_argument("-m", "--mode", type=int, choices=(1, 2), default=2)
    q.add_argument("-s", "--strandness", type=int, choices=(0, 1, 2), default=0)
    q.add_argument("-M", "--multi-mapping", action="store_true")
    q.add_argument("-p", "--primary", action="store_true")
    q.add_argument("--pairing", choices=("adjacent", "keyed"), default="adjacent")
    return top


def event_files(types: str, files: str) -> list[tuple[str, str]]:
    kinds, paths = types.split(","), files.split(",")
    if len(kinds) != len(paths):
        raise SystemExit("as many event files as event types are needed")
    if unknown := [k for k in kinds if k not in ASE_TYPES]:
        raise SystemExit(f"unknown event types: {', '.join(unknown)}")
    return list(zip(kinds, paths))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("spliceframe").getOrCreate()
    if a.command == "prepare":
        quantify.prepare(spark, a.gene, a.output)
        return
    files = event_files(a.ase_types, a.ase_files)
    read = ",".join(r[0] for r in quantify.tables.sample_list(spark, a.read).select("path").collect()) if a.list else a.read  # file names, as many as samples
    opt = Options(mode=a.mode, strandness=a.strandness, max_gap=a.read_max_gap, multi=a.multi_mapping, primary=a.primary, pairing=a.pairing, gene_max_gap=a.gene_max_gap)
    quantify.run(spark, a.gene, a.length, files, read, a.output, opt)


if __name__ == "__main__":
    main()
