"""CIGAR strings and arrays in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_JUNCTIONS = "array<struct<s:bigint,e:bigint>>"
_ON_REFERENCE = ("M", "D", "N", "=", "X")


def parse(text: Column) -> Column:
    """'2S48M' to [(S, 2), (M, 48)]; '*' and null to an empty array."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"))
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.substring(p, F.lit(1), F.length(p) - 1).cast("int").alias("len")))


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that the alignment spans; an alignment without any spans 1."""
    n = F.aggregate(cigar, F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"].isin(*_ON_REFERENCE), x["len"]).otherwise(0))
    return F.greatest(n, F.lit(1).cast("long"))


def junction_offsets(cigar: Column, ref_consuming_only: bool = False) -> Column:
    """Skipped stretches (N) as offsets from the read's start, counted from the first M on.

    Every operation's length moves the offset, or with ref_consuming_only just those that lie on the reference."""
    start = F.struct(F.lit(False).alias("on"), F.lit(0).cast("long").alias("at"), F.array().cast(_JUNCTIONS).alias("js"))

    def step(acc: Column, x: Column) -> Column:
        moves = F.when(x["op"].isin(*_ON_REFERENCE), x["len"]).otherwise(0) if ref_consuming_only else x["len"]
        on = acc["on"] | (x["op"] == "M")
        here = F.struct(acc["at"].alias("s"), (acc["at"] + x["len"]).alias("e"))
        return F.struct(
            on.alias("on"),
            F.when(on, acc["at"] + moves).otherwise(acc["at"]).cast("long").alias("at"),
            F.when(acc["on"] & (x["op"] == "N"), F.concat(acc["js"], F.array(here))).otherwise(acc["js"]).cast(_JUNCTIONS).alias("js"),
        )

    # Most reads skip nothing and need no walk.
    return F.when(F.exists(cigar, lambda x: x["op"] == "N"), F.aggregate(cigar, start, step, lambda a: a["js"])).otherwise(F.array().cast(_JUNCTIONS))
