"""Coordinates: one number line over all references, and span arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 32


def encode(ref_id: Column, pos: Column) -> Column:
    return F.shiftleft(ref_id.cast("long"), _BITS) + pos


def decode_ref(enc: Column) -> Column:
    return F.shiftright(enc, _BITS).cast("int")


def decode_pos(enc: Column) -> Column:
    return enc.bitwiseAND(F.lit((1 << _BITS) - 1))


def span_min(*spans: Column) -> Column:
    """The least coordinate of several span arrays."""
    return F.array_min(F.concat(*[F.transform(s, lambda x: F.least(x["s"], x["e"])) for s in spans]))


def span_max(*spans: Column) -> Column:
    return F.array_max(F.concat(*[F.transform(s, lambda x: F.greatest(x["s"], x["e"])) for s in spans]))


def pair_up(points: Column) -> Column:
    """[a, b, c, d] to [(a, b), (c, d)]; a last odd point is left out."""
    n = F.floor(F.size(points) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.get(points, 2 * i - 2).alias("s"), F.get(points, 2 * i - 1).alias("e")))
    return F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))
