"""Percent spliced in, and its interval from quantiles of the beta distribution.

Spark has neither a log-gamma nor a beta function, so quantiles come from one Arrow function over the distinct pairs of a batch:
Newton steps on the regularised incomplete beta, kept inside a bracket that is halved when a step would leave it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

LOWER, UPPER, NEAR_ZERO, ENOUGH = 0.975, 0.025, 1e-5, 5.0


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series ten places further on, less the factors in between."""
    x = np.asarray(x, float)
    y = x + 10
    below = np.log(np.prod([x + k for k in range(10)], axis=0))
    far = x > 1e6  # the product would run out of range, and the series needs no shift
    y, below = np.where(far, x, y), np.where(far, 0, below)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta, from the back; on this side of the mean its length needed grows with the root of the parameters."""
    terms = 40 + int(6 * np.sqrt(max(a.max(initial=1), b.max(initial=1))))
    f = np.ones_like(x)
    for m in range(terms, 0, -1):
        f = 1 + m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) / f
        f = 1 - (a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1)) / f
    return 1 / f


def regularized_beta(a, b, x) -> np.ndarray:
    """I_x(a, b) for a, b > 0."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1) / (a + b + 2)
    p, q, y = np.where(low, a, b), np.where(low, b, a), np.where(low, inner, 1 - inner)
    part = front * _fraction(p, q, y) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, part, 1 - part)))


def beta_quantile(p: float, a, b) -> np.ndarray:
    """The x with I_x(a, b) = p. A parameter of 0 puts all weight on its end: a = 0 gives 0, b = 0 gives 1.

    Pairs are solved in classes of like size, as the fraction's length goes by the largest, and leave once they are found."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    out = np.where(a <= 0, 0.0, 1.0)
    ok = np.flatnonzero((a > 0) & (b > 0))
    size = np.floor(np.log2(np.maximum(np.maximum(a[ok], b[ok]), 1)) / 2)
    for c in np.unique(size):
        own = ok[size == c]
        out[own] = _solved(p, a[own], b[own])
    return out


def _solved(p: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    lo, hi, x = np.zeros_like(u), np.ones_like(u), u / (u + v)
    scale, open_ = _lgamma(u + v) - _lgamma(u) - _lgamma(v), np.arange(len(u))
    for _ in range(200):
        y = x[open_]
        err = regularized_beta(u[open_], v[open_], y) - p
        lo[open_], hi[open_] = np.where(err < 0, y, lo[open_]), np.where(err >= 0, y, hi[open_])
        low, high = lo[open_], hi[open_]
        slope = np.exp(scale[open_] + (u[open_] - 1) * np.log(np.clip(y, 1e-300, None)) + (v[open_] - 1) * np.log1p(-np.clip(y, None, 1 - 1e-16)))
        flat = np.abs(err) >= slope  # such a step would leave the bracket
        new = y - np.where(flat, 0, err) / np.where(flat, 1, slope)
        new = np.where((new >= low) & (new <= high) & ~flat, new, (low + high) / 2)
        x[open_] = new
        # Steps below what I_x can tell apart, or a bracket that has closed.
        going = (np.abs(new - y) > 1e-12 * new + 1e-300) & (np.abs(err) > 1e-15) & (high - low > 1e-12 * high)
        open_ = open_[going]
        if not len(open_):
            break
    return x


def _bounds(count_in: pa.Array, count_out: pa.Array) -> pa.Array:
    pairs = np.stack([count_in.to_numpy(zero_copy_only=False).astype(float), count_out.to_numpy(zero_copy_only=False).astype(float)], axis=1)
    pairs = np.nan_to_num(pairs)
    one, back = np.unique(pairs, axis=0, return_inverse=True)
    back = back.reshape(-1)
    if not len(one):
        one = np.zeros((0, 2))
    ub = 1 - beta_quantile(UPPER, one[:, 1], one[:, 0] + 1)
    lb = 1 - beta_quantile(LOWER, one[:, 1] + 1, one[:, 0])
    return pa.StructArray.from_arrays([pa.array(lb[back]), pa.array(ub[back])], ["lb", "ub"])


def psi(count_in: Column, count_out: Column) -> Column:
    """count_in / (count_in + count_out), -1 when both are 0, null where a count is."""
    return F.when((count_in == 0) & (count_out == 0), F.lit(-1.0)).otherwise(F.try_divide(count_in, count_in + count_out))


def interval(count_in: Column, count_out: Column) -> Column:
    """struct(lb, ub) at 95 %. With next to nothing on one side it is (1, 1) from ENOUGH counts on, else (0, 1)."""
    edge = (F.abs(count_in) < NEAR_ZERO) | (F.abs(count_out) < NEAR_ZERO)
    fixed = F.struct(F.when(count_in + count_out >= ENOUGH, 1.0).otherwise(0.0).alias("lb"), F.lit(1.0).alias("ub"))
    return F.when(edge, fixed).otherwise(arrow_udf(_bounds, "struct<lb:double,ub:double>")(count_in.cast("double"), count_out.cast("double")))
