"""PCA whitening of embeddings whose covariance is taken over exactly centred rows.

Components become whole numbers, x = floor(SCALE * c) + OFFSET, so sums are exact. With n distinct vectors and sums S, n * x - S is exact as well; divided by n
it is a row of a RowMatrix, and the Gramian of those rows over n is the covariance: nothing is subtracted after multiplying. Rows meet in sums of
d and of d * d numbers only; the driver holds one d x d matrix, whose eigenvectors go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceframe.llm.common import Workspace

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries from here on have no x within 64 bits.
_MOST = 2.0**62 / SCALE
#: An eigenvalue this small beside the largest is rounding: its direction has no spread to divide by.
_FLAT = 1e-13


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums s were fitted; base is floor(s / n), span the largest distance of an x from it. vectors: a unit eigenvector for each column, by falling eigenvalue."""

    n: int
    s: tuple[int, ...]
    base: tuple[int, ...]
    span: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as 64-bit numbers, or as Python's where those could run over."""
        kind = np.int64 if self.n * (self.span + 1) < 1 << 62 else object
        off = np.array([s - self.n * b for s, b in zip(self.s, self.base)], kind)
        return (x - np.array(self.base, np.int64)).astype(kind) * kind(self.n) - off if kind is np.int64 else (x.astype(object) - np.array(self.base, object)) * self.n - off

    def squares(self, y: np.ndarray) -> list[int]:
        """Sums of squares of the rows of deviations(), exactly."""
        if y.dtype == object or len(self.s) * (self.n * (self.span + 1)) ** 2 >= 1 << 63:
            y = y.astype(object)
        return [int(v) for v in (y * y).sum(1)]

    def whitened(self, y: np.ndarray, components: int) -> np.ndarray:
        """Of the rows of deviations(): x - S / n projected on the components that have spread, over the root of their eigenvalue."""
        k = self.spread(components)
        return (y / self.n).astype(np.float64) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))

    def spread(self, components: int) -> int:
        """How many of the first components have spread."""
        return int((self.values[:components] > _FLAT * max(self.trace, 0.0)).sum())


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column])


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch and dimension: sum as text (it may pass 64 bits), least and greatest x, rows."""
    for pdf in batches:
        if len(pdf):
            x = _matrix(pdf["x"])
            low, high = x.min(0), x.max(0)
            wide = max(abs(int(low.min())), abs(int(high.max()))) * len(x) >= 1 << 62
            total = x.astype(object).sum(0) if wide else x.sum(0)
            yield pd.DataFrame({"at": np.arange(x.shape[1]), "s": [str(int(v)) for v in total], "low": low, "high": high, "n": len(x)})


def quantised(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, x (array<long>) of rows whose vector isn't null, has entries, and holds finite ones only.

    Entries that a vector lacks to the longest one count as 0. An entry of 2**56 or more has no x within 64 bits; it counts as not finite."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where("e is not null and size(e) > 0")
    v = v.where(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _MOST)))
    return v.select("vec_id", F.transform("e", lambda c: F.floor(c * float(SCALE)) + OFFSET).cast("array<bigint>").alias("x"))


def _gramian(rows: DataFrame, n: int, d: int) -> np.ndarray:
    """rows(v array<double>): the sum of their outer products, summed by a tree of tasks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors, n, d).computeGramianMatrix().toArray()


def fit(distinct: DataFrame) -> Whitening | None:
    """distinct(x): each vector once, all of one length. None without rows."""
    per = distinct.mapInPandas(_sums, "at int, s string, low long, high long, n long").groupBy("at")
    rows = per.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("at").collect()  # one for each dimension
    if not rows:
        return None
    n, s = rows[0]["n"], [int(r["s"]) for r in rows]
    base = [v // n for v in s]
    span = max(max(r["high"] - b, b - r["low"]) for r, b in zip(rows, base))
    if n * (span + 1) < 1 << 62:
        parts = F.zip_with(F.zip_with("x", F.lit(base), lambda x, b: (x - b) * n), F.lit([v - n * b for v, b in zip(s, base)]), lambda y, off: (y - off).cast("double") / n)
    else:
        wide = lambda c: c.cast("decimal(38,0)")
        parts = F.transform(F.arrays_zip("x", F.lit(base).alias("b"), F.lit([v - n * b for v, b in zip(s, base)]).alias("o")), lambda z: ((wide(z["x"]) - wide(z["b"])) * wide(F.lit(n)) - wide(z["o"])).cast("double") / n)
    v = _gramian(distinct.select(parts.alias("v")), n, len(s)) / n
    values, vectors = np.linalg.eigh(v)
    return Whitening(n, tuple(s), tuple(base), span, np.maximum(values[::-1], 0), vectors[:, ::-1], float(np.trace(v)))


def identity_error(distinct: DataFrame, model: Whitening, components: int, ws: Workspace) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over the components that have spread; None if none has.

    Measured on the whitened rows themselves: their means are taken first and subtracted before multiplying."""
    k = model.spread(components)
    if not k:
        return None
    held = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"w": list(held.value.whitened(held.value.deviations(_matrix(pdf["x"])), components))})

    white = ws.save(distinct.mapInPandas(run, "w array<double>"), "white")
    means = list(white.agg(*[F.avg(F.get("w", F.lit(i))) for i in range(k)]).first())
    gram = _gramian(white.select(F.zip_with("w", F.lit(means), lambda w, m: w - m).alias("v")), model.n, k) / model.n
    return float(np.abs(gram - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, ws: Workspace | None = None) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error: a row for each usable row and component.

    Components are the first ones by falling eigenvalue, as many as there are dimensions at most. One without spread (fewer distinct vectors than dimensions, or one vector
    alone) has a null whitened; with no spread at all explained and identity_error are null. Which rows are usable: quantised(). A null or repeated vec_id is kept row by row;
    other columns are unread. A deviation of more than 38 digits is null. No usable rows give no rows."""
    spark = vectors.sparkSession
    ws = ws or Workspace(spark, "whitening")
    rows = quantised(vectors)
    short_, long_ = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    kind = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double".format(rows.schema["vec_id"].dataType.simpleString())
    if long_ is None:
        return spark.createDataFrame([], kind)
    if short_ < long_:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(OFFSET).cast("bigint"), F.lit(long_) - F.size("x"))))
    distinct = ws.save(rows.select("x").distinct(), "distinct")
    model = fit(distinct)
    components = min(components, long_)
    error = identity_error(distinct, model, components, ws)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                y = held.value.deviations(_matrix(pdf["x"]))
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "deviation": [str(v) for v in held.value.squares(y)], "w": list(held.value.whitened(y, components))})

    out = rows.mapInPandas(run, "vec_id {}, deviation string, w array<double>".format(rows.schema["vec_id"].dataType.simpleString()))
    shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values[:components]]
    each = F.posexplode(F.array(*[F.lit(v).cast("double") for v in shares])).alias("at", "explained")
    out = out.select("vec_id", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "w", each)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.get("w", F.col("at")).alias("whitened"), "explained", F.lit(error).cast("double").alias("identity_error"))
