"""Shared pieces: tables in the cluster's shared folder, and word splitting on ASCII white space."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode (tests) without one, a folder of our own. Elsewhere such a folder would be one machine's."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


class Workspace:
    """Written tables that cut lineage. They stand in the shared folder, so they survive lost executors, and go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        path, fs = self._fs(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
        fs.deleteOnExit(path)
        # With its scheme, as tasks that write files themselves don't know Spark's default one.
        self.root = re.sub(r"^(\w+):/(?!/)", r"\1:///", fs.makeQualified(path).toString())

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._saved_at = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later step reads."""
        for t in tables:
            path, fs = self._fs(t._saved_at)
            fs.delete(path, True)


def release() -> None:
    """Gives memory that this worker has freed back to the system: workers are used again by later stages, and what the allocators of Arrow and C keep would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def released(run):
    """A function of batches that gives memory back when its task is through."""

    @functools.wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return out


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """bytes.split() splits on exactly the six ASCII white-space characters and bytes.lower() changes A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The 64-bit hash of each run of n word hashes, by doubling; one for each start."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    base, level, width, out, have = _BASE, h, 1, None, 0
    mask, rest = (1 << 64) - 1, n
    starts = len(h) - n + 1
    while rest:
        if rest & 1:
            part = level[have : have + starts]
            out = part.copy() if out is None else out * np.uint64(base) + part
            have += width
        rest >>= 1
        if rest:
            level = level[:-width] * np.uint64(base) + level[width:]
            base, width = (base * base) & mask, width * 2
    return mix(out)
