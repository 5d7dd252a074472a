"""Mixing sources to target weights by Pareto order sampling.

Targets are filled like vessels: each source gets its weight's share of all words, stops at CAP times its own words, and what is
left over is shared anew among the others. Within a source a document's expected copies follow an inclusion weight (the size's
power of two, to the power FAVOUR: longer documents somewhat more), again stopping at CAP. Its certain whole copies are the
integer part. For the rest each document draws a uniform number u from a hash of its own row; documents are ranked by
[u / (1 - u)] / [p / (1 - p)], p the fraction left, and taken in that order while the source's words last; one more document, whose size fits what is missing best, closes the sample.
The rank's cut is found on a histogram by source, then within one bin of it; no source is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceframe.llm.common import Workspace, word_count

WEIGHTS, CAP, FAVOUR, BINS, SEED = (5, 2, 1), 3, 0.125, 4096, 20


def _fill(rows: DataFrame, by: list[str], order: list[Column], weight: Column, cap: Column, total: Column, out: str) -> DataFrame:
    """Shares total among the rows of each group in proportion to weight; none gets more than cap, the excess goes to the others."""
    rows = rows.withColumns({"_w": weight.cast("double"), "_c": cap.cast("double"), "_t": total.cast("double")})
    group = Window.partitionBy(*by)
    before = group.orderBy(F.when(F.col("_w") > 0, F.col("_c") / F.nullif(F.col("_w"), F.lit(0.0))).asc_nulls_first(), *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_cb": F.coalesce(F.sum("_c").over(before), F.lit(0.0)), "_wb": F.coalesce(F.sum("_w").over(before), F.lit(0.0)), "_ws": F.sum("_w").over(group)})
    level = F.try_divide(F.col("_t") - F.col("_cb"), F.col("_ws") - F.col("_wb"))
    fits = (F.col("_w") > 0) & (F.col("_ws") > F.col("_wb")) & (F.col("_c") >= F.col("_w") * level)
    rows = rows.withColumn("_l", F.max(F.when(fits, level)).over(group))  # that of the first row that fits: it only falls among those that follow
    rows = rows.withColumn(out, F.least(F.col("_c"), F.coalesce(F.col("_w") * F.col("_l"), F.col("_c"))))
    return rows.drop("_w", "_c", "_t", "_cb", "_wb", "_ws", "_l")


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, size) -> source, source_size, target. One row for each source; a null source counts as one and comes last."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("rank", rank).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = _fill(s.withColumn("weight", weight), [], [F.col("rank")], F.col("weight"), CAP * F.col("source_size"), F.col("total"), "target")
    return s.select("source", "source_size", "target")


def plan_copies(docs: DataFrame, ws: Workspace) -> DataFrame:
    """docs(doc_id, source, text, ...) -> source, band and the cut of each: what copies() needs to decide on a row by itself."""
    slim = docs.select("source", word_count(F.col("text")).alias("size"), _drawn().alias("h"), "doc_id")
    slim = ws.save(slim.withColumns({"band": F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")}), "sizes")
    targets = source_targets(slim)
    bands = slim.groupBy("source", "band").agg(F.sum("size").alias("words"))
    bands = bands.join(targets, bands["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    words = F.pow(F.lit(2.0), F.lit(FAVOUR) * F.col("band")) * F.col("words")
    bands = _fill(bands, ["source"], [F.col("band")], words, CAP * F.col("words"), F.col("target"), "share")
    copies = F.coalesce(F.round(F.try_divide("share", "words"), 9), F.lit(0.0))
    bands = bands.withColumn("whole", F.floor(copies)).withColumn("p", copies - F.floor(copies))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    bands = ws.save(bands.withColumn("rest", rest).select("source", "band", "source_size", "target", "whole", "p", "rest"), "bands")

    ranked = _with_bands(slim, bands).where("p > 0 and size > 0").withColumn("q", _rank()).withColumn("bin", _bin())
    ranked = ranked.select("source", "bin", "q", "h", "doc_id", "size", "rest")
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    bins = bins.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    cut = bins.where("before < rest and rest <= upto").select("source", F.col("bin").alias("cut_bin"), (F.col("rest") - F.col("before")).alias("left"))
    cut = ws.save(cut.unionByName(bins.groupBy("source").agg(F.max("upto").alias("u"), F.first("rest").alias("rest")).where("rest > u").select("source", F.lit(BINS).alias("cut_bin"), F.lit(0.0).alias("left"))), "cuts")
    inside = ranked.join(cut, ranked["source"].eqNullSafe(cut["source"]) & (ranked["bin"] == cut["cut_bin"])).drop(cut["source"])
    so_far = F.sum("size").over(Window.partitionBy("source").orderBy("q", "h", F.col("doc_id").asc_nulls_first()))  # equal rows together
    last = inside.withColumn("s", so_far).where(F.col("s") <= F.col("left")).groupBy("source").agg(F.max(F.struct("q", "h")).alias("last"), F.max("s").alias("s"))
    ends = cut.join(last, cut["source"].eqNullSafe(last["source"]), "left").drop(last["source"])
    ends = ws.save(ends.select("source", "cut_bin", "last", (F.col("left") - F.coalesce("s", F.lit(0))).alias("gap")), "ends")
    # Of the documents behind the cut, the one whose size comes nearest to the words still missing closes the sample.
    beyond = ranked.join(ends, ranked["source"].eqNullSafe(ends["source"])).drop(ends["source"]).where(~_within())
    away = F.abs(F.col("size") - F.col("gap"))
    close = beyond.where(away < F.col("gap")).groupBy("source").agg(F.min(F.struct(away.alias("away"), "q", "h")).alias("c"))
    ends = ends.join(close, ends["source"].eqNullSafe(close["source"]), "left").drop(close["source"]).select("source", "cut_bin", "last", F.struct("c.q", "c.h").alias("closing"))
    out = bands.join(ends, bands["source"].eqNullSafe(ends["source"]), "left").drop(ends["source"])
    return ws.save(out, "plan")


def _within() -> Column:
    return F.coalesce((F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.struct("q", "h") <= F.col("last"))), F.lit(False))


def _drawn() -> Column:
    return F.xxhash64(F.lit(SEED), "doc_id", "text")


def _rank() -> Column:
    u = (F.shiftrightunsigned("h", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))


def _bin() -> Column:
    return F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int")


def _with_bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    return rows.join(bands, rows["source"].eqNullSafe(bands["source"]) & (rows["band"] == bands["band"])).drop(bands["source"]).drop(bands["band"])


def copies(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """docs(doc_id, source, text, ...) -> row (all its columns), size, source_size, target, copies: how often the mix holds each row.

    size counts words; null and empty texts count 0 and have as many whole copies as their band's certain ones. A row is drawn by
    doc_id and text, so rows that repeat both are taken together; ties in rank fall by that hash. Reruns agree. No rows give no rows."""
    ws = ws or Workspace(docs.sparkSession, "mixing")
    plan = plan_copies(docs, ws)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", word_count(F.col("text")).alias("size"), _drawn().alias("h"))
    rows = rows.withColumn("band", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int"))
    got = _with_bands(rows, plan).withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), _rank())).withColumn("bin", _bin())
    drawn = _within() | F.coalesce(F.struct("q", "h") == F.col("closing"), F.lit(False))
    taken = F.col("whole") + drawn.cast("long")
    return got.select("row", "size", "source_size", "target", taken.cast("long").alias("copies"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """The mix: the rows of docs with all their columns, each as often as it is taken."""
    rows = copies(docs).where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
