"""Joins over intervals, closed at both ends.

Equality on the reference alone would pair all rows of a chromosome. overlap_join() cuts the axis into bins of equal width, joins on
(keys, bin) and keeps a pair in the first bin that both share, so a pair comes out once. Spark then picks broadcast, hash or merge join by size, and
splits bins that are skewed. Counting joins weigh equal intervals first: a highly expressed locus becomes few rows with large weights."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 512
#: Rows of the input for each task of a job whose tasks grow in number with it.
SHARE = 1 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the folder in spark.checkpoint.dir, which outlives executors; in local mode without one, to a folder of our own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def tasks_for(rows: DataFrame) -> int | None:
    """Tasks of SHARE rows each on average, None where Spark's own number is enough. With a fixed number of tasks what one of them sorts grows with the input. Counts rows.

    No more than Spark's map tasks write to without a sort of their own (200), which takes more memory than shares of that many rows save; beyond, shares grow."""
    spark = rows.sparkSession
    unsorted = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    tasks = min(-(-rows.count() // SHARE), unsorted)
    return tasks if tasks > min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) else None


def dealt(rows: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """rows dealt by their keys to so many tasks; with None, as Spark does."""
    return rows if tasks is None else rows.repartition(tasks, *by)


def _bins(start: Column, end: Column, width: int) -> Column:
    first, last = F.floor(start / width), F.floor(end / width)
    return F.sequence(first, F.greatest(first, last))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], width: int = BIN, left_span=("start", "end"), right_span=("start", "end"), tasks: int | None = None) -> DataFrame:
    """Pairs with left.start <= right.end and right.start <= left.end and equal keys. Columns of right but its keys are to have names of their own.

    tasks: to how many at least bins are dealt, as of tasks_for()."""
    (ls, le), (rs, re_) = left_span, right_span
    a = left.where(F.col(ls) <= F.col(le)).withColumn("_bin", F.explode(_bins(F.col(ls), F.col(le), width)))
    b = right.where(F.col(rs) <= F.col(re_)).withColumn("_bin", F.explode(_bins(F.col(rs), F.col(re_), width)))
    met = dealt(a, tasks, *by, "_bin").join(dealt(b, tasks, *by, "_bin"), [*by, "_bin"])
    first = F.greatest(F.floor(F.col(ls) / width), F.floor(F.col(rs) / width))
    return met.where((F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le)) & (F.col("_bin") == first)).drop("_bin")


def weighed(items: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each distinct combination, with its count as weight."""
    return items.groupBy(*columns).agg(F.count("*").alias("weight"))


def running_sums(points: DataFrame, by: list[str], pos: str, sums: dict[str, str], tie: str, block: int = 1 << 16) -> DataFrame:
    """Adds a column for each of sums (name: weight): the sum of weight over rows of the same keys that come before or at (pos, tie).

    Sums run inside blocks of the axis; block totals are summed in a second, small window. No reference is one task's work."""
    p = points.withColumn("_block", F.floor(F.col(pos) / block))
    inside, earlier = Window.partitionBy(*by, "_block").orderBy(pos, tie), Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = p.groupBy(*by, "_block").agg(*[F.sum(w).alias(f"_{n}_sum") for n, w in sums.items()])
    before = totals.select(*by, "_block", *[F.coalesce(F.sum(f"_{n}_sum").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in sums])
    met = p.withColumns({f"_{n}_in": F.sum(w).over(inside) for n, w in sums.items()}).join(before, [*by, "_block"])
    return met.withColumns({n: F.col(f"_{n}_in") + F.col(f"_{n}_before") for n in sums}).drop("_block", *[f"_{n}_{x}" for n in sums for x in ("in", "before")])


def running_rank(points: DataFrame, by: list[str], pos: str, weight: str, tie: str, block: int = 1 << 16) -> DataFrame:
    """Adds rank: the sum of weight over rows of the same keys that come before or at (pos, tie)."""
    return running_sums(points, by, pos, {"rank": weight}, tie, block)


def _reached(queries: DataFrame, items: DataFrame, by: list[str], row: Column, up: tuple[str, str, bool], gone: tuple[str, str, bool]) -> DataFrame:
    """by, _row, _n, _first: two rows for each query, whose _n sum to the items that it has reached, less those that are gone.

    up and gone are (query's column, item's column, whether an item at the query's place counts). Both ends of items and queries are ranked in one pass; the first of a query's rows is marked."""
    tie = lambda inclusive: 0 if inclusive else 2
    end = lambda c, t, k: F.struct(F.col(c).alias("pos"), F.lit(t).alias("tie"), F.lit(k).alias("side"))
    q = queries.where(F.col(up[0]).isNotNull() & F.col(gone[0]).isNotNull()).select(*by, row.alias("_row"), F.explode(F.array(end(up[0], 1, 0), end(gone[0], 1, 1))).alias("x"))
    zero = F.lit(0).cast("long")
    q = q.select(*by, "_row", F.col("x.pos").alias("_pos"), F.col("x.tie").alias("_tie"), F.col("x.side").alias("_side"), zero.alias("_up"), zero.alias("_gone"))
    i = items.select(*by, F.explode(F.array(end(up[1], tie(up[2]), 0), end(gone[1], tie(gone[2]), 1))).alias("x")).where("x.pos is not null")
    i = i.groupBy(*by, F.col("x.pos").alias("_pos"), F.col("x.tie").alias("_tie"), F.col("x.side").alias("_side")).agg(F.count("*").alias("_w"))
    side = lambda k: F.when(F.col("_side") == k, F.col("_w")).otherwise(zero)
    i = i.select(*by, F.lit(None).cast(q.schema["_row"].dataType).alias("_row"), "_pos", "_tie", "_side", side(0).alias("_up"), side(1).alias("_gone"))
    ranked = running_sums(q.unionByName(i), by, "_pos", {"_reached": "_up", "_left": "_gone"}, "_tie").where(F.col("_row").isNotNull())
    return ranked.select(*by, "_row", F.when(F.col("_side") == 0, F.col("_reached")).otherwise(-F.col("_left")).alias("_n"), (F.col("_side") == 0).alias("_first"))


def _reached_by_row(queries: DataFrame, items: DataFrame, by: list[str], up: tuple[str, str, bool], gone: tuple[str, str, bool], name: str) -> DataFrame:
    """queries with that number. Queries that are equal in all columns are counted once and come out as often as they went in."""
    met = _reached(queries, items, by, F.struct(*queries.columns), up, gone).groupBy("_row").agg(F.sum("_n").alias("_n"), F.count_if("_first").alias("_copies"))
    copies = met.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return copies.select("_row.*", F.expr("_n div _copies").alias(name))


def overlap_counts(queries: DataFrame, items: DataFrame, by: list[str], query_span=("start", "end"), item_span=("start", "end"), name: str = "n") -> DataFrame:
    """How many items overlap each query, without making pairs: starts up to the query's end, less ends before its start. Long items cost no more than short ones."""
    (qs, qe), (s, e) = query_span, item_span
    return _reached_by_row(queries, items, by, (qe, s, True), (qs, e, False), name)


def overlap_totals(queries: DataFrame, items: DataFrame, by: list[str], per: str, query_span=("start", "end"), item_span=("start", "end"), name: str = "n") -> DataFrame:
    """by, per and how many items overlap the queries of each value of per, an item once for each query."""
    (qs, qe), (s, e) = query_span, item_span
    met = _reached(queries, items, by, F.struct(per), (qe, s, True), (qs, e, False))
    return met.groupBy(*by, F.col(f"_row.{per}").alias(per)).agg(F.sum("_n").alias(name))


def outer_contained(queries: DataFrame, items: DataFrame, by: list[str], query_span=("start", "end"), item_span=("start", "end"), name: str = "n") -> DataFrame:
    """Items that start before the query, less those that end at or before its end."""
    (qs, qe), (s, e) = query_span, item_span
    return _reached_by_row(queries, items, by, (qs, s, False), (qe, e, True), name)


def stabbing_join(points: DataFrame, spans: DataFrame, by: list[str], point: str, span=("start", "end"), closed: bool = False, share: int = 64, block: int = 1 << 20) -> DataFrame:
    """Pairs of a point and a span of equal keys with span.start <= point < span.end; closed takes point = span.end as well. Columns of spans but their keys are to have names of their own.

    A sweep in the order of points. One pass over points and both ends of the spans ranks them all; points are dealt into shares of so many neighbours, and a span goes to the shares
    that hold its first to its last point: to none if it holds no point, and to one more for each share that it holds whole. So rows joined are in proportion to rows given and pairs
    found, whatever the spans' lengths."""
    (s, e), own = span, [c for c in spans.columns if c not in by]
    p = points.select(*by, F.col(point).alias("_pos"), F.lit(1).alias("_tie"), F.lit(1).cast("long").alias("_w"), F.struct(*points.columns).alias("_row"))
    none = F.lit(None).cast(p.schema["_row"].dataType).alias("_row")
    held = spans.where(F.col(s) <= F.col(e)).withColumn("_span", F.struct(*own))
    ends = held.select(*by, "_span", F.explode(F.array(F.struct(F.col(s).alias("pos"), F.lit(0).alias("tie"), F.lit(0).alias("side")), F.struct(F.col(e).alias("pos"), F.lit(2 if closed else 0).alias("tie"), F.lit(1).alias("side")))).alias("x"))
    ends = ends.select(*by, F.col("x.pos").alias("_pos"), F.col("x.tie").alias("_tie"), F.lit(0).cast("long").alias("_w"), none, "_span", F.col("x.side").alias("_side"))
    both = p.withColumns({"_span": F.lit(None).cast(held.schema["_span"].dataType), "_side": F.lit(None).cast("int")}).unionByName(ends)
    # Points of one place share a rank, the last one's, and so a share.
    ranked = running_rank(both, by, "_pos", "_w", "_tie", block)
    numbered = ranked.where(F.col("_row").isNotNull()).select(*by, F.struct(F.col("_row"), F.floor((F.col("rank") - 1) / share).alias("_at")).alias("_p")).select(*by, "_p._row", "_p._at")
    # rank before a span's start counts points before it; at its end, points within or before it.
    sides = ranked.where(F.col("_row").isNull()).groupBy(*by, "_span").agg(F.min(F.when(F.col("_side") == 0, F.col("rank"))).alias("_lo"), F.max(F.when(F.col("_side") == 1, F.col("rank"))).alias("_hi"), F.count_if(F.col("_side") == 0).alias("_copies"))
    dealt = sides.where("_hi > _lo").withColumn("_at", F.explode(F.sequence(F.floor(F.col("_lo") / share), F.floor((F.col("_hi") - 1) / share))))
    met = numbered.join(dealt, [*by, "_at"])
    at, ends_at = F.col(f"_row.{point}"), F.col(f"_span.{e}")
    met = met.where((at >= F.col(f"_span.{s}")) & ((at <= ends_at) if closed else (at < ends_at)))
    met = met.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))  # spans that are equal in all columns
    return met.select("_row.*", *[F.col(f"_span.{c}").alias(c) for c in own])


def containment_join(outer: DataFrame, inner: DataFrame, by: list[str], outer_span=("start", "end"), inner_span=("start", "end"), closed: bool = False) -> DataFrame:
    """Pairs with inner.start in [outer.start, outer.end) and inner.end <= outer.end; closed takes inner.start = outer.end as well."""
    (s, e) = inner_span
    return stabbing_join(inner, outer, by, s, outer_span, closed).where(F.col(e) <= F.col(outer_span[1]))


def as_of(points: DataFrame, marks: DataFrame, by: list[str], point: str, mark: str, carried: str, name: str, block: int = 1 << 20) -> DataFrame:
    """points plus, under name, carried of the last mark at or before each point (null if none). Marks at one place: the greatest carried value.

    The axis is cut into blocks; a block starts from the last mark of the blocks before it, found on one row for each block."""
    p = points.select(*by, F.col(point).alias("_pos"), F.lit(1).alias("_tie"), F.struct(*points.columns).alias("_row"), F.lit(None).cast(marks.schema[carried].dataType).alias("_mark"))
    m = marks.select(*by, F.col(mark).alias("_pos"), F.lit(0).alias("_tie"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col(carried).alias("_mark"))
    u = p.unionByName(m).withColumn("_block", F.floor(F.col("_pos") / block))
    w = Window.partitionBy(*by, "_block").orderBy("_pos", "_tie", "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = u.groupBy(*by, "_block").agg(F.max(F.when(F.col("_mark").isNotNull(), F.struct("_pos", "_mark"))).alias("_top"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_from", F.last("_top", ignorenulls=True).over(before)).drop("_top")
    got = u.withColumn("_last", F.last("_mark", ignorenulls=True).over(w)).where(F.col("_row").isNotNull()).join(ends, [*by, "_block"])
    return got.select("_row.*", F.coalesce("_last", F.col("_from._mark")).alias(name))


def islands(rows: DataFrame, by: list[str], start: str = "start", end: str = "end", touch: int = 1, block: int | None = None) -> DataFrame:
    """Adds island: numbers runs of intervals that overlap or lie at most touch apart, in order of start within the keys.

    Without block a key's rows pass through one task in order: for keys of few rows, as a transcript's exons. With it the axis is cut into blocks: the largest end so far runs
    inside each block, the blocks' own largest ends are carried on in a second, small window, and the runs that begin are numbered likewise, so a key may be a whole contig."""
    if block is None:
        w = Window.partitionBy(*by).orderBy(start, end)
        reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("_open", _opens(start, reach, touch)).withColumn("island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_open")
    cut = rows.withColumn("_block", F.floor(F.col(start) / block))
    inside = Window.partitionBy(*by, "_block").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*by, "_block").agg(F.max(end).alias("_top")).withColumn("_from", F.max("_top").over(before)).drop("_top")
    reached = cut.withColumn("_in", F.max(end).over(inside)).join(carried, [*by, "_block"])
    opened = reached.withColumn("_open", _opens(start, F.greatest("_in", "_from"), touch)).drop("_in", "_from", "_block")
    return running_rank(opened, by, start, "_open", end, block).withColumnRenamed("rank", "island").drop("_open")


def _opens(start: str, reach: Column, touch: int) -> Column:
    """1 where a run begins: reach is the largest end before, null for a key's first row."""
    return F.when(reach.isNull() | (F.col(start) > reach + touch), 1).otherwise(0)
