"""From alignments to fragments: filters, mate pairing, merged spans, gaps and junctions.

alignments follow model.ALIGNMENTS; ord is the place in the file. All state is by sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceframe.functions import cigar
from spliceframe.model import Options

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY = 0x1, 0x2, 0x4, 0x8, 0x10, 0x40, 0x80, 0x100


def flagged(bit: int, flag: Column | None = None) -> Column:
    return (F.col("flag") if flag is None else flag).bitwiseAND(F.lit(bit)) != 0


def mapped_in_layout(mode: int) -> Column:
    """On a reference, mapped, and paired exactly when the layout is."""
    return (F.col("ref_id") >= 0) & ~flagged(UNMAPPED) & (flagged(PAIRED) == F.lit(mode == 2))


def policy_filter(policy: str) -> Column:
    """unique: no secondary records and no NH above 1. primary: no secondary records. multi: secondary records only in proper pairs."""
    return {
        "unique": ~flagged(SECONDARY) & (F.coalesce(F.col("nh"), F.lit(0)) <= 1),
        "primary": ~flagged(SECONDARY),
        "multi": ~flagged(SECONDARY) | flagged(PROPER),
    }[policy]


def with_policy(alignments: DataFrame, opt: Options, samples: DataFrame | None = None) -> DataFrame:
    """Adds keep: whether a record counts. A sample whose first record has no NH is read as multi-mapping, as nothing marks its unique reads.

    samples(sample_id, unmarked): whether it hasn't, where that is known; else all records are searched for their samples' first ones."""
    if opt.pairing == "keyed":  # this pairing only ever drops secondary records
        return alignments.withColumn("keep", mapped_in_layout(opt.mode) & ~flagged(SECONDARY))
    if opt.multi:
        return alignments.withColumn("keep", mapped_in_layout(opt.mode) & policy_filter("primary" if opt.primary else "multi"))
    first = alignments.groupBy("sample_id").agg(F.min_by("nh", "ord").isNull().alias("unmarked")) if samples is None else samples
    rule = F.when(F.col("unmarked"), policy_filter("multi")).otherwise(policy_filter("unique"))
    # One row a sample: sent to all tasks, as a shuffle by sample would make each one task's work.
    return alignments.join(F.broadcast(first), "sample_id").withColumn("keep", mapped_in_layout(opt.mode) & rule).drop("unmarked")


def read_struct(opt: Options) -> Column:
    """start, end, forward, js (junction offsets) of one record."""
    start = F.col("pos") + 1
    end = F.col("pos") + cigar.reference_length(F.col("cigar")) + (0 if opt.exact_end else 1)
    return F.struct(start.alias("start"), end.alias("end"), (~flagged(REVERSE)).alias("forward"), cigar.junction_offsets(F.col("cigar"), opt.ref_consuming_only).alias("js"))


def single_fragments(alignments: DataFrame, opt: Options, samples: DataFrame | None = None) -> DataFrame:
    """Single-end: each record is a fragment."""
    kept = with_policy(alignments, opt, samples).where("keep").withColumn("r", read_struct(opt))
    return kept.select("sample_id", "ref_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.lit(None).cast("bigint").alias("gap_start"), F.lit(None).cast("bigint").alias("gap_end"), _shifted("r", F.lit(0)).alias("js"))


def _shifted(read: str, by: Column) -> Column:
    return F.transform(F.col(f"{read}.js"), lambda j: F.struct((j["s"] + by).alias("s"), (j["e"] + by).alias("e")))


#: Records of one name are dealt into stretches of the file this long, as ord counts (256 KiB of a BAM file; two partitions' lines of text).
STRETCH = 1 << 34


def taken_or_free(records: DataFrame, by: list[str], order: str, toggles: Column, carried: Column, stretch: int = STRETCH, kept=None) -> DataFrame:
    """Adds taken, whether a record is taken by the one before it, and next, `carried` of the record that follows (both by order within the keys).

    A record that isn't taken takes its follower if `toggles` holds. So each record is a map of {free, taken} to itself: it ends free, or, if it toggles, taken when it began
    free. Maps compose, so they are scanned in two steps: within each stretch of a key's records, and over one row for each stretch, of those keys only that have several. Within
    a stretch a record's state is the number of toggles since the last record that ends free in any case, odd or even. No key becomes an array, however many records it has.

    kept: what to do with the records before they are read twice, as checkpointing them."""
    r = records.withColumns({"_toggles": F.coalesce(toggles, F.lit(False)), "_carried": carried, "_stretch": F.floor(F.col(order) / stretch)})
    r = r if kept is None else kept(r)
    w = Window.partitionBy(*by, "_stretch").orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumns({"_n": F.row_number().over(w), "next": F.lead("_carried").over(w)})
    r = r.withColumn("_ended", F.max(F.when(~F.col("_toggles"), F.col("_n"))).over(before))
    # One row for each stretch: its length, its last record that ends free in any case, and its first record.
    ends = r.groupBy(*by, "_stretch").agg(F.max("_n").alias("_n"), F.max(F.when(~F.col("_toggles"), F.col("_n"))).alias("_last"), F.min_by("_carried", "_n").alias("_first"))
    many = Window.partitionBy(*by)
    ends = ends.withColumns({"_stretches": F.count("*").over(many), "_odd": F.pmod(F.col("_n") - F.coalesce("_last", F.lit(0)), F.lit(2))}).where("_stretches > 1")
    ordered = many.orderBy("_stretch")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_sum": F.coalesce(F.sum("_odd").over(earlier), F.lit(0)), "_after": F.lead("_first").over(ordered)})
    # What stretches toggle is summed from the last one on that ends alike however it began; the sum before that one is the largest of such.
    ends = ends.withColumn("_base", F.coalesce(F.max(F.when(F.col("_last").isNotNull(), F.col("_sum"))).over(earlier), F.lit(0)))
    ends = ends.select(*by, "_stretch", F.pmod(F.col("_sum") - F.col("_base"), F.lit(2)).alias("_start"), "_after", F.col("_n").alias("_length"))
    r = r.join(ends, [*by, "_stretch"], "left")
    state = F.col("_n") - 1 - F.coalesce("_ended", F.lit(0)) + F.when(F.col("_ended").isNull(), F.coalesce("_start", F.lit(0))).otherwise(0)
    follower = F.when(F.col("_n") == F.col("_length"), F.col("_after")).otherwise(F.col("next"))
    return r.withColumns({"taken": F.pmod(state, F.lit(2)) == 1, "next": follower}).select(*records.columns, "taken", "next")


def adjacent_mates(alignments: DataFrame, opt: Options, samples: DataFrame | None = None, kept=None, stretch: int = STRETCH) -> DataFrame:
    """sample_id, ref_id, r1, r2 from name-collated records: a kept record whose mate is mapped takes the record of its name that follows.

    Which records open a pair depends on those before it: taken_or_free(). The record taken isn't filtered itself; a pair on two references is dropped; a record without a
    follower counts on its own."""
    records = with_policy(alignments, opt, samples).select("sample_id", "qname", "ord", "keep", F.struct("flag", "ref_id", read_struct(opt).alias("r")).alias("a"))
    lone = flagged(MATE_UNMAPPED, F.col("a.flag"))
    # A null name is a name like others.
    named = records.withColumn("qname", F.coalesce("qname", F.lit("*")))
    rows = taken_or_free(named, ["sample_id", "qname"], "ord", F.col("keep") & ~lone, F.col("a"), stretch, kept).where(F.col("keep") & ~F.col("taken"))
    rows = rows.withColumn("b", F.when(~lone, F.col("next"))).where(F.col("b").isNull() | (F.col("a.ref_id") == F.col("b.ref_id")))
    second = flagged(SECOND, F.col("b.flag"))
    first_alone = flagged(FIRST, F.col("a.flag"))
    r1 = F.when(F.col("b").isNull(), F.when(first_alone, F.col("a.r"))).when(second, F.col("a.r")).otherwise(F.col("b.r"))
    r2 = F.when(F.col("b").isNull(), F.when(~first_alone, F.col("a.r"))).when(second, F.col("b.r")).otherwise(F.col("a.r"))
    return rows.select("sample_id", F.col("a.ref_id").alias("ref_id"), r1.alias("r1"), r2.alias("r2"))


def bare_name(qname: Column) -> Column:
    """A name without its mate mark: .1 .2 /1 /2."""
    return F.regexp_replace(qname, "[./][12]$", "")


def pair_key() -> Column:
    """Name, reference and both positions, the leftmost first as the sign of isize says."""
    ends = [F.when(F.col("isize") > 0, F.col(a)).otherwise(F.col(b)) for a, b in (("pos", "mpos"), ("mpos", "pos"))]
    return F.concat_ws(";", bare_name(F.col("qname")), "ref_id", *ends)


def single_key() -> Column:
    return F.concat_ws(";", "qname", "ref_id", "pos")


def _kept_record(recs: Column) -> Column:
    """Of one side's records in file order: the first, unless later ones with junctions replace it; those keep the junctions of what they replace."""
    later = F.slice(recs, 2, F.greatest(F.size(recs) - 1, F.lit(0)))
    return F.aggregate(
        later,
        F.get(recs, F.lit(0))["r"],
        lambda acc, x: F.when(F.size(x["r"]["js"]) > 0, x["r"].withField("js", F.concat(x["r"]["js"], acc["js"]))).otherwise(acc),
    )


def keyed_mates(alignments: DataFrame, opt: Options) -> DataFrame:
    """sample_id, ref_id, r1, r2 by name, reference and positions, in any order of records. Single-end records share their side."""
    paired = opt.mode == 2
    kept = with_policy(alignments, opt).where("keep").withColumn("k", pair_key() if paired else single_key())
    side = F.when(flagged(FIRST), 1).when(flagged(SECOND), 2) if paired else F.lit(1)
    kept = kept.withColumn("side", side).where("side is not null")
    recs = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("ord", read_struct(opt).alias("r")))))
    rows = kept.groupBy("sample_id", "ref_id", "k").agg(recs(1).alias("a"), recs(2).alias("b"))
    return rows.select("sample_id", "ref_id", F.when(F.size("a") > 0, _kept_record(F.col("a"))).alias("r1"), F.when(F.size("b") > 0, _kept_record(F.col("b"))).alias("r2"))


def merge_mates(mates: DataFrame, opt: Options) -> DataFrame:
    """Mates to fragments: strandness and gap filters for whole pairs, the span over both, the gap between them, the union of their junctions.

    With strandness 1 a pair goes when read 1 is reverse and read 2 is forward, with 2 the other way round; single reads always stay."""
    both = F.col("r1").isNotNull() & F.col("r2").isNotNull()
    wrong = {0: F.lit(False), 1: ~F.col("r1.forward") & F.col("r2.forward"), 2: F.col("r1.forward") & ~F.col("r2.forward")}[opt.strandness if opt.pairing == "adjacent" else 0]
    m = mates.where(~F.coalesce(both & wrong, F.lit(False)))
    start = F.least("r1.start", "r2.start")
    left_end, right_start = F.least("r1.end", "r2.end"), F.greatest("r1.start", "r2.start")
    apart = both & (left_end < right_start)
    joined = lambda r: F.coalesce(_shifted(r, F.col(f"{r}.start") - F.col("start")), F.array().cast("array<struct<s:bigint,e:bigint>>"))
    m = m.withColumns({"start": start, "end": F.greatest("r1.end", "r2.end"), "gap_start": F.when(apart, left_end), "gap_end": F.when(apart, right_start)})
    m = m.where(F.coalesce(F.col("gap_end") - F.col("gap_start") <= opt.max_gap, F.lit(True)))
    # With both mates' junctions at hand equal ones count once; a lone list stays as it is.
    one, two = joined("r1"), joined("r2")
    js = F.when((F.size(one) > 0) & (F.size(two) > 0), F.array_sort(F.array_union(one, two))).otherwise(F.concat(one, two))
    return m.select("sample_id", "ref_id", "start", "end", "gap_start", "gap_end", js.alias("js"))


def fragments(alignments: DataFrame, opt: Options = Options(), samples: DataFrame | None = None, kept=None) -> DataFrame:
    """sample_id, ref_id, start, end, gap_start, gap_end, js, has_junction. Records filtered here: layout, policy, pairs, strandness, gaps; duplicates, supplementary and low-quality records all count.

    samples: as in with_policy(). kept: as in taken_or_free(), for sources that are dear to read."""
    if opt.pairing == "keyed":
        out = merge_mates(keyed_mates(alignments, opt), opt)
    elif opt.mode == 2:
        out = merge_mates(adjacent_mates(alignments, opt, samples, kept), opt)
    else:
        out = single_fragments(alignments, opt, samples)
    out = out.withColumn("has_junction", F.size("js") > 0)
    if opt.strict:
        some = out.groupBy("sample_id").agg(F.max("has_junction").alias("_some"))
        out = out.join(F.broadcast(some), "sample_id").withColumn("has_junction", F.when(F.col("_some"), F.col("has_junction")).otherwise(F.raise_error("no fragment has a junction"))).drop("_some")
    return out


def fragment_junctions(frags: DataFrame) -> DataFrame:
    """One row for each junction of each fragment: its last base before and its first base behind the skipped stretch."""
    return frags.select("sample_id", "ref_id", "start", F.explode("js").alias("j")).select("sample_id", "ref_id", (F.col("start") + F.col("j.s") - 1).alias("start"), (F.col("start") + F.col("j.e")).alias("end"))


def run_log(frags: DataFrame) -> DataFrame:
    """Counts for the log: fragments with and without junctions, and junctions before they are aggregated."""
    return frags.groupBy("sample_id").agg(F.count_if("has_junction").alias("with_junctions"), F.count_if(~F.col("has_junction")).alias("without_junctions"), F.sum(F.size("js")).cast("long").alias("junctions"))


def mate_log(mates: DataFrame) -> DataFrame:
    """Counts of single reads for the log, before strandness and gap filters: with junctions and without; a mate that is missing counts as one without."""
    n = sum(F.count_if(F.coalesce(F.size(f"{r}.js"), F.lit(0)) > 0) for r in ("r1", "r2"))
    return mates.groupBy("sample_id").agg(n.alias("with_junctions"), (F.count("*") * 2 - n).alias("without_junctions"))
