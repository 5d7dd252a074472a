"""Parents and ancestors of features at any depth, inherited gene names, and the collapse of redundant transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceframe.operators.annotation import BLOCK
from spliceframe.operators.intervals import checkpointed
from spliceframe.sources.gff import attributes, copied_attributes, once

#: How far a child may start from its parent. Fixed value.
MAX_LOCUS = 7_000_000
#: Kinds that are parts of a transcript; they need to be near their parent, others to overlap it.
PARTS = ("exon", "utr", "cds", "start", "stop", "intron")


def parent_links(features: DataFrame) -> DataFrame:
    """line_no, parent: for each feature and each parent that it declares, the line of the first feature of that id on the same contig that fits.

    features(line_no, id, parents, kind, seqid, strand, start, end), as gff.parse_lines() gives them. A parent fits if its strand is the child's or '.', and it starts at most MAX_LOCUS away;
    for a child that is no part of a transcript they overlap as well. A repeated id may so stand for a feature on each contig, or for one in each of several places."""
    child = features.select("line_no", "kind", "seqid", F.col("strand").alias("_strand"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.explode(F.array_distinct("parents")).alias("id"))
    parent = features.where("id is not null").select(F.col("line_no").alias("parent"), "id", "seqid", "strand", "start", "end")
    met = child.join(parent, ["id", "seqid"]).where(F.col("line_no") != F.col("parent"))
    strand = (F.col("strand") == ".") | F.col("strand").eqNullSafe(F.col("_strand"))
    near = F.abs(F.col("start") - F.col("_start")) <= MAX_LOCUS
    over = (F.col("start") <= F.col("_end")) & (F.col("end") >= F.col("_start"))
    return met.where(strand & near & (F.col("kind").isin(*PARTS) | over)).groupBy("line_no", "id").agg(F.min("parent").alias("parent")).select("line_no", "parent").distinct()


def nearest_ancestors(features: DataFrame, links: DataFrame, kind: str) -> DataFrame:
    """line_no, ancestor, depth: the nearest ancestors of a kind, over all lines of parents, and how many steps away. Features without such an ancestor give no row.

    Pointers double: each feature points to its parents, those of the kind and those without parents to themselves; a round replaces each pointer by where that one points, so a tree of any
    depth settles in as many rounds as its depth has binary digits. Features whose parents form a ring never settle: once pointers are longer than any line of parents can be, those still open are left out."""
    targets = features.select(F.col("line_no").alias("parent"), (F.col("kind") == kind).alias("_hit"))
    rooted = links.select(F.col("line_no").alias("parent")).distinct().withColumn("_has", F.lit(True))
    ends = targets.join(rooted, "parent", "left").select("parent", F.col("_hit"), (F.col("_hit") | F.col("_has").isNull()).alias("_ends"))
    now = checkpointed(links.join(ends, "parent").select("line_no", F.col("parent").alias("up"), F.lit(1).alias("depth"), "_hit", "_ends"))
    reach, longest = 1, None
    while True:
        going = now.where(~F.col("_ends"))
        n = going.count()
        longest = n if longest is None else longest
        if not n or reach > longest + 1:
            break
        reach *= 2
        step = now.select(F.col("line_no").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("_hit").alias("_h"), F.col("_ends").alias("_e"))
        moved = going.join(step, "up").select("line_no", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_h").alias("_hit"), F.col("_e").alias("_ends"))
        both = now.where("_ends").unionByName(moved)
        now = checkpointed(both.groupBy("line_no", "up", "_hit", "_ends").agg(F.min("depth").alias("depth")))
    return now.where("_hit").select("line_no", F.col("up").alias("ancestor"), "depth")


def inherited(features: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """features with gene_id and gene_name of the nearest gene above where they have none of their own, and gene_line, that gene's line (null without one).

    Of several nearest genes the one fewest steps away counts, then the one that stands first."""
    links = parent_links(features) if links is None else links
    found = nearest_ancestors(features, links, "gene").groupBy("line_no").agg(F.min(F.struct("depth", "ancestor")).alias("n")).select("line_no", F.col("n.ancestor").alias("gene_line"))
    genes = features.where("kind = 'gene'").select(F.col("line_no").alias("gene_line"), F.coalesce("gene_id", "id").alias("_id"), F.col("gene_name").alias("_name"))
    named = features.join(found.join(genes, "gene_line"), "line_no", "left")
    return named.withColumns({"gene_id": F.coalesce("gene_id", "_id"), "gene_name": F.coalesce("gene_name", "_name")}).drop("_id", "_name")


def with_copied_attributes(features: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """features with attributes: the map of their own ones, then those of their first parent that they lack. Without a parent that fits, their own ones alone."""
    links = parent_links(features) if links is None else links
    own = features.withColumn("attributes", once(F.col("attrs"), attributes))
    above = own.select(F.col("line_no").alias("_parent"), F.col("attributes").alias("_above"))
    first = links.groupBy("line_no").agg(F.min("parent").alias("_parent")).join(above, "_parent").drop("_parent")
    return own.join(first, "line_no", "left").withColumn("attributes", copied_attributes(F.col("attributes"), F.col("_above"))).drop("_above")


def assembled(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """transcripts(tx_line, tx_id, gene_id, gene_name, seqid, strand, start, end), exons(tx_line, seqid, start, end) of a tree of any depth.

    A part belongs to the nearest transcripts above it, whatever stands between. Exons of transcripts without exon features are their coding and untranslated segments; a transcript
    is shrunk to its exons' span, and one without any goes."""
    links = parent_links(features)
    over = nearest_ancestors(features, links, "transcript").select("line_no", F.col("ancestor").alias("tx_line"))
    parts = features.where("kind in ('exon', 'utr', 'cds')").select("line_no", "kind", "seqid", "start", "end").join(over, "line_no")
    whole = parts.where("kind = 'exon'").select("tx_line").distinct()
    exons = parts.where("kind = 'exon'").unionByName(parts.where("kind <> 'exon'").join(whole, "tx_line", "left_anti")).select("tx_line", "seqid", "start", "end")
    span = exons.groupBy("tx_line").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    tx = inherited(features, links).where("kind = 'transcript'").select(F.col("line_no").alias("tx_line"), F.col("id").alias("tx_id"), "gene_id", "gene_name", "seqid", "strand")
    return tx.join(span, "tx_line"), exons


def containers(exons: DataFrame, by: list[str], tx: str, match_all: bool = False, block: int = BLOCK) -> DataFrame:
    """by, tx, container: redundant transcripts, each with one that contains it. exons(by, tx, start, end), apart within a transcript; by: contig and strand.

    A transcript is contained in another of its contig and strand whose introns hold its own as an unbroken run, or all of them with match_all, if it doesn't reach beyond the exons that flank that
    run; one without introns, if it lies in one exon of the other (with match_all: of another without introns). Of equal ones the least tx contains the others.

    Runs of introns that are any transcript's whole chain are looked up by that chain. Sorted by where they may begin, a transcript is contained if any run before it
    reaches as far as its end: one running maximum instead of all pairs, so 10,000 transcripts of one chain make 10,000 rows. The container named is the run or exon that
    reaches farthest, then the one of a transcript of more introns, then the one that begins first, then the one of the least tx."""
    listed = exons.groupBy(*by, tx).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x"))
    introns = F.transform(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda e, i: F.struct((F.get("x", i)["end"] + 1).alias("s"), (e["start"] - 1).alias("e")))
    chains = listed.select(*by, F.col(tx).alias("t"), "x", introns.alias("i"), F.size(introns).alias("n"), F.get("x", F.lit(0))["start"].alias("s"), F.element_at("x", -1)["end"].alias("e"))

    # Chains of introns: each begins at one intron and has a length; only such runs of other chains are cut out.
    own = chains.where("n > 0")
    heads = own.select(*by, F.get("i", F.lit(0)).alias("head"), F.col("n").alias("m")).distinct()
    at = own.select(*by, "t", "x", "i", "n", F.posexplode("i").alias("p", "head")).join(heads, [*by, "head"]).where("p + m <= n")
    at = at.where("m = n") if match_all else at
    runs = at.select(*by, "t", "n", F.slice("i", F.col("p") + 1, F.col("m")).alias("run"), F.get("x", F.col("p"))["start"].alias("low"), F.get("x", F.col("p") + F.col("m"))["end"].alias("high"), (F.col("m") == F.col("n")).alias("whole"))
    runs = runs.withColumn("key", F.xxhash64("run"))
    multi = _held(runs.withColumn("_block", F.lit(0).cast("long")), [*by, "key", "run"])

    # One exon each: looked up among the exons of all, whose order along a contig is cut into blocks.
    lone = chains.select(*by, "t", "n", F.explode("x").alias("exon")).select(*by, "t", "n", F.col("exon.start").alias("low"), F.col("exon.end").alias("high"), (F.col("n") == 0).alias("whole"))
    lone = lone.where("n = 0") if match_all else lone
    single = _held(lone.withColumn("_block", F.floor(F.col("low") / block)), by)
    return multi.select(*by, "t", "container").unionByName(single.select(*by, "t", "container")).withColumnRenamed("t", tx)


def _held(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows that are whole and that some row before them reaches, with its t as container. rows(by, t, n, low, high, whole, _block): in order of low, longest first."""
    order = [F.col("low"), F.desc("high"), F.desc("n"), F.col("t")]
    inside = Window.partitionBy(*by, "_block").orderBy(*order)
    rows = rows.withColumn("_row", F.row_number().over(inside))
    value = F.struct("high", "n", (-F.col("_block")).alias("b"), (-F.col("_row")).alias("r"), "t")  # of equal reach and size the first
    rows = rows.withColumn("_in", F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*by, "_block").agg(F.max(value).alias("_top")).withColumn("_from", F.max("_top").over(before)).drop("_top").where("_from is not null")
    best = rows.join(carried, [*by, "_block"], "left").withColumn("best", F.greatest("_in", "_from"))
    return best.where("whole and best.high >= high").withColumn("container", F.col("best.t"))


def collapsed(exons: DataFrame, by: list[str], tx: str, match_all: bool = False, max_rounds: int = 40) -> DataFrame:
    """by, tx, keeper: for each transcript the one that stays for it, itself if nothing contains it. exons and match_all as in containers().

    Containers may be contained in turn; pointers to them are doubled until all point to transcripts that stay."""
    every = exons.select(*by, tx).distinct()
    held = containers(exons, by, tx, match_all)
    now = checkpointed(every.join(held, [*by, tx], "left").select(*by, F.col(tx).alias("t"), F.coalesce("container", tx).alias("keeper"), F.col("container").isNull().alias("stays")))
    stays = now.where("stays").select(*by, F.col("t").alias("keeper"), F.lit(True).alias("done"))
    for _ in range(max_rounds):
        open_ = now.join(stays, [*by, "keeper"], "left_anti")
        if open_.isEmpty():
            return now.select(*by, F.col("t").alias(tx), "keeper")
        further = now.select(*by, F.col("t").alias("keeper"), F.col("keeper").alias("_next"))
        now = checkpointed(now.join(further, [*by, "keeper"]).select(*by, "t", F.col("_next").alias("keeper")))
    raise RuntimeError(f"containers did not settle in {max_rounds} rounds")
