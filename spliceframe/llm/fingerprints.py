"""Order MinHash fingerprints in column expressions.

A text's tokens are its words; a word of more than LONG code points, as text without spaces has, is taken as its single code points. Its token k-mers are numbered by occurrence, so the second "a b c" differs from the first. Each numbered k-mer is dealt to one of BUCKETS by its
hash; the two of least hash in each bucket are its sample, put back into text order and hashed as a tuple. Equal tuples need equal k-mers in equal order, so
the share of equal buckets falls with edit distance, and with reordering that set-based sketches don't see.
Everything is packed into longs: sorting long arrays is the only costly step and it stays in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KMER, BUCKETS, TUPLE_BITS, LONG = 3, 64, 18, 32
_POS = (1 << 26) - 1  # a position's bits: a text of more words wraps around, which only blurs its order
_HIGH = ~_POS
_LIFT = [1 << b for b in range(25, -1, -1)]


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _high(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_HIGH))


def _steps(most: int) -> Column:
    return F.array(*[F.lit(b) for b in _LIFT if b <= most])


def _occurrence(p: Column, x: Column, i: Column) -> Column:
    """How many equal k-mers stand before place i of the sorted array p: a binary search, run only where the neighbour is equal."""
    same = lambda at: _high(F.get(p, at)) == _high(x)
    search = F.aggregate(_steps(1 << 25), F.lit(0), lambda t, b: F.when(same(i - t - b), t + b).otherwise(t))
    return F.when(same(i - 1), search).otherwise(F.lit(0))


def _bucket(x: Column) -> Column:
    return F.shiftrightunsigned(x, 58)


def sketch(text: Column) -> Column:
    """array<int>, one entry for each bucket that has a k-mer: bucket << TUPLE_BITS | tuple hash, in an order set by the text alone.

    A text of fewer than KMER tokens is one k-mer; one without words gives an empty array."""
    cut = lambda w: F.when(F.char_length(w) > LONG, F.split(w, "")).otherwise(F.array(w))
    tokens = lambda w: F.when(F.exists(w, lambda x: F.char_length(x) > LONG), F.flatten(F.transform(w, cut))).otherwise(w)
    words = _let(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), tokens)
    grams = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (KMER - 1), F.lit(1))), lambda i: _high(F.xxhash64(F.slice(w, i, KMER))).bitwiseOR((i - 1).bitwiseAND(F.lit(_POS)).cast("long")))).otherwise(F.array().cast("array<bigint>"))

    def dealt(p: Column) -> Column:
        def pack(x: Column, i: Column) -> Column:
            g = F.xxhash64(_high(x), _occurrence(p, x, i))
            return _high(g).bitwiseOR(x.bitwiseAND(F.lit(_POS)))  # bucket in the top 6 bits, 32 bits of hash, position

        return F.sort_array(F.transform(p, pack))

    least = lambda s: F.filter(s, lambda x, i: F.coalesce(_bucket(F.get(s, i - 2)) != _bucket(x), F.lit(True)))

    def tuples(c: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            pos = lambda v: v.bitwiseAND(F.lit(_POS))
            y = F.get(c, i + 1)
            pair = F.when(pos(x) <= pos(y), F.xxhash64(_high(x), _high(y))).otherwise(F.xxhash64(_high(y), _high(x)))
            value = F.when(_bucket(y) == _bucket(x), pair).otherwise(F.xxhash64(_high(x)))
            packed = F.shiftleft(_bucket(x), TUPLE_BITS).bitwiseOR(F.shiftrightunsigned(value, 64 - TUPLE_BITS)).cast("int")
            return F.when(F.coalesce(_bucket(F.get(c, i - 1)) != _bucket(x), F.lit(True)), packed)

        return F.filter(F.transform(c, entry), lambda e: e.isNotNull())

    return _let(_let(_let(F.sort_array(_let(words, grams)), dealt), least), tuples)


def as_text(entries: Column) -> Column:
    """Six hexadecimal digits for each entry."""
    return F.lower(F.array_join(F.transform(entries, lambda e: F.lpad(F.hex(e), 6, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Equal buckets as a share of those that either has; two empty sketches are alike."""
    bucket = lambda x: F.transform(x, lambda e: F.shiftright(e, TUPLE_BITS))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(bucket(a), bucket(b)))), F.lit(1.0))


def _up_to(splits: Column, most: int, key: Column) -> Column:
    """How many of the sorted splits are <= key."""
    return F.aggregate(_steps(most), F.lit(0), lambda t, b: F.when(F.get(splits, t + b - 1) <= key, t + b).otherwise(t))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The edited text is the text with its last n_chars // 2 code points replaced by the first as many of the next row's text, by doc_id (null
    first) and then text; the last row is followed by the first. A null text is empty; a row on its own follows itself.
    Rows are dealt to ranges of doc_id once; the first row of each range also goes to the range before it, so no window spans the table."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = min(1 << 16, 8 * parts)
    cuts = rows.agg(F.min("k"), F.percentile_approx("k", [i / groups for i in range(groups)], 10 * groups)).first()  # at most 65,537 ids
    splits = sorted({cuts[0], *cuts[1]}) if cuts[0] is not None else [0]
    n = len(splits)
    at = F.lit(splits) if n > 1 else F.array(F.lit(splits[0]))
    at = at.cast("array<bigint>")
    rows = rows.withColumn("g", _up_to(at, n, F.col("k"))).withColumn("leads", F.get(at, F.col("g") - 1) == F.col("k"))
    here = F.struct(F.col("g").alias("g"), F.lit(0).alias("wrap"), F.lit(False).alias("ghost"))
    before = F.struct(F.when(F.col("g") == 1, F.lit(n)).otherwise(F.col("g") - 1).alias("g"), F.when(F.col("g") == 1, F.lit(1)).otherwise(F.lit(0)).alias("wrap"), F.lit(True).alias("ghost"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("leads"), F.array(here, before)).otherwise(F.array(here)))).select("doc_id", "k", "text", "to.g", "to.wrap", "to.ghost")
    rows = rows.repartition(parts, "g").withColumn("s", sketch(F.col("text")))
    order = Window.partitionBy("g").orderBy("wrap", "k", "text")
    rows = rows.withColumns({"next": F.lead("text").over(order), "t": F.lead("s").over(order)}).where(~F.col("ghost"))
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    rows = rows.select("doc_id", "s", "t", chars.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next", F.lit(1), half)).alias("edited"))
    rows = rows.select("doc_id", "n_chars", "s", "t", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("e"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("s")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("t")).alias("near_next"),
    )
