"""Phrases whose words stand together more often than chance, mined over position bitmaps.

Texts are cut into pieces and words. The words of many documents of one language stand in a row of positions, a shard, with an empty position behind each
piece. Each word of a shard has a bitmap of its positions, compressed: only blocks of 16 positions that hold it are kept, as block numbers and bits.
A phrase's bitmap marks where its last word stands. Shifted by one position and met (AND) with the words' bitmaps it gives those of the phrases one word longer; as no
word stands on the empty positions, none runs over a piece's end. Bits left are counted and summed over shards. A shard is walked depth first: a handful of words
at a time, their pairs, then the triples below those pairs.

Between the depths the sums over all shards prune: a phrase can't be more frequent than its parts, so only words and pairs that are frequent in their whole language
are extended. What a shard needs to know of that comes to it by its number; no dictionary is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceframe.llm.common import Workspace

LEAST, TOP, INSIDE_PERCENT, SCALE = 10, 2000, 50, 1_000_000
#: Positions of a shard, and of all shards that a task has open, after which they are written. A document is never cut.
SHARD_WORDS, OPEN_WORDS = 1 << 20, 1 << 21
_STEP, _SALTS = 1 << 20, 128
#: Ends of pieces become a byte that UTF-8 never has.
_END = b"\xff"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ENDS, b"abcdefghijklmnopqrstuvwxyz" + _END * len(_ENDS))


def pieces(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased, with _END where a piece ends. Of the bytes that split() splits at only space and tab are left by then."""
    return text.translate(_TABLE).replace(_END, b" \xff ").split()


class _Open:
    """A shard that is being filled."""

    def __init__(self):
        self.codes, self.parts, self.n = {_END: 0}, [], 0

    def add(self, words: list[bytes]) -> None:
        codes = self.codes
        part = np.array([codes.setdefault(w, len(codes)) for w in words] + [0], np.int32)
        self.parts.append(part)
        self.n += len(part)

    def bitmaps(self) -> tuple[list[bytes], np.ndarray, bytes]:
        """Words, how often each stands in the shard, and all their bitmaps, compressed."""
        code = np.concatenate(self.parts)
        order = np.argsort(code, kind="stable")
        order = order[np.count_nonzero(code == 0) :]
        code, block, bit = code[order], (order >> 4).astype(np.int32), (1 << (order & 15)).astype(np.uint16)
        new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])]) if len(code) else np.zeros(0, np.int64)
        bits = np.bitwise_or.reduceat(bit, new) if len(new) else bit
        block, owner = block[new], code[new]
        many = np.bincount(owner, minlength=len(self.codes))[1:]
        return list(self.codes)[1:], np.bincount(code, minlength=len(self.codes))[1:], packed(many, block, bits)


def packed(many: np.ndarray, block: np.ndarray, bits: np.ndarray) -> bytes:
    """Bitmaps of words one after the other: how many blocks each has, their numbers as steps from the one before, their bits."""
    steps = np.diff(block, prepend=np.int32(0)).astype(np.int32)
    raw = np.array([len(many), len(block)], np.int64).tobytes() + many.astype(np.int32).tobytes() + steps.tobytes() + bits.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """many, block, bits of packed()."""
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    words, blocks = np.frombuffer(raw, np.int64, 2)
    many = np.frombuffer(raw, np.int32, words, 16)
    steps = np.frombuffer(raw, np.int32, blocks, 16 + 4 * words)
    return many, np.cumsum(steps, dtype=np.int64), np.frombuffer(raw, np.uint16, blocks, 16 + 4 * words + 4 * blocks)


_BITMAPS = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("bitmaps", pa.binary())])


def _filled(shard_words: int, open_words: int):
    """Rows (lang, text) of a task to the words of its shards; a shard goes by the number of its first row, which holds its bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40  # rows are numbered within the task
        open_: dict[str, _Open] = {}

        def closed(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            words, n, blob = open_.pop(lang).bitmaps()
            for at in range(0, len(words), 1 << 16):
                part = words[at : at + (1 << 16)]
                k = len(part)
                columns = [np.full(k, number), np.arange(number + at, number + at + k), [lang] * k, part, n[at : at + k], [None if at else blob] + [None] * (k - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BITMAPS)], schema=_BITMAPS)
            number += len(words)

        total = 0
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                lang = langs[i].as_py()
                shard = open_.setdefault(lang, _Open())
                before = shard.n
                shard.add(pieces(texts[i].as_py()))
                total += shard.n - before
                if total >= open_words:
                    for other in list(open_):
                        yield from closed(other)
                    total = 0
                elif shard.n >= shard_words:
                    total -= shard.n
                    yield from closed(lang)
        for lang in list(open_):
            yield from closed(lang)

    return run


class _Shard:
    """The bitmaps of a shard for the words that count, numbered 0, 1, ... in order of local: by word, and by block for meeting them."""

    def __init__(self, blob: bytes, local: np.ndarray):
        many, block, bits = unpacked(blob)
        dense = np.full(len(many), -1)
        dense[local] = np.arange(len(local))
        word = np.repeat(dense, many)
        kept = np.flatnonzero(word >= 0)
        self.words, self.word, self.block, self.bits = len(local), word[kept], block[kept], bits[kept]
        by_block = np.argsort(self.block, kind="stable")
        self.met_word, self.met_bits = self.word[by_block], self.bits[by_block]
        last = int(self.block.max(initial=-1)) + 2  # a shift may carry into the block behind the last one
        self.first = np.searchsorted(self.block[by_block], np.arange(last + 1))

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """word, block, bits of so many bitmaps that about _STEP entries are met."""
        met = np.cumsum(self.first[self.block + 1] - self.first[self.block]) // _STEP
        cuts = np.r_[0, np.flatnonzero(np.diff(met)) + 1, len(met)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i < j:
                yield self.word[i:j], self.block[i:j], self.bits[i:j]

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps of phrases shifted by a position and met with each word's: phrase, word, block, bits where any bit is left."""
        over = np.flatnonzero(bits >> 15)
        within = np.flatnonzero(bits & 0x7FFF)
        phrase = np.concatenate([phrase[within], phrase[over]])
        block = np.concatenate([block[within], block[over] + 1])
        bits = np.concatenate([(bits[within] << 1).astype(np.uint16), np.ones(len(over), np.uint16)])
        first = self.first[block]
        many = self.first[block + 1] - first
        row = np.repeat(np.arange(len(block)), many)
        entry = np.arange(len(row)) + np.repeat(first - np.cumsum(many) + many, many)
        both = bits[row] & self.met_bits[entry]
        left = np.flatnonzero(both)
        row = row[left]
        return phrase[row], self.met_word[entry[left]], block[row], both[left]


def _summed(keys: list[np.ndarray], bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the bits counted for each."""
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    n = np.concatenate(bits) if bits else np.zeros(0, np.int64)
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, n, len(key)).astype(np.int64)


def _places(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among the sorted ones, and whether it does."""
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), bool)


_PAIRS = pa.schema([("shard", pa.int64()), ("id1", pa.int64()), ("id2", pa.int64()), ("n", pa.int64())])
_TRIPLES = pa.schema([("id1", pa.int64()), ("id2", pa.int64()), ("id3", pa.int64()), ("n", pa.int64())])


def _opened(shards: pa.Table, words: pa.Table) -> tuple[int, _Shard, np.ndarray]:
    """A shard's number, its bitmaps and the ids of its words that count. words: their rows' numbers (a) and ids (b)."""
    at = shards.column("at")[0].as_py()
    local, id_ = words.column("a").to_numpy() - at, words.column("b").to_numpy()
    order = np.argsort(local)
    return at, _Shard(shards.column("bitmaps")[0].as_py(), local[order]), id_[order]


def _pairs(shards: pa.Table, words: pa.Table) -> pa.Table:
    """One shard's pairs of frequent words and how often they stand there."""
    if not shards.num_rows or not words.num_rows:
        return _PAIRS.empty_table()
    at, shard, id_ = _opened(shards, words)
    keys, bits = [], []
    for chunk in shard.chunks():
        phrase, word, _, both = shard.extended(*chunk)
        key, n = _summed([phrase * shard.words + word], [np.bitwise_count(both)])
        keys.append(key)
        bits.append(n)
    key, n = _summed(keys, bits)
    return pa.table([np.full(len(key), at), id_[key // shard.words], id_[key % shard.words], n], schema=_PAIRS)


def _triples(shards: pa.Table, known: pa.Table) -> pa.Table:
    """One shard's triples whose pairs are frequent, and how often they stand there. known: its frequent words, and its frequent pairs as ids a and b."""
    pairs = known.filter(pc.field("pair"))
    if not shards.num_rows or not pairs.num_rows:
        return _TRIPLES.empty_table()
    _, shard, id_ = _opened(shards, known.filter(~pc.field("pair")))
    v, by_id = shard.words, np.argsort(id_)
    dense = lambda c: by_id[np.searchsorted(id_[by_id], pairs.column(c).to_numpy())]
    pair = np.sort(dense("a") * v + dense("b"))
    keys, bits = [], []
    for chunk in shard.chunks():
        phrase, word, block, both = shard.extended(*chunk)
        at, frequent = _places(pair, phrase * v + word)
        phrase, word, _, both = shard.extended(at[frequent], block[frequent], both[frequent])
        _, frequent = _places(pair, pair[phrase] % v * v + word)
        key, n = _summed([phrase[frequent] * v + word[frequent]], [np.bitwise_count(both[frequent])])
        keys.append(key)
        bits.append(n)
    key, n = _summed(keys, bits)
    two = pair[key // v]
    return pa.table([id_[two // v], id_[two % v], id_[key % v], n], schema=_TRIPLES)


def position_bitmaps(docs: DataFrame, shard_words: int = SHARD_WORDS, open_words: int = OPEN_WORDS) -> DataFrame:
    """docs(lang, text, ...) -> shard, row, lang, word, n, bitmaps: a row for each word of a shard, the first of them with the bitmaps of all. A null lang is 'und', a null text empty."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_filled(shard_words, open_words), "shard long, row long, lang string, word binary, n long, bitmaps binary")


def _score(l: Column, r: Column) -> Column:
    """floor(SCALE * a * a / (l * r)) in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    over, under = wide(F.col("a")) * wide(F.col("a")) * F.lit(SCALE), wide(l) * wide(r)
    return F.call_function("div", over, under)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT, shard_words: int = SHARD_WORDS, ws: Workspace | None = None) -> DataFrame:
    """docs(lang, text, ...) -> lang, rank, phrase, a, l, r, n, score: each language's first phrases of two or three words.

    A phrase stands at least `least` times (a). Cut in two, its parts stand l and r times; the cut of the lowest score counts, ties to the earlier one. A pair within a triple that
    stands inside_percent of the pair's times or more is left out. Order: score, a (both falling), phrase by its bytes. n: all words of the language. Rows count one by one, whether or not
    they repeat; a null lang is 'und', and other columns are unread. No phrase, no rows."""
    ws = ws or Workspace(docs.sparkSession, "phrases")
    maps = ws.save(position_bitmaps(docs, shard_words, max(OPEN_WORDS, shard_words)), "bitmaps")
    # A word goes by the least number of its rows. Sums are taken where the rows meet, so rows that count are found in the same shuffle.
    same = Window.partitionBy("lang", "word")
    words = maps.select("shard", "row", "lang", "word", "n").withColumns({"f": F.sum("n").over(same), "id": F.min("row").over(same)}).where(F.col("f") >= least)
    own = F.col("row") == F.col("id")
    words = ws.save(words.select("shard", "row", "id", *[F.when(own, F.col(c)).alias(c) for c in ("lang", "word", "f")]), "words")
    shards = maps.where("bitmaps is not null").select(F.col("shard").alias("at"), "bitmaps")
    of_shard = words.select("shard", F.lit(False).alias("pair"), F.col("row").alias("a"), F.col("id").alias("b"))
    found = shards.groupBy("at").cogroup(of_shard.groupBy("shard")).applyInArrow(_pairs, "shard long, id1 long, id2 long, n long")
    same = Window.partitionBy("id1", "id2")
    found = found.withColumns({"a": F.sum("n").over(same), "first": F.min("shard").over(same)}).where(F.col("a") >= least)
    found = ws.save(found.select("shard", "id1", "id2", F.when(F.col("shard") == F.col("first"), F.col("a")).alias("a")), "pairs")

    words = words.where("f is not null")
    side = lambda k: words.select(F.col("id").alias(f"id{k}"), *([F.col("lang")] if k == 1 else []), F.col("word").cast("string").alias(f"w{k}"), F.col("f").alias(f"f{k}"))
    pairs = ws.save(found.where("a is not null").select("id1", "id2", "a").join(side(1), "id1").join(side(2), "id2"), "frequent")
    known = of_shard.unionAll(found.select("shard", F.lit(True).alias("pair"), F.col("id1").alias("a"), F.col("id2").alias("b")))
    triples = shards.groupBy("at").cogroup(known.groupBy("shard")).applyInArrow(_triples, "id1 long, id2 long, id3 long, n long")
    triples = triples.groupBy("id1", "id2", "id3").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    head = pairs.select("id1", "id2", "lang", "w1", "w2", "f1", F.col("a").alias("f12"))
    tail = pairs.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    triples = ws.save(triples.join(head, ["id1", "id2"]).join(tail, ["id2", "id3"]), "triples")

    cut = lambda k, l, r: F.struct(_score(F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
    longer = triples.select(F.explode(F.array(F.struct("id1", "id2"), F.struct(F.col("id2").alias("id1"), F.col("id3").alias("id2")))).alias("p"), "a").groupBy("p.id1", "p.id2").agg(F.max("a").alias("in"))
    two = pairs.join(longer, ["id1", "id2"], "left").where(F.coalesce(100 * F.col("in") < inside_percent * F.col("a"), F.lit(True)))
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut(1, "f1", "f2").alias("cut"))
    three = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")).alias("cut"))
    every = two.unionByName(three).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # The first of each share of a language's phrases, then the first of those.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = maps.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
