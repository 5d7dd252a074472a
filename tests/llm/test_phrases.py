"""Collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spliceframe.llm import collocations


def brute(rows, least=10, top=2000, inside=50):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        within = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    within[p[i : i + k]] = max(within[p[i : i + k]], a)
        rows = []
        for p, a in cand.items():
            if 100 * within[p] >= inside * a and within[p]:
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "漢字", "\x00", "a b", "﻿x", "end\x1c"]
    rows = []
    for i in range(600):
        words = rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.choice([0, 1, 2, 5, 40, 90]))
        text = ""
        for w in words:
            text += (w.upper() if rng.random() < 0.1 else w) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "; !"])
        if i % 3 == 0:
            text += "new york city hall. " * rng.randrange(3) + "aa " * rng.randrange(30)
        rows.append((rng.choice(["en", "en", "fr", None, "und", ""]), text))
    return rows + [("en", None), (None, None), ("xx", "once only"), ("yy", "...!!"), ("en", "tail words " * 3000)]


@pytest.mark.parametrize("shard_words", [collocations.SHARD_WORDS, 50])
def test_collocations_equal_brute_force(spark, texts, shard_words):
    docs = spark.createDataFrame([(a, b, "clash", 1, 1) for a, b in texts], "lang string, text string, word string, n int, local int").repartition(5)
    want = brute(texts)
    assert rows_of(collocations.collocations(docs, shard_words=shard_words)) == want
    assert len(want) > 100 and {len(r[2].split(" ")) for r in want} == {2, 3}


def test_collocations_with_other_limits(spark, texts):
    docs = spark.createDataFrame(texts, "lang string, text string")
    assert rows_of(collocations.collocations(docs, 3, 7, 80)) == brute(texts, 3, 7, 80)


def test_collocations_of_odd_tables(spark, odd, none):
    assert collocations.collocations(none.withColumn("lang", none["source"])).collect() == []
    got = rows_of(collocations.collocations(odd.withColumn("lang", odd["source"])))
    assert got == brute([(r["source"], r["text"]) for r in odd.collect()])


def test_scores_past_64_bits(spark):
    rows = spark.createDataFrame([(4 * 10**12, 5 * 10**12, 7 * 10**12)], "a long, l long, r long")
    from pyspark.sql import functions as F

    assert rows.select(collocations._score(F.col("l"), F.col("r"))).first()[0] == 10**6 * 16 * 10**24 // (35 * 10**24)


def test_a_shift_crosses_blocks_and_stops_at_empty_positions():
    open_ = collocations._Open()
    open_.add(collocations.pieces(b" ".join([b"a b"] * 20) + b". b a"))
    words, n, blob = open_.bitmaps()
    many, block, bits = collocations.unpacked(blob)
    assert words == [b"a", b"b"] and n.tolist() == [21, 21] and int(np.bitwise_count(bits).sum()) == 42 and many.sum() == len(block)
    shard = pa.table({"at": [50], "bitmaps": pa.array([blob], pa.binary())})
    words = pa.table({"pair": [False, False], "a": [51, 50], "b": [70, 60]})
    pairs = collocations._pairs(shard, words).to_pylist()
    assert {(r["shard"], r["id1"], r["id2"]): r["n"] for r in pairs} == {(50, 60, 70): 20, (50, 70, 60): 20}
    known = pa.concat_tables([words, pa.table({"pair": [True, True], "a": [60, 70], "b": [70, 60]})])
    assert [tuple(r.values()) for r in collocations._triples(shard, known).to_pylist()] == [(60, 70, 60, 19), (70, 60, 70, 19)]
