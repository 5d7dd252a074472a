"""Repeated passages: found by winnowed fingerprints, confirmed by window hashes, located by sharded Aho-Corasick automata.

1. Fingerprints. Of the word q-grams of each 50-word window the one with the least hash is selected (winnowing), so two
   equal windows select the same one at the same place. A fingerprint that only one text has can't belong to a repeated window.
2. Confirmation. In the documents that hold a fingerprint of several documents, the windows that select such a one are hashed
   and counted; those of several documents recur. Each belongs to its first occurrence, in the least doc_id. Consecutive windows
   of that document that occur in just the same places form one pattern: where one of its windows occurs, all of it occurs.
3. Automata. Patterns are dealt to shards by their fingerprint. A task compiles the automaton of one shard at a time (at most about
   SHARD_WORDS nodes) and streams through it the passages of all documents that select a fingerprint of that shard. A
   document takes part in the shards of its own recurring fingerprints only, so work follows the input, not its square.
4. Removal. Each document gets its occurrences back, checks them against the 64-bit hashes of its own first and last window there,
   and loses the words that are covered.
Texts that repeat a smaller doc_id's text as a whole skip steps 1 to 3: all their windows start in that document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceframe.llm.common import Workspace, byte_words, gram_hashes, released, word_hashes

WINDOW, GRAM, SHARD_WORDS, TASK_SEGMENTS = 50, 25, 250_000, 100_000
_P = 2147483647
_NO_ID = 9223372036854775807


def selected(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of word hashes: the place of its selected q-gram (leftmost of the least); and the q-grams' hashes."""
    grams = gram_hashes(h, GRAM)
    width = WINDOW - GRAM + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), grams
    at, span = np.arange(len(grams)), 1
    while span * 2 <= width:
        left, right = at[:-span], at[span:]
        at = np.where(grams[right] < grams[left], right, left)
        span *= 2
    left, right = at[:n], at[width - span : width - span + n]
    return np.where(grams[right] < grams[left], right, left), grams


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp, docs, keys = [], [], []
        for key, tk, text in zip(pdf["key"], pdf["tk"], pdf["text"]):
            at, grams = selected(word_hashes(byte_words(text)))
            if len(at):
                own = np.unique(grams[at]).view(np.int64)
                fp.append(own)
                docs.append(np.full(len(own), key))
                keys.append(np.full(len(own), tk))
        if fp:
            yield pd.DataFrame({"fp": np.concatenate(fp), "key": np.concatenate(docs), "tk": np.concatenate(keys)})


def _recurring(text: str, fps) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a document: word hashes; starts of the windows that select a recurring fingerprint; the place each selects; all windows' hashes."""
    h = word_hashes(byte_words(text))
    at, grams = selected(h)
    known = np.isin(grams[at].view(np.int64), np.asarray(fps, np.int64))
    return h, np.flatnonzero(known), at, gram_hashes(h, WINDOW)


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, tk, text, fps in zip(pdf["key"], pdf["tk"], pdf["text"], pdf["fps"]):
            _, starts, _, w = _recurring(text, fps)
            out.append(pd.DataFrame({"w": w[starts].view(np.int64), "key": key, "tk": tk, "pos": starts.astype(np.int32)}))
        if out:
            yield pd.concat(out)


def _codes(h: np.ndarray) -> np.ndarray:
    """Each word as one character: a 20-bit hash above the surrogates. Occurrences are checked again on 64-bit hashes."""
    return ((h >> np.uint64(40)) % np.uint64(0xFFFFF) + np.uint64(0x10000)).astype("<u4")


_PIECE = "shard long, kind int, key long, tk long, start int, codes binary, w1 long, w2 long"


def _pieces(shards: int):
    """Patterns of one document, and its stretches that select a recurring fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, tk, text, fps, own in zip(pdf["key"], pdf["tk"], pdf["text"], pdf["fps"], pdf["own"]):
                h, starts, at, w = _recurring(text, fps)
                if not len(starts):
                    continue
                codes, signed = _codes(h), w.view(np.int64)
                grams = gram_hashes(h, GRAM)
                shard = (grams[at[starts]] % np.uint64(shards)).astype(np.int64)
                cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(at[starts]) != 0)) + 1
                for part in np.split(np.arange(len(starts)), cut):
                    s, e = int(starts[part[0]]), int(starts[part[-1]])
                    out.append((int(shard[part[0]]), 1, key, tk, s, codes[s : e + WINDOW].tobytes(), 0, 0))
                if own is None or not len(own):
                    continue
                mine = [x for x in own if x["pos"] < len(signed) and signed[x["pos"]] == x["w"]]
                run_of: list = []
                for x in [*mine, None]:
                    y = run_of[-1] if run_of else None
                    if y is not None and (x is None or x["pos"] != y["pos"] + 1 or x["n"] != y["n"] or x["a"] != y["a"] or x["b"] != (y["b"] + y["a"]) % _P or at[x["pos"]] != at[y["pos"]]):
                        s, e = run_of[0]["pos"], y["pos"]
                        out.append((int(grams[at[s]] % np.uint64(shards)), 0, key, tk, s, codes[s : e + WINDOW].tobytes(), int(signed[s]), int(signed[e])))
                        run_of = []
                    if x is not None:
                        run_of.append(x)
            yield pd.DataFrame(out, columns=["shard", "kind", "key", "tk", "start", "codes", "w1", "w2"])

    return run


def _located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard, salt and kind, patterns before passages: one automaton at a time."""
    at, auto, ready = None, None, False
    for pdf in batches:
        out = []
        for shard, salt, kind, key, tk, start, codes, w1, w2 in zip(*(pdf[c] for c in ("shard", "salt", "kind", "key", "tk", "start", "codes", "w1", "w2"))):
            if (shard, salt) != at:
                at, auto, ready = (shard, salt), ahocorasick.Automaton(), False
            word = codes.decode("utf-32-le")
            if kind == 0:
                value = (len(word), key, w1, w2)
                auto.add_word(word, [*auto.get(word, []), value])
                continue
            if not len(auto):
                continue
            if not ready:
                auto.make_automaton()
                ready = True
            for end, found in auto.iter(word):
                out += [(key, tk, start + end + 1 - n, n, a, b) for n, owner, a, b in found if owner < key]
        yield pd.DataFrame(out, columns=["key", "tk", "start", "n", "w1", "w2"])


def repeated_passages(docs: DataFrame, ws: Workspace) -> DataFrame:
    """docs(key long, tk long, text): distinct texts. Returns key, tk, spans: array of (start, n, w1, w2), words of the text that also stand in a
    document with a smaller key; w1 and w2 are the hashes of the first and the last window, to be checked against the text."""
    fps = docs.mapInPandas(released(_fingerprints), "fp long, key long, tk long")
    shared = fps.groupBy("fp").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("fp")
    hits = fps.join(shared, "fp").groupBy("key", "tk").agg(F.collect_list("fp").alias("fps"))
    held = ws.save(docs.join(hits, ["key", "tk"]), "held")

    id_hash = F.pmod(F.xxhash64("key", "tk"), F.lit(_P))
    windows = held.mapInPandas(released(_windows), "w long, key long, tk long, pos int")
    counted = windows.groupBy("w").agg(
        F.min(F.struct("key", "tk", "pos")).alias("o"), F.max("key").alias("hi"), F.count("*").alias("n"),
        F.sum(id_hash).alias("a"), F.sum(F.pmod(id_hash * F.col("pos"), F.lit(_P))).alias("b"),
    ).where("o.key < hi")
    owned = counted.select("o.key", "o.tk", "o.pos", "w", "n", F.pmod("a", F.lit(_P)).alias("a"), F.pmod("b", F.lit(_P)).alias("b"))
    owned = ws.save(owned.groupBy("key", "tk").agg(F.sort_array(F.collect_list(F.struct("pos", "w", "n", "a", "b"))).alias("own")), "owned")

    words = owned.agg(F.sum(F.size("own"))).first()[0] or 0
    shards = 1 + 4 * words // SHARD_WORDS  # a pattern of k windows has k + 49 words
    cut = ws.save(held.join(owned, ["key", "tk"], "left").mapInPandas(released(_pieces(shards)), _PIECE), "pieces")
    ws.drop(held, owned)
    salts = cut.where("kind = 1").groupBy("shard").count().select("shard", (F.col("count") / TASK_SEGMENTS).cast("int").alias("more"))
    rows = cut.join(salts, "shard")
    every = F.sequence(F.lit(0), F.col("more"))
    one = F.array(F.pmod(F.xxhash64("key", "tk", "start"), F.col("more") + 1).cast("int"))
    rows = rows.withColumn("salt", F.explode(F.when(F.col("kind") == 0, every).otherwise(one))).drop("more")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInPandas(released(_located), "key long, tk long, start int, n int, w1 long, w2 long")
    return ws.save(found.groupBy("key", "tk").agg(F.collect_set(F.struct("start", "n", "w1", "w2")).alias("spans")), "spans")


def _without(text: str | None, spans: list | None, copy: bool) -> tuple[str | None, int, int]:
    words = byte_words(text)
    left = words
    if copy and len(words) >= WINDOW:
        left = []
    elif spans:
        w = gram_hashes(word_hashes(words), WINDOW).view(np.int64)
        edge = np.zeros(len(words) + 1, np.int64)
        for x in spans:
            s, e = x["start"], x["start"] + x["n"]
            if e <= len(words) and w[s] == x["w1"] and w[e - WINDOW] == x["w2"]:
                edge[s] += 1
                edge[e] -= 1
        left = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    if len(left) == len(words):
        return text, len(words), 0
    return b" ".join(left).decode("utf-8", "surrogatepass"), len(words), len(words) - len(left)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [_without(t, s, c) for t, s, c in zip(*(batch.column(n).to_pylist() for n in ("text", "spans", "copy")))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["row", "text", "n_words", "n_removed"]
        )


def remove_repeated_passages(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> its rows with all columns, text without the words of repeated passages, and n_words, n_removed.

    A word goes when a window of 50 consecutive words that covers it also starts in a document with a smaller doc_id. Windows are judged
    on the input. A changed text is its kept words joined by one space; an unchanged text stays as it is, white space included.
    Null texts count no words and stay null; texts under 50 words stay. A null doc_id counts as larger than all others, and no two
    such rows judge each other; rows that share a doc_id don't either. Columns of docs named like the helpers are kept apart."""
    ws = ws or Workspace(docs.sparkSession, "passages")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("doc_id", F.lit(_NO_ID)).cast("long").alias("key"), F.xxhash64("text").alias("tk"), "text")
    slim = rows.select("key", "tk", F.md5(F.encode("text", "utf-8")).alias("m"))
    firsts = ws.save(slim.groupBy("m", "tk").agg(F.min("key").alias("key")), "texts")
    spans = repeated_passages(rows.where(F.length("text") >= 2 * WINDOW - 1).select("key", "tk", "text").join(firsts.select("key", "tk"), ["key", "tk"], "left_semi"), ws)
    copies = slim.join(firsts.withColumnRenamed("key", "first"), ["m", "tk"]).where("first < key").select("key", "tk", F.lit(True).alias("copy")).distinct()
    judged = rows.join(spans.join(copies, ["key", "tk"], "full"), ["key", "tk"], "left").select("row", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    others = [c for c in docs.columns if c != "text"]
    out = judged.select(F.struct(*[F.col(f"row.`{c}`") for c in others]).alias("row"), "text", "spans", "copy")
    kind = out.schema["row"].dataType.simpleString()
    done = out.mapInArrow(released(_kept), f"row {kind}, text string, n_words long, n_removed long")
    same = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*same, "n_words", "n_removed")


def kept_digest(text: str | None) -> str:
    return hashlib.sha256(b" ".join(byte_words(text))).hexdigest()
