"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a chance p = sigmoid(bias + weights of its distinct words and word starts) of being offensive, and the
document's score is their noisy-or, 1 - (1 - leak) * prod(1 - p). Only documents have labels; the gradient of the document's likelihood
tells each sentence how much of the label it has to explain, and the fitted p then point out the offending sentences.
As a fit that stops early is too timid, two numbers then stretch and shift the log odds of the scores; they come from scores of FOLDS parts of the
sample, each by a fit on the others. The model is fitted on a bounded sample of labelled documents (SAMPLE, the least hashes of doc_id) with at most VOCABULARY words, so its size
never depends on the corpus; scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spliceframe.llm.common import Workspace, release, released

SAMPLE, VOCABULARY, LEAST_DOCS, ROUNDS, RATE, PENALTY, THRESHOLD, OFFENDING, STARTS, FOLDS = 16384, 2048, 3, 150, 0.2, 2e-5, 0.7, 0.5, (5, 7), 3
_SENTENCE = re.compile(r"[^.!?\n]+")
_TOKEN = re.compile(r"[^\W_]+")
_RESULT = "struct<score:double,predicted:int,sentences:int,offending:array<struct<start:int,end:int,score:double>>>"
_OFFENDING = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


@dataclass
class Model:
    bias: float
    leak: float
    weights: dict[str, float]
    stretch: float = 1.0
    shift: float = 0.0


def _with_starts(words: set[str]) -> set[str]:
    """The words, and the first STARTS letters of longer ones, which show what inflected and compound words share."""
    short, long = STARTS
    more = {f"^{w[:short]}" for w in words if len(w) > short}
    more.update([f"^{w[:long]}" for w in words if len(w) > long])
    more |= words
    return more


def sentence_words(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct lower-cased words of each sentence, with the starts of long ones; a text without sentences is one empty sentence."""
    none = True
    for m in _SENTENCE.finditer(text or ""):
        words = _TOKEN.findall(m[0].lower())
        if words:
            none = False
            yield m.start(), m.end(), _with_starts(set(words))
    if none:
        yield 0, 0, set()


def fold_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, toxic = [], []
        for text, y in zip(b.column("text"), b.column("toxic").to_pylist()):
            text = text.as_py()
            own = set().union(*(w for _, _, w in sentence_words(text)))
            words += own
            toxic += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int64())], ["word", "toxic"])


def _bags(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, y, h in zip(b.column("text"), b.column("toxic").to_pylist(), b.column("h").to_pylist()):
                text = text.as_py()
                n, flat, sizes = 0, [], []
                for _, _, words in sentence_words(text):
                    own = [index[w] for w in words & index.keys()]
                    n += 1
                    if own:
                        flat += own
                        sizes.append(len(own))
                rows.append((y, n, flat, sizes, h))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int32())), pa.array([r[4] for r in rows], pa.int64())], ["toxic", "n", "flat", "sizes", "h"])

    return run


def log_none(p: np.ndarray, p0: float, leak: float, doc: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Logarithm of the chance that no sentence of a document is offensive. p: of sentences with known words, doc: whose they are; p0: of each of the plain others."""
    return np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(plain)) + plain * np.log1p(-p0) + np.log1p(-leak)


def log_odds(none: float) -> float:
    return math.log(math.expm1(-none)) if none > -700 else -none


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Stretch and shift of log odds z that make them fit labels y best; stays at 1 and 0 without both labels."""
    theta = np.array([1.0, 0.0])
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        slope = x.T @ (p - y) + (theta - [1.0, 0.0])  # a pull of one document's weight to where it began
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), slope)
        theta = theta - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return float(np.clip(theta[0], 0.2, 5)), float(np.clip(theta[1], -8, 8))


def held_out_odds(y: np.ndarray, n: np.ndarray, flat: np.ndarray, sizes: np.ndarray, per_doc: np.ndarray, words: int, fold: np.ndarray) -> np.ndarray:
    """Log odds of each document by a fit on the folds that it isn't in; arguments as in fit_bags()."""
    doc, z = np.repeat(np.arange(len(y)), per_doc), np.zeros(len(y))
    for k in np.unique(fold):
        own, others = fold == k, fold != k
        if not others.any():
            continue
        s = others[doc]
        bias, leak, w = fit_bags(y[others], n[others], flat[np.repeat(s, sizes)], sizes[s], per_doc[others], words)
        p = 1 / (1 + np.exp(-np.minimum(bias + np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[flat], len(sizes)), 30)))
        none = log_none(p, 1 / (1 + math.exp(-bias)), leak, doc, n - per_doc)
        z[own] = [log_odds(x) for x in none[own]]
    return z


def fit_bags(y: np.ndarray, n: np.ndarray, flat: np.ndarray, sizes: np.ndarray, per_doc: np.ndarray, words: int) -> tuple[float, float, np.ndarray]:
    """y: labels; n: sentences of each document; per_doc of them have known words: sizes[i] word numbers each, in flat. Returns bias, leak, weights.

    Adam on the mean log likelihood of the noisy-or, all documents in each round."""
    doc = np.repeat(np.arange(len(y)), per_doc)
    sent = np.repeat(np.arange(len(sizes)), sizes)
    plain = n - per_doc
    theta = np.zeros(words + 2)
    theta[-2], theta[-1] = -7.0, -4.0  # bias, leak
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        z = theta[-2] + np.bincount(sent, theta[flat], len(sizes))
        p = 1 / (1 + np.exp(-z))
        p0, leak = 1 / (1 + np.exp(-theta[-2])), 1 / (1 + np.exp(-theta[-1]))
        none = log_none(p, p0, leak, doc, plain)
        keep = np.exp(none)
        pull = np.where(y > 0, -keep / np.maximum(1 - keep, 1e-9), 1.0)  # d loss / d (-none)
        gz = p * pull[doc]
        g = np.zeros_like(theta)
        g[:words] = np.bincount(flat, gz[sent], words) / len(y) + PENALTY * theta[:words]
        g[-2] = (gz.sum() + (p0 * plain * pull).sum()) / len(y)
        g[-1] = (leak * pull).sum() / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        theta[-1] = min(theta[-1], -2.0)
        theta[-2] = min(theta[-2], -5.0)
    return float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))), theta[:words]


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace | None = None) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic): those to learn from. Null ids and labels are left out; of labels that repeat a doc_id the largest counts.

    Without labelled rows, or without a word that toxic ones prefer, all texts score close to the leak."""
    ws = ws or Workspace(docs.sparkSession, "toxic")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    picked = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE).select("doc_id", "toxic", "h")
    sample = ws.save(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic", "h"), "sample")  # at most SAMPLE rows are broadcast
    count, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not count:
        return Model(-7.0, 0.02, {})
    rate = toxic / count
    df = sample.mapInArrow(released(_words_of), "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    expected = F.col("n") * F.lit(rate)
    best = df.where((F.col("t") >= LEAST_DOCS) & (F.col("t") > 1.5 * expected)).withColumn("gain", (F.col("t") - expected) ** 2 / expected)
    words = [r[0] for r in best.orderBy(F.desc("gain"), "word").limit(VOCABULARY).select("word").collect()]
    bags = sample.mapInArrow(released(_bags({w: i for i, w in enumerate(words)})), "toxic long, n long, flat array<int>, sizes array<int>, h long").toPandas().sort_values("h", kind="stable")
    per_doc = np.array([len(s) for s in bags["sizes"]], np.int64)
    joined = lambda c: np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in bags[c]]])
    data = bags["toxic"].to_numpy(float), bags["n"].to_numpy(float), joined("flat"), joined("sizes"), per_doc, len(words)
    bias, leak, w = fit_bags(*data)
    stretch, shift = calibrate(held_out_odds(*data, bags["h"].to_numpy() % FOLDS), data[0])
    ws.drop(sample)
    return Model(bias, leak, {k: float(x) for k, x in zip(words, w)}, stretch, shift)


def score_text(text: str | None, model: Model, plain: float | None = None) -> dict:
    """Score, prediction, number of sentences and offending sentences of one text. plain: log(1 - p) of a sentence without known words."""
    plain = float(np.log1p(-1 / (1 + np.exp(-model.bias)))) if plain is None else plain
    keys, weights = model.weights.keys(), model.weights
    none, n, worst = float(np.log1p(-model.leak)), 0, []
    for start, end, words in sentence_words(text):
        n += 1
        own = words & keys
        if not own:
            none += plain
            continue
        p = min(1 / (1 + math.exp(-min(model.bias + sum(weights[w] for w in sorted(own)), 30.0))), 1 - 1e-12)
        none += math.log1p(-p)
        if p >= OFFENDING:
            worst.append({"start": start, "end": end, "score": p})
    z = model.stretch * log_odds(none) + model.shift
    score = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
    return {"score": score, "predicted": int(score >= THRESHOLD), "sentences": n, "offending": worst}


def scorer(model: Model):
    """A column function from text to score, prediction, number of sentences, and the offending sentences' places in code points."""

    @arrow_udf(_RESULT)
    def score(texts: pa.Array) -> pa.Array:
        plain = float(np.log1p(-1 / (1 + np.exp(-model.bias))))
        rows = [score_text(t.as_py(), model, plain) for t in texts]
        release()
        return pa.array(rows, pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("sentences", pa.int32()), ("offending", _OFFENDING)]))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> row (all its columns), held_out, and the scorer's fields, for each row of docs.

    Learns from labels of rows that aren't held out. Scores depend on the text alone: null and empty texts score as one empty sentence, rows that
    repeat each get the same score, long texts are scored whole."""
    model = fit(docs, labels.where(~fold_held_out(F.col("doc_id"))), ws)
    out = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text").withColumn("t", scorer(model)("text"))
    return out.select("row", fold_held_out(F.col("doc_id")).alias("held_out"), "t.score", "t.predicted", "t.sentences", "t.offending")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns."""
    kept = score_documents(docs, labels).where("predicted = 0")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
