"""Near-duplicate groups by MinHash and an LSH forest.

Each document's set of word shingles gets a signature. A tree of the forest is one order of the signature's values; sorted
by it, rows with a long common prefix stand side by side. Candidates are neighbours in these orders: at whatever depth they meet, deep where
a region is crowded and shallow where it is sparse, down to MIN_DEPTH values. They are confirmed on full sets, and the classes that
links make are contracted, so the next round looks at neighbours of different classes only. A region is a tree and its first MIN_DEPTH values.
What a region still holds of other classes than its largest is then held against the whole region, in blocks: no pair of a region is left out,
and a region of one class, however large, costs nothing more. Before a pair leaves an order or a block it has to pass two exact bounds
that need no set: sizes, and a bitmap. The bitmap has a bit for each residue of the shingles' hashes, set where an odd number of them falls,
so where two bitmaps differ at least one shingle stands in one set only.

TREES trees of depth MIN_DEPTH miss a pair of similarity 0.75 with probability (1 - 0.75**3)**24, about 2e-6.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceframe.llm.common import Workspace, byte_words, gram_hashes, mix, released, word_hashes
from spliceframe.llm.components import connected_components

TREES, MIN_DEPTH, PATH, SHINGLE, PERCENT, BLOCK, HELD = 24, 3, 12, 5, 75, 512, 1 << 21
#: Of each round: every how many trees are sorted, and how many rows before a row are its neighbours.
ROUNDS = ((6, 1), (1, 4))
_CHUNK = 512


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words than size, of the whole sequence; without words, none."""
    words = byte_words(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    if len(h) < size:
        return mix(gram_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(gram_hashes(h, size))


_N = TREES * MIN_DEPTH
_rng = np.random.default_rng(7)
_MUL, _ADD = _rng.integers(0, 2**63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 2**63, _N, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of TREES * MIN_DEPTH independent 32-bit hashes of the set."""
    out = np.full(_N, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), _CHUNK):
        np.minimum(out, ((s[i : i + _CHUNK, None] * _MUL + _ADD) >> np.uint64(32)).min(axis=0), out=out)
    return out.astype(np.uint32)


def bitmap(s: np.ndarray) -> np.ndarray:
    """The parity of the hashes that fall on each of 2 to 4 bits a shingle, a power of two, in words of 64."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


_SIGNED = "doc_id long, tk long, n long, id binary, sig binary, bits array<long>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, rows = b.column("text"), []
        for i in range(b.num_rows):  # one text at a time is taken out of the batch
            s = shingle_set(texts[i].as_py())
            rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).astype(">u4").tobytes(), bitmap(s)) if len(s) else (0, None, None, None))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tk"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", "tk", "n", "id", "sig", "bits"])


def _similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets reach the similarity, counted on the full sets."""
    if min(len(p), len(q)) * 100 < PERCENT * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(both) - common)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, ta, tb = (batch.column(c) for c in ("a", "b", "ta", "tb"))
        sets, held, ok = {}, 0, []
        for i in range(batch.num_rows):
            pair = []
            for k, t in ((a[i].as_py(), ta), (b[i].as_py(), tb)):
                if k not in sets:
                    sets[k] = shingle_set(t[i].as_py())
                    held += len(sets[k])
                pair.append(sets[k])
            ok.append(_similar(*pair))
            if held > HELD:
                sets, held = {}, 0
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _path(tree: int, depth: int) -> Column:
    """The first values of one tree's order: its own MIN_DEPTH values, then those of the trees that follow it."""
    step, n, at = 4, TREES * MIN_DEPTH, tree * MIN_DEPTH
    head = F.substring("sig", at * step + 1, min(depth, n - at) * step)
    return head if at + depth <= n else F.concat(head, F.substring("sig", 1, (at + depth - n) * step))


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as it would be with fewer bits."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """A number that the shingles of one set only aren't below."""
    words = min(len(x), len(y))
    return int(np.bitwise_count((_folded(x, words) ^ _folded(y, words)).view(np.uint64)).sum())


def _able(n: int, m: int, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sizes and bitmaps leave the similarity open: then at most (n + m) * (1 - t) / (1 + t) shingles stand in one set only."""
    return min(n, m) * 100 >= PERCENT * max(n, m) and _apart(x, y) * (100 + PERCENT) <= (n + m) * (100 - PERCENT)


def _neighbours(reach: int):
    """Rows come sorted by tree and path. Those of the reach rows before a row that share MIN_DEPTH values with it and are of another class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: list[tuple] = []
        for pdf in batches:
            out = []
            for row in zip(*(pdf[c] for c in ("region", "id", "c", "n", "bits"))):
                if before and before[-1][0] != row[0]:
                    before = []
                out += [(row[1], o[1]) for o in before if o[2] != row[2] and _able(o[3], row[3], o[4], row[4])]
                before = [*before, row][-reach:]
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _members(classes: DataFrame, step: int, *columns: str) -> DataFrame:
    """A row for each class and tree, with its region."""
    trees = F.array(*[F.xxhash64(F.lit(t), _path(t, MIN_DEPTH)) for t in range(0, TREES, step)])
    return classes.select("id", *columns, F.posexplode(trees).alias("at", "region"))


def _mixed(labelled: DataFrame, ws: Workspace) -> DataFrame:
    """Regions that hold several classes: region, size, main (the largest class), others (rows of the other ones)."""
    counts = _members(labelled, 1, "c").groupBy("region", "c").agg(F.count("*").alias("k"))
    regions = counts.groupBy("region").agg(F.count("*").alias("classes"), F.sum("k").alias("size"), F.max(F.struct("k", "c")).alias("m"))
    return ws.save(regions.where("classes > 1").select("region", "size", F.col("m.c").alias("main"), (F.col("size") - F.col("m.k")).alias("others")), "mixed")


def _near(labelled: DataFrame, step: int, reach: int, regions: DataFrame | None) -> DataFrame:
    """Candidates a, b: neighbours in every step-th order, each sorted as a whole, so that a task has a range of rows whatever the regions' sizes."""
    rows = _members(labelled, step, "c", "n", "bits", "sig")
    if regions is not None:
        rows = rows.join(regions.select("region"), "region")
    path = F.element_at(F.array(*[_path(t, PATH) for t in range(0, TREES, step)]), F.col("at") + 1)
    rows = rows.select("at", path.alias("path"), "region", "id", "c", "n", "bits")
    parts = max(1, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(parts, "at", "path", "id").sortWithinPartitions("at", "path", "id").mapInPandas(released(_neighbours(reach)), "a binary, b binary")


def _pairs_of(rows: list[tuple]) -> list[tuple]:
    """Pairs a, b of one region and block pair that pass both bounds: _able() for all of them at once.

    rows: region, i, j; the row's own block among the other classes, if it is of one, and among all; id, c, main, n, bits."""
    if not rows:
        return []
    i, j = rows[0][1:3]
    sides: tuple[dict, dict] = {}, {}
    for r in rows:
        if r[3] == i and r[6] != r[7]:
            sides[0].setdefault(len(r[9]), []).append(r)
        if r[4] == j:
            sides[1].setdefault(len(r[9]), []).append(r)
    code = {c: k for k, c in enumerate(sorted({r[6] for r in rows}))}
    out = []
    for (p, x), (q, y) in itertools.product(sides[0].items(), sides[1].items()):
        if max(p, q) > 2 * min(p, q):  # sizes within the bound have bitmaps of one length, or one is twice as long
            continue
        words = min(p, q)
        right = np.stack([_folded(r[9], words) for r in y]).view(np.uint64)
        m, d, largest = np.array([r[8] for r in y]), np.array([code[r[6]] for r in y]), np.array([r[6] == r[7] for r in y])
        step = max(1, (1 << 21) // (words * len(y)))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            left = np.stack([_folded(r[9], words) for r in part]).view(np.uint64)
            n, c = np.array([r[8] for r in part])[:, None], np.array([code[r[6]] for r in part])[:, None]
            apart = np.bitwise_count(left[:, None, :] ^ right[None, :, :]).sum(2, dtype=np.int64)
            able = (c != d) & (np.minimum(n, m) * 100 >= PERCENT * np.maximum(n, m)) & (apart * (100 + PERCENT) <= (n + m) * (100 - PERCENT))
            out += [(part[k][5], y[v][5]) for k, v in zip(*np.nonzero(able)) if largest[v] or part[k][5] > y[v][5]]
    return out


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by region and block pair, of which one is held at a time."""
    at, rows = None, []
    for pdf in batches:
        out = []
        for row in zip(*(pdf[c] for c in ("region", "i", "j", "x", "y", "id", "c", "main", "n", "bits"))):
            if row[:3] != at:
                out += _pairs_of(rows)
                at, rows = row[:3], []
            rows.append(row)
        yield pd.DataFrame(out, columns=["a", "b"])
    yield pd.DataFrame(_pairs_of(rows), columns=["a", "b"])


def _rest(labelled: DataFrame, regions: DataFrame) -> DataFrame:
    """Candidates a, b: each class outside its region's largest one against all of the region, dealt in blocks of about BLOCK rows on either side."""
    rows = _members(labelled, 1, "c", "n", "bits").join(regions, "region")
    h, blocks = F.xxhash64("id"), lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    rows = rows.withColumns({"x": F.when(F.col("c") != F.col("main"), F.pmod(h, blocks("others")).cast("int")), "y": F.pmod(h, blocks("size")).cast("int")})
    pairs = lambda n, pair: F.transform(F.sequence(F.lit(0), blocks(n) - 1), lambda k: F.struct(*(v.alias(c) for c, v in zip("ij", pair(k)))))
    right, left = pairs("others", lambda i: (i, F.col("y"))), pairs("size", lambda j: (F.col("x"), j))
    rows = rows.withColumn("p", F.explode(F.when(F.col("x").isNull(), right).otherwise(F.array_union(right, left))))
    rows = rows.select("region", "p.i", "p.j", "x", "y", "id", "c", "main", "n", "bits")
    parts = max(1, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j").mapInPandas(released(_met), "a binary, b binary")


def _confirm(pairs: DataFrame, texts: DataFrame, ws: Workspace) -> DataFrame:
    """Of pairs(a, b) those whose full sets are similar enough."""
    pairs = ws.save(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return ws.save(both.select("a", "b", "ta", "tb").mapInArrow(released(_confirmed), "a binary, b binary"), "links")


def near_duplicate_groups(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row for each row of docs, other columns unread.

    Documents are linked when 100 * intersection >= 75 * union of their sets of lower-cased 5-word shingles. component_id is the
    least doc_id reachable; kept is doc_id = component_id. Empty or null texts have an empty set and are their own component.
    A null doc_id takes no part: it has a null component_id and is kept. Rows that repeat a doc_id are one document: each of its texts
    takes part, and all of them are in one component. Ties fall to the least doc_id. No rows give no rows."""
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "near")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    signed = ws.save(rows.mapInArrow(released(_signed), _SIGNED), "signed")
    known = signed.where("doc_id is not null and n > 0")
    # Equal sets are one class, known by its set's 128-bit hash.
    classes = known.groupBy("id").agg(F.min(F.struct("doc_id", "tk")).alias("of"), *[F.first(c).alias(c) for c in ("n", "sig", "bits")])

    # Only members of a region with another class can have a link; their texts, and no others, are read again.
    members = _members(classes, 1)
    crowded = members.groupBy("region").agg(F.count("*").alias("k")).where("k > 1").select("region")
    met = members.join(crowded, "region").select("id").distinct()
    classes = ws.save(classes.join(met, "id").select("id", "of.doc_id", "of.tk", "n", "sig", "bits"), "classes")
    texts = ws.save(rows.join(classes.select("id", "doc_id", "tk"), ["doc_id", "tk"]).groupBy("id").agg(F.first("text").alias("text")), "texts")

    links = ws.save(_texts_of_one_document(known), "same")
    labelled = classes.withColumn("c", F.col("id"))
    for at, (step, reach) in enumerate(ROUNDS):
        pairs = _near(labelled, step, reach, _mixed(labelled, ws) if at else None)
        links = links.unionAll(_confirm(pairs, texts, ws))
        component = connected_components(links, ws)
        labelled = ws.save(classes.join(component.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("c"), "n", "sig", "bits"), "labelled")
    component = connected_components(links.unionAll(_confirm(_rest(labelled, _mixed(labelled, ws)), texts, ws)), ws)

    least = known.groupBy("id").agg(F.min("doc_id").alias("first")).join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    final = least.join(least.groupBy("c").agg(F.min("first").alias("component_id")), "c").select("id", "component_id")
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"), "id")
        .join(final, "id", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _texts_of_one_document(known: DataFrame) -> DataFrame:
    """Links a, b between the classes of rows that repeat a doc_id."""
    first = known.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("doc_id", "a")
    return known.select("doc_id", F.col("id").alias("b")).join(first, "doc_id").where("a <> b").select("a", "b").distinct()


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that are kept: one document of each group, and all rows without a doc_id. Rows that repeat a kept doc_id stay as they are."""
    gone = near_duplicate_groups(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
