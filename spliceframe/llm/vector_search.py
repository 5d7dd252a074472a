"""Approximate nearest neighbours by inner product, over balanced posting lists.

Vectors are dealt into shells by the power of two nearest to their norm, so a far longer vector changes nothing for the others. Within a shell, M its largest norm,
largest inner product becomes least Euclidean distance between unit vectors by one more coordinate, sqrt(1 - |x / M| ** 2). Centroids, one for LIST_ROWS
vectors up to LISTS, are fitted in two levels on a bounded sample; a graph of each centroid's nearest ones is walked in memory, best first with a beam, to find
the centroids near a vector. A vector goes to the lists of the centroids at most REPLICA_RATIO times as far as its nearest, REPLICAS at most, so those at a border
stand in several lists; a list whose centroid is nearer to one already chosen than to the vector is left out, as a query that would read it reads that one. Lists are
dealt into parts of about PART_ROWS, so that no list grows with a popular region. A query reads, in each shell, the lists of
all centroids within PROBE_RATIO of its nearest, whatever their number: few where vectors cluster, many where they lie alike in all directions. The
FIRST most promising of them are read first; their k-th best score is a bound. Of the other lists those are read that may hold more: a list's products are
at most that of its centroid plus its radius, and that of its shell's largest norm. A ratio of distances says little where all vectors point one way, so a last step
holds every list that a query hasn't read against the k-th best score found, by the same bounds over the vectors whose nearest centroid is the list's: what may
still hold a better one is read, so the result is that of all products. Vectors that are equal bit
by bit stand for one another: only the least vec_ids of such a group can be among the nearest, and a vector's rank among its equals decides
that without gathering the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceframe.llm.common import Workspace

K, LIST_ROWS, LISTS, SAMPLE_ROWS, PART_ROWS, REPLICAS, REPLICA_RATIO, PROBE_RATIO, FIRST, DEGREE, BEAM, QUERY_ROWS = 20, 256, 4096, 65536, 2048, 4, 1.1, 1.18, 8, 20, 24, 8192
_STEP = 65536  # pairs whose distances are computed at once
_INF = float("inf")


class Graph:
    """Centroids and, for each, its DEGREE nearest and a few far ones; a walk opens the best places of its beam until nothing nearer turns up. Distances are computed for places that a walk meets, once."""

    def __init__(self, centroids: np.ndarray):
        self.c, self.sq = centroids, (centroids**2).sum(1)
        n = len(centroids)
        most = min(n, DEGREE + 1) - 1
        near = [np.argpartition(self.sq[None, :] - 2 * part @ centroids.T, most, axis=1)[:, : most + 1] for part in np.array_split(centroids, max(1, n // 512))]
        far = np.random.default_rng(3).integers(0, n, (n, 4))  # a few long edges keep the graph in one piece
        links = np.sort(np.concatenate([np.concatenate(near), far], axis=1), axis=1)
        links[:, 1:] = np.where(links[:, 1:] == links[:, :-1], np.arange(n)[:, None], links[:, 1:])  # a repeated edge leads to its own start
        self.links = links
        self.entry = np.unique(np.linspace(0, n - 1, min(n, BEAM)).astype(int))

    def _squares(self, x: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        parts = [((x[row[i : i + _STEP]] - self.c[node[i : i + _STEP]]) ** 2).sum(1) for i in range(0, len(row), _STEP)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _walk(self, x: np.ndarray, width: int) -> tuple[list, np.ndarray, np.ndarray]:
        """Row, centroid and squared distance of all places met, and which were seen and opened."""
        m, n = len(x), len(self.c)
        width, rows, first = min(n, max(width, BEAM)), np.arange(m), len(self.entry)
        ids, dist, done = np.zeros((m, width), int), np.full((m, width), np.inf), np.ones((m, width), bool)
        seen, opened = np.zeros((m, n), bool), np.zeros((m, n), bool)
        ids[:, :first], done[:, :first], seen[:, self.entry] = self.entry, False, True
        met = [(np.repeat(rows, first), np.tile(self.entry, m))]
        met[0] += (self._squares(x, *met[0]),)
        dist[:, :first] = met[0][2].reshape(m, first)
        while True:
            left = np.where(done, np.inf, dist)
            pick = left.argmin(1)
            live = np.flatnonzero(np.isfinite(left[rows, pick]))
            if not len(live):
                return met, seen, opened
            done[live, pick[live]] = True
            node = ids[live, pick[live]]
            opened[live, node] = True
            links = self.links[node]
            r, col = np.nonzero(~seen[live[:, None], links])
            seen[live[:, None], links] = True
            new = np.full(links.shape, np.inf)
            new[r, col] = self._squares(x, live[r], links[r, col])
            met.append((live[r], links[r, col], new[r, col]))
            both = [np.concatenate(p, axis=1) for p in ((ids[live], links), (dist[live], new), (done[live], np.isinf(new)))]
            best = np.argpartition(both[1], width - 1, axis=1)[:, :width]
            ids[live], dist[live], done[live] = (np.take_along_axis(p, best, 1) for p in both)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of about the width nearest centroids for each row of x, nearest first."""
        row, node, sq = (np.concatenate(p) for p in zip(*self._walk(x, width)[0]))
        width = min(len(self.c), width)
        order = np.lexsort((node, sq, row))
        at = np.searchsorted(row[order], np.arange(len(x)))[:, None] + np.arange(width)
        return node[order][at], np.sqrt(sq[order][at])

    def within(self, x: np.ndarray, ratio: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, centroid, place by distance (from 0) and distance of the centroids at most ratio times as far as a row's nearest; most: so many at most.
        Without most the walk goes on through all such places."""
        n = len(self.c)
        met, seen, opened = self._walk(x, BEAM)
        row, node, sq = (np.concatenate(p) for p in zip(*met))
        best = np.full(len(x), np.inf)
        np.minimum.at(best, row, sq)
        near = lambda r, d: d <= ratio * ratio * best[r] + 1e-24
        if most is None:
            met = [(row, node, sq)]
            go = near(row, sq) & ~opened[row, node]
            open_ = [(row[go], node[go])]
            while open_:
                r, v = open_.pop()
                if len(r) > _STEP // 4:
                    open_.append((r[_STEP // 4 :], v[_STEP // 4 :]))
                    r, v = r[: _STEP // 4], v[: _STEP // 4]
                key = (r[:, None] * n + self.links[v]).ravel()
                r, v = np.divmod(np.unique(key[~seen.ravel()[key]]), n)
                seen[r, v] = True
                d = self._squares(x, r, v)
                np.minimum.at(best, r, d)
                met.append((r, v, d))
                go = near(r, d)
                if go.any():
                    open_.append((r[go], v[go]))
            row, node, sq = (np.concatenate(p) for p in zip(*met))
        ok = near(row, sq)
        row, node, sq = row[ok], node[ok], sq[ok]
        order = np.lexsort((node, sq, row))
        row, node, dist = row[order], node[order], np.sqrt(sq[order])
        place = np.arange(len(row)) - np.searchsorted(row, row)
        ok = place < (n if most is None else most)
        return row[ok], node[ok], place[ok], dist[ok]

    def apart(self, row: np.ndarray, node: np.ndarray, place: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Which of a row's places are farther from each place kept before than from the row."""
        at, far = np.zeros((row.max(initial=-1) + 1, REPLICAS), int), np.zeros((row.max(initial=-1) + 1, REPLICAS))
        ok = np.zeros(at.shape, bool)
        at[row, place], far[row, place], ok[row, place] = node, dist, True
        for p in range(1, REPLICAS):
            for i in range(p):
                gap = np.sqrt(((self.c[at[:, p]] - self.c[at[:, i]]) ** 2).sum(1))
                ok[:, p] &= ~ok[:, i] | (gap > far[:, p])
        return ok[row, place]


def fit_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k means with balance: in each round a centroid's distance counts more the fuller its cluster is; empty ones restart at the farthest rows."""
    rng = np.random.default_rng(5)
    c = x[rng.permutation(len(x))[:k]].copy()
    k = len(c)
    load, share = np.ones(k), len(x) / k
    for _ in range(12):
        near = _closest(x, c, 0.05 * np.abs((c**2).mean()) * (load / share - 1))
        load = np.bincount(near, minlength=k).astype(float)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = load > 0
        c[full] = sums[full] / load[full, None]
        if (~full).any():
            far = np.argsort(-((x - c[near]) ** 2).sum(1), kind="stable")[: (~full).sum()]
            c[~full] = x[far]
    return c


def _closest(x: np.ndarray, c: np.ndarray, more=0.0) -> np.ndarray:
    return np.concatenate([np.argmin(((c**2).sum(1) + more)[None, :] - 2 * p @ c.T, axis=1) for p in np.array_split(x, max(1, len(x) // 2048))])


def fit_lists(x: np.ndarray, k: int) -> np.ndarray:
    """About k centroids; of many, first some whose clusters then get theirs in proportion to their rows."""
    if k <= 256:
        return fit_centroids(x, k)
    top = fit_centroids(x, int(k**0.5))
    near = _closest(x, top)
    return np.concatenate([fit_centroids(x[near == i], max(1, round(k * (near == i).mean()))) for i in np.unique(near)])


def _norms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and norms (may be infinite). The largest component is divided out first, so that squares neither overflow nor vanish."""
    top = np.abs(x).max(1)
    x = x / top[:, None]
    norm = np.sqrt((x * x).sum(1))
    with np.errstate(over="ignore"):
        return x / norm[:, None], norm * top


def _lifted(column: pd.Series, norm: float) -> np.ndarray:
    """Vectors of a shell with the coordinate that makes them unit vectors and products distances."""
    unit, own = _norms(np.stack([np.asarray(v, np.float64) for v in column]))
    x = unit * (np.minimum(own / norm, 1.0) if np.isfinite(norm) else np.ones(len(own)))[:, None]
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]], axis=1)


def _postings(shells: dict[int, tuple[float, int, Graph]]):
    """One row for each list that a vector belongs to, with its distance to the list's centroid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shell, rows in pdf.groupby("shell"):
                norm, offset, graph = shells[shell]
                for at in range(0, len(rows), 64):
                    part = rows.iloc[at : at + 64]
                    row, node, place, dist = graph.within(_lifted(part["embedding"], norm), REPLICA_RATIO, REPLICAS)
                    ok = graph.apart(row, node, place, dist)
                    yield part.iloc[row[ok]][["vec_id", "embedding"]].assign(list=node[ok] + offset, dist=dist[ok], home=place[ok] == 0)

    return run


def _reads(shells: dict[int, tuple[float, int, Graph]]):
    """One row for each list that a query reads: place by promise (from 0), the largest product its shell may have, and the cosine to its centroid's direction."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                unit, own = _norms(np.stack([np.asarray(v, np.float64) for v in part["embedding"]]))
                q = np.concatenate([unit, np.zeros((len(unit), 1))], axis=1)
                found = []
                for norm, offset, graph in shells.values():
                    row, node, _, dist = graph.within(q, PROBE_RATIO)
                    found.append((row, node + offset, np.full(len(row), norm), (1 + graph.sq[node] - dist * dist) / 2))
                row, lists, norm, cosine = (np.concatenate(p) for p in zip(*found))
                with np.errstate(over="ignore", invalid="ignore"):
                    order = np.lexsort((lists, -np.nan_to_num(norm * cosine), row))
                    row, lists, norm, cosine = row[order], lists[order], norm[order], cosine[order]
                    top = norm * own[row]
                yield part.iloc[row].assign(list=lists, place=np.arange(len(row)) - np.searchsorted(row, row), top=top, cosine=cosine)

    return run


def _left(shells: dict[int, tuple[float, int, Graph]], reach: np.ndarray):
    """One row for each list whose home vectors may hold a product of at least a query's bound. reach: by list, the largest distance of a home vector to the centroid, below 0 without one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                unit, own = _norms(np.stack([np.asarray(v, np.float64) for v in part["embedding"]]))
                bound = part["least"].to_numpy(np.float64)[:, None]
                for norm, offset, graph in shells.values():
                    held = reach[offset : offset + len(graph.c)]
                    cosine = unit @ graph.c[:, :-1].T
                    dist = np.sqrt(np.maximum(1 + graph.sq - 2 * cosine, 0))
                    best = np.minimum(np.minimum(cosine + held, 1 - np.maximum(dist - held, 0) ** 2 / 2), 1)
                    with np.errstate(over="ignore", invalid="ignore"):
                        top = (norm * own)[:, None]
                        # With a little room for rounding; an infinite or vanishing largest product bounds nothing.
                        most = np.where((top >= 1e-290) & (top <= 1e300), top * (best + 1e-9), np.inf)
                    row, node = np.nonzero((held >= 0) & (most >= bound))
                    yield part.iloc[row].assign(list=node + offset)

    return run


_FOUND = "query_id long, vec_id long, score double"


def _nearest(k: int):
    """Of one part of a list and one block of its queries: each query's k best in the part that reach the score it has to beat."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x = np.stack(right["embedding"]).astype(np.float64)
        return pd.concat([step(left.iloc[i : i + 512], right["vec_id"].to_numpy(), x) for i in range(0, len(left), 512)])

    def step(left: pd.DataFrame, ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        own, q = left["vec_id"].to_numpy(), np.stack(left["embedding"]).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            s = q @ x.T
            s[np.isnan(s)] = -np.inf
            s[own[:, None] == ids] = -np.inf
            at = max(len(ids) - k, 0)
            cut = np.maximum(np.partition(s, at, axis=1)[:, at], left["least"].to_numpy(np.float64))
            # The product of two matrices may round equal vectors differently; what comes close is summed again row by row.
            slack = np.where(np.isfinite(cut), 1e-9 * np.abs(cut), 0)
            row, col = np.nonzero((s >= (cut - slack)[:, None]) & (own[:, None] != ids))
            score = np.concatenate([(q[r] * x[c]).sum(1) for r, c in zip(np.array_split(row, len(row) // 65536 + 1), np.array_split(col, len(col) // 65536 + 1))])
        order = np.lexsort((ids[col], -np.where(np.isnan(score), -np.inf, score), row))
        row, col, score = row[order], col[order], score[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pd.DataFrame({"query_id": own[row[best]], "vec_id": ids[col[best]], "score": score[best]})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of vectors that take part: not null, zero or of no length, all components finite. A null vec_id takes no part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(_INF))
    return v.where(F.forall("embedding", finite)).where(F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query=None, k: int = K, ws: Workspace | None = None) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> query_id, rank, vec_id, score: for each query its k nearest found by inner product, itself left out; ties to the smaller vec_id.

    is_query: a condition on vec_id (by default divisible by 20). Components that a vector lacks to the longest one count as 0. A product may be infinite;
    one that isn't a number comes last. Of rows that repeat a vec_id the least vector counts. A query that finds fewer than k
    has no bound and reads all lists, so fewer than k rows mean fewer candidates. No usable vectors give no rows."""
    spark = vectors.sparkSession
    ws = ws or Workspace(spark, "vectors")
    rows = ws.save(usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "usable")
    n, short_, long_ = rows.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if short_ < long_:
        rows = rows.withColumn("embedding", F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(long_) - F.size("embedding"))))
    # Only the k + 1 least ids of equal vectors can be among anyone's k nearest; the limit is applied before rows of a group meet.
    rank = F.row_number().over(Window.partitionBy("equal", "embedding").orderBy("vec_id"))
    largest = F.array_max(F.transform("embedding", F.abs))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / F.col("largest")) * (x / F.col("largest"))))
    kept = rows.withColumn("equal", F.xxhash64("embedding")).withColumn("r", rank).where(F.col("r") <= k + 1).withColumn("largest", largest).withColumn("length", length)
    shell = F.floor(F.log2("largest") + F.log2("length") + 0.5).cast("int")  # unit vectors, whose norms are rounded, stay together
    kept = ws.save(kept.select("vec_id", "embedding", "r", shell.alias("shell"), (F.col("largest") * F.col("length")).alias("norm")), "candidates")
    key = F.struct(F.xxhash64("vec_id"), "vec_id")
    stats = kept.groupBy("shell").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.min_by("embedding", key).alias("one")).orderBy(F.desc("shell")).collect()  # as many as powers of two, 2,100 at most
    n = sum(s["n"] for s in stats)
    wanted = max(1, min(LISTS, n // LIST_ROWS))
    picked = kept.where("r = 1").orderBy(key).limit(min(SAMPLE_ROWS, 32 * wanted)).select("shell", "embedding").toPandas()
    shells, lists = {}, 0
    for s in stats:
        some = picked.loc[picked["shell"] == s["shell"], "embedding"]
        graph = Graph(fit_lists(_lifted(some if len(some) else pd.Series([s["one"]]), s["norm"]), max(1, round(wanted * s["n"] / n))))
        shells[s["shell"]] = (s["norm"], lists, graph)
        lists += len(graph.c)

    postings = ws.save(kept.select("vec_id", "embedding", "shell").mapInPandas(_postings(shells), "vec_id long, embedding array<double>, list int, dist double, home boolean"), "postings")
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"), F.max("dist").alias("radius"), F.max(F.when(F.col("home"), F.col("dist"))).alias("reach"))  # LISTS rows, and one for each rare shell, at most
    sizes = ws.save(sizes, "lists")
    reach = np.full(lists, -1.0)
    for r in sizes.where("reach is not null").select("list", "reach").collect():
        reach[r["list"]] = r["reach"]
    radius, sizes = sizes.select("list", "radius"), sizes.select("list", "parts")
    postings = postings.drop("dist")
    queries = rows.where((F.col("vec_id") % 20 == 0) if is_query is None else is_query).select("vec_id", "embedding")

    def search(reads: DataFrame, postings: DataFrame = postings) -> DataFrame:
        """reads(vec_id, embedding, list, least): scores of at least least within all parts of the lists, in blocks of queries."""
        blocks = reads.groupBy("list").count().select("list", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("blocks"))
        dealt = F.broadcast(blocks.join(F.broadcast(sizes), "list"))  # so a read or a posting is looked up once for both
        share = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = reads.join(dealt, "list").withColumn("block", share("blocks")).withColumn("part", every("parts")).drop("blocks", "parts")
        p = postings.join(dealt, "list").withColumn("part", share("parts")).withColumn("block", every("blocks")).drop("blocks", "parts")
        keys = ["list", "part", "block"]
        return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(_nearest(k), _FOUND)

    order = F.desc(F.when(F.isnan("score"), F.lit(-_INF)).otherwise(F.col("score")))
    best = Window.partitionBy("query_id").orderBy(order, "vec_id")
    top = lambda found: found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    reads = ws.save(queries.mapInPandas(_reads(shells), "vec_id long, embedding array<double>, list int, place int, top double, cosine double"), "reads")
    none = F.lit(-_INF)
    first = ws.save(top(search(reads.where(F.col("place") < FIRST).select("vec_id", "embedding", "list", none.alias("least")))), "first")
    bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.when(F.isnan("score"), none).otherwise(F.col("score")).alias("bound"))
    # With a little room for rounding; an infinite or vanishing largest product bounds nothing.
    most = F.when(F.col("top").between(1e-290, 1e300), F.col("top") * (F.least(F.lit(1.0), F.col("cosine") + F.col("radius")) + 1e-9)).otherwise(F.lit(_INF))
    others = reads.where(F.col("place") >= FIRST).join(bound, "vec_id", "left").join(F.broadcast(radius), "list").where(most >= F.coalesce("bound", none))
    others = ws.save(others.select("vec_id", "embedding", "list", F.coalesce("bound", none).alias("least")), "others")
    near = ws.save(top(first.drop("rank").unionByName(search(others))), "near")
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.when(F.isnan("score"), none).otherwise(F.col("score")).alias("least"))
    bounded = queries.join(kth, "vec_id", "left").withColumn("least", F.coalesce("least", none))
    done = reads.where(F.col("place") < FIRST).select("vec_id", "list").unionByName(others.select("vec_id", "list"))
    rest = bounded.mapInPandas(_left(shells, reach), "vec_id long, embedding array<double>, least double, list int").join(done, ["vec_id", "list"], "left_anti")
    rest = ws.save(rest.select("vec_id", "embedding", "list", "least"), "rest")
    found = ws.save(top(near.drop("rank").unionByName(search(rest, postings.where("home")))), "found")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
