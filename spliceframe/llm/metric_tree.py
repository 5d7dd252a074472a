"""Exact top-k search by integer inner product over an M-tree in pages.

Vectors become whole numbers, floor(SCALE * x). The tree's metric is Euclidean: a node has a routing point p, a covering radius r (no vector below it is farther from p)
and its distance to its parent's routing point. For a query q and any x below a node q * x <= q * p + |q| * r, so nodes are opened in order of that bound and a search ends
when the next one can't reach the k-th best score. Before q * p or q * x is computed at all, the triangle inequality gives a weaker bound from the parent's product
and the stored parent distance; entries that fail it cost no product.

The upper levels are built by Spark: groups of more than SUBTREE_ROWS vectors are split by routing points fitted on a bounded sample of each group, until none is left. Each
remaining group is a subtree, bulk-loaded in one task and kept as pages of at most PAGE entries. Queries go down the upper levels by joins on the node,
first to one subtree each, whose k-th best score is the bound that they then carry to all others that may reach it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceframe.llm.common import Workspace
from spliceframe.llm.vector_search import fit_centroids

K, SCALE, PAGE, SUBTREE_ROWS, FANOUT, SAMPLE_ROWS, CHUNK_ROWS, QUERY_ROWS, LEVELS = 5, 256, 128, 8192, 64, 1000, 4096, 2048, 8
#: Bounds are computed in floating point; so much, relative to the lengths multiplied, is added to be safe.
_SLACK = 1e-9
_LONG = 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (whole numbers as doubles) of vectors that take part: not null, all components finite, also after multiplying. A null vec_id takes no part; of rows that repeat one the least vector counts."""
    e = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * float(SCALE)).alias("e"))
    e = e.where("vec_id is not null and e is not null").where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    # floor() of a double is a long; beyond 2**53 doubles are whole already.
    v = F.transform("e", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return e.groupBy("vec_id").agg(F.min(v).alias("v"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distance of each row of x to the same row of p, or to p if it is one point."""
    with np.errstate(over="ignore"):
        return np.sqrt(((x - p) ** 2).sum(1))


def _nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.concatenate([np.argmin((points**2).sum(1)[None, :] - 2 * part @ points.T, axis=1) for part in np.array_split(x, len(x) // 1024 + 1)])


def _routing(x: np.ndarray, k: int) -> np.ndarray:
    """At most k routing points for the rows of x."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        points = fit_centroids(x, min(k, len(x)))
    return points if np.isfinite(points).all() else x[:k]


def _split_points(fanout: int):
    """A group's sample to the routing points of its children."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "vec_id"])
        points = _routing(_stack(pdf["v"]), fanout)
        g = int(pdf["g"].iloc[0])
        own = pdf["p"].iloc[0]
        gap = _distances(points, np.asarray(own, np.float64)) if own is not None else np.zeros(len(points))
        return pd.DataFrame({"parent": g, "g": g * FANOUT + 1 + np.arange(len(points)), "p": list(points), "gap": gap})

    return run


def _assigned(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Rows of a chunk of one group to the nearest of its children's routing points."""
    if not len(left) or not len(right):
        return pd.DataFrame({"g": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "v": pd.Series(dtype="object"), "d": pd.Series(dtype="float64")})
    right = right.sort_values("child")
    x, points = _stack(left["v"]), _stack(right["p"])
    near = _nearest(x, points)
    return pd.DataFrame({"g": right["child"].to_numpy()[near], "vec_id": left["vec_id"], "v": left["v"], "d": _distances(x, points[near])})


_PAGES = "g long, part int, page int, leaf boolean, ids array<long>, points array<double>, radius array<double>, gap array<double>"


def load_pages(ids: np.ndarray, x: np.ndarray) -> list[tuple]:
    """Bulk-loads a subtree: (page, leaf, ids or child pages, points, covering radii, distances to the page's routing point). Page 0 is its top, whose routing point is its mean."""
    pages: list[tuple] = []

    def load(rows: np.ndarray, p: np.ndarray) -> int:
        number = len(pages)
        pages.append(())
        cells = [rows]
        if len(rows) > PAGE:
            points = _routing(x[rows], min(PAGE, -(-2 * len(rows) // PAGE)))
            near = _nearest(x[rows], points)
            cells = [rows[near == i] for i in range(len(points)) if (near == i).any()]
            if len(cells) == 1:  # vectors too alike for routing points to part them
                cells = np.array_split(rows, -(-len(rows) // PAGE))
        if len(cells) == 1:
            pages[number] = (number, True, ids[rows], x[rows], np.zeros(len(rows)), _distances(x[rows], p))
        else:
            middles = np.stack([x[c].mean(0) for c in cells])
            radii = np.array([_distances(x[c], m).max() for c, m in zip(cells, middles)])
            gaps = _distances(middles, p)
            pages[number] = (number, False, np.array([load(c, m) for c, m in zip(cells, middles)]), middles, radii, gaps)
        return number

    load(np.arange(len(x)), x.mean(0))
    return pages


def _loaded(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id")
    pages = load_pages(pdf["vec_id"].to_numpy(), _stack(pdf["v"]))
    g, part = int(pdf["g"].iloc[0]), int(pdf["part"].iloc[0])
    return pd.DataFrame([(g, part, n, leaf, own, points.ravel(), radius, gap) for n, leaf, own, points, radius, gap in pages], columns=["g", "part", "page", "leaf", "ids", "points", "radius", "gap"])


def _bound(product, length: float, reach, size) -> np.ndarray:
    """No vector within reach of a point has a larger product with the query than this; size: the point's length."""
    with np.errstate(over="ignore", invalid="ignore"):
        top = product + length * reach + _SLACK * length * (size + reach)
    return np.where(np.isnan(top), np.inf, top)


class Subtree:
    """Pages of one subtree, and best-first search in them. products counts the vectors and routing points that a query was multiplied with."""

    def __init__(self, pages: list[tuple]):
        self.products = 0
        self.pages = {}
        with np.errstate(over="ignore"):
            for n, leaf, ids, points, radius, gap in pages:
                self.pages[n] = (leaf, ids, points, radius, gap, np.sqrt((points**2).sum(1)))
            self.longest = max(p[5].max() for p in self.pages.values())

    def search(self, q: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """(score, id) of the k best that reach least, best first; ties to the smaller id. The vector `own` is left out."""
        with np.errstate(over="ignore"):
            length = float(np.sqrt((q * q).sum()))
        exact = length * self.longest < 2.0**52  # then all sums stay whole in doubles
        whole = None if exact else np.array([int(v) for v in q], object)
        best: list[tuple[int, int]] = []  # a heap whose first entry is the worst of the best: (score, -id)
        heap, made = [(-np.inf, 0, np.inf, None)], 0
        while heap:
            top, page, _, product = heapq.heappop(heap)
            if len(best) == k:
                least = max(least, float(best[0][0]) if exact else best[0][0])
            if -top < least:
                break
            leaf, ids, points, radius, gap, size = self.pages[page]
            near = np.arange(len(ids))
            if product is not None:  # the stored distances to the parent rule entries out without a product
                near = np.flatnonzero(_bound(product, length, gap + radius, size) >= least)
            if not len(near):
                continue
            self.products += len(near)
            if not leaf:
                with np.errstate(over="ignore", invalid="ignore"):
                    products = points[near] @ q
                bounds = _bound(products, length, radius[near], size[near])
                for i, b, s in zip(near, bounds, products):
                    if b >= least:
                        made += 1
                        heapq.heappush(heap, (-b, int(ids[i]), made, float(s) if np.isfinite(s) else None))
                continue
            if exact:
                scores = points[near] @ q
                near, scores = near[scores >= least], scores[scores >= least]
                found = [(int(s), -int(ids[i])) for i, s in zip(near, scores)]
            else:
                scores = [int(np.dot(np.array([int(v) for v in points[i]], object), whole)) for i in near]
                found = [(max(-_LONG - 1, min(_LONG, s)), -int(ids[i])) for i, s in zip(near, scores)]
            for entry in found:
                if entry[0] >= least and -entry[1] != own:
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


_FOUND = "query_id long, vec_id long, score long"


def _searched(k: int):
    """One block of the queries that visit a subtree: the best of each in it."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            shape = (-1, len(left["q"].iloc[0]))
            tree = Subtree([(int(r.page), bool(r.leaf), np.asarray(r.ids), np.asarray(r.points, np.float64).reshape(shape), np.asarray(r.radius), np.asarray(r.gap)) for r in right.itertuples()])
            for query, q, least in zip(left["query_id"], left["q"], left["least"]):
                rows += [(query, i, s) for s, i in tree.search(np.asarray(q, np.float64), query, k, least)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


_AT = "query_id long, q array<double>, least double, g long, product double, leaf boolean, parts int"


def _descended(home: bool):
    """One block of the queries that stand at a node, to those of its children that may hold a score of at least `least`; with home to the one of the largest bound only."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("child")
            points, radius, gap = _stack(right["p"]), right["radius"].to_numpy(), right["gap"].to_numpy()
            child, leaf, parts = (right[c].to_numpy() for c in ("child", "leaf", "parts"))
            with np.errstate(over="ignore", invalid="ignore"):
                size = np.sqrt((points**2).sum(1))
                for query, q, least, product in zip(left["query_id"], left["q"], left["least"], left["product"]):
                    v = np.asarray(q, np.float64)
                    length = float(np.sqrt((v * v).sum()))
                    near = np.arange(len(child)) if product is None or np.isnan(product) else np.flatnonzero(_bound(product, length, gap + radius, size) >= least)
                    products = points[near] @ v
                    bounds = _bound(products, length, radius[near], size[near])
                    keep = np.flatnonzero(bounds >= least)
                    if home and len(keep):
                        keep = keep[[np.argmax(np.nan_to_num(products[keep], nan=-np.inf))]]
                    out += [(query, q, least, int(child[near[i]]), float(products[i]) if np.isfinite(products[i]) else None, bool(leaf[near[i]]), int(parts[near[i]])) for i in keep]
        return pd.DataFrame(out, columns=["query_id", "q", "least", "g", "product", "leaf", "parts"])

    return run


class Tree:
    """An M-tree over vectors(vec_id, v): upper nodes (parent, child, p, radius, gap, leaf, parts) by level, and the pages of the subtrees below."""

    def __init__(self, vectors: DataFrame, n: int, ws: Workspace):
        self.ws, self.levels, self.root_leaf = ws, [], n <= SUBTREE_ROWS
        rows = vectors.select(F.lit(0).cast("long").alias("g"), "vec_id", "v")
        done, big = [], rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("g"), F.lit(n).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("p"))
        if self.root_leaf:
            done.append(rows.withColumn("parts", F.lit(1)))
        while not self.root_leaf:
            level = len(self.levels)
            drawn = rows.join(big.select("g", "p"), "g").withColumn("h", F.xxhash64("vec_id", F.lit(level)))
            drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h", "vec_id"))).where(F.col("r") <= SAMPLE_ROWS)
            points = ws.save(drawn.select("g", "p", "h", "vec_id", "v").groupBy("g").applyInPandas(_split_points(FANOUT), "parent long, g long, p array<double>, gap double"), "points")
            chunks = big.select("g", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("chunks"))
            dealt = rows.join(chunks, "g").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).drop("chunks")
            copies = points.select(F.col("parent").alias("of"), F.col("g").alias("child"), "p").join(chunks.select(F.col("g").alias("of"), "chunks"), "of").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
            moved = ws.save(dealt.groupBy("g", "chunk").cogroup(copies.groupBy("of", "piece")).applyInPandas(_assigned, "g long, vec_id long, v array<double>, d double"), "moved")
            # Slack on the radius stands for the rounding of distances.
            sizes = moved.groupBy("g").agg(F.count("*").alias("n"), (F.max("d") * (1 + _SLACK)).alias("radius"))
            last = level + 1 == LEVELS
            parts = F.ceil(F.col("n") / SUBTREE_ROWS).cast("int") if last else F.lit(1)
            leaf = F.lit(True) if last else F.col("n") <= SUBTREE_ROWS
            nodes = ws.save(points.join(sizes, "g").select("parent", F.col("g").alias("child"), "p", "radius", "gap", "n", leaf.alias("leaf"), parts.alias("parts")), "nodes")
            self.levels.append(nodes)
            ends = nodes.where("leaf").select(F.col("child").alias("g"), "parts")
            done.append(moved.select("g", "vec_id", "v").join(ends, "g"))
            big = nodes.where("not leaf").select(F.col("child").alias("g"), "n", "p")
            if big.isEmpty():
                break
            rows = moved.select("g", "vec_id", "v").join(big.select("g"), "g", "left_semi")
        every = done[0]
        for more in done[1:]:
            every = every.unionByName(more)
        every = every.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
        self.pages = ws.save(every.groupBy("g", "part").applyInPandas(_loaded, _PAGES), "pages")

    def _met(self, left: DataFrame, right: DataFrame, keys: list[str], blocks: int | None = None):
        """Both sides grouped by the keys of left and blocks of QUERY_ROWS of its queries; right has its keys under the same names."""
        if blocks is not None:
            many = left.select(*keys).distinct().withColumn("blocks", F.lit(blocks))
            left = left.withColumn("blocks", F.lit(blocks))
        else:
            many = left.groupBy(*keys).count().select(*keys, F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("blocks"))
            left = left.join(many, keys)
        left = left.withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
        names = [f"_{c}" for c in keys]
        right = right.join(many, keys).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumnsRenamed(dict(zip(keys, names)))
        return left.groupBy(*keys, "block").cogroup(right.groupBy(*names, "_block"))

    def visits(self, queries: DataFrame, n: int, home: bool) -> DataFrame:
        """queries(query_id, q, least), n of them -> query_id, q, least, g, part: the subtrees that each has to visit, or with home the first one to visit."""
        if self.root_leaf:
            return queries.select("query_id", "q", "least", F.lit(0).cast("long").alias("g"), F.lit(0).alias("part"))
        at = queries.select("query_id", "q", "least", F.lit(0).cast("long").alias("g"), F.lit(None).cast("double").alias("product"))
        ends = []
        for level, nodes in enumerate(self.levels):
            children = nodes.select(F.col("parent").alias("g"), "child", "p", "radius", "gap", "leaf", "parts")
            moved = self.ws.save(self._met(at, children, ["g"], None if level else max(1, -(-n // QUERY_ROWS))).applyInPandas(_descended(home), _AT), "at")
            ends.append(moved.where("leaf"))
            at = moved.where("not leaf").select("query_id", "q", "least", "g", "product")
        every = ends[0]
        for more in ends[1:]:
            every = every.unionByName(more)
        part = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int") if home else F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        return every.select("query_id", "q", "least", "g", part.alias("part"))

    def search(self, visits: DataFrame, k: int) -> DataFrame:
        """The best of each visit: query_id, vec_id, score."""
        return self._met(visits, self.pages, ["g", "part"]).applyInPandas(_searched(k), _FOUND)


def exact_top_k(vectors: DataFrame, is_query=None, k: int = K, ws: Workspace | None = None) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> query_id, rank, vec_id, score: for each query its k highest scores, itself left out; ties to the smaller vec_id.

    The score is the inner product of the whole-number vectors, exact however large; one that 64 bits don't hold counts as the nearest that they do. is_query: a condition on vec_id (by
    default divisible by 50). Components that a vector lacks to the longest one count as 0. Which vectors take part: usable(). Of vectors that are
    equal only the k + 1 least ids can be among the best, so no more enter the tree. Fewer candidates than k give fewer rows; no queries, no rows."""
    spark = vectors.sparkSession
    ws = ws or Workspace(spark, "mtree")
    rows = ws.save(usable(vectors), "usable")
    n, short_, long_ = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n or not long_:
        rows = rows.withColumn("v", F.array(F.lit(0.0)))
    elif short_ < long_:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(long_) - F.size("v"))))
    copy = F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id"))
    kept = ws.save(rows.withColumn("r", copy).where(F.col("r") <= k + 1).drop("r"), "kept")
    tree = Tree(kept, kept.count(), ws)

    queries = rows.where((F.col("vec_id") % 50 == 0) if is_query is None else is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    queries = ws.save(queries, "queries")
    many = queries.count()
    first = ws.save(tree.visits(queries.withColumn("least", F.lit(float("-inf"))), many, True), "homes")
    found = ws.save(tree.search(first, k), "first")
    bound = found.groupBy("query_id").agg(F.min("score").cast("double").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "low")
    # A score of 64 bits may lose its last bits as a double; the bound gives way by that much.
    low = F.col("low") - F.abs("low") * 1e-15
    queries = ws.save(queries.join(bound, "query_id", "left").select("query_id", "q", F.coalesce(low, F.lit(float("-inf"))).alias("least")), "bounded")
    others = tree.visits(queries, many, False).join(first.select("query_id", "g", "part"), ["query_id", "g", "part"], "left_anti")
    found = found.unionByName(tree.search(ws.save(others, "visits"), k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
