"""Whitening and exact top-k search against brute force."""

import math

import numpy as np
import pytest

from spliceframe.llm import metric_tree, whitening
from spliceframe.llm.common import Workspace

KIND = "vec_id long, embedding array<double>, x string, w int, n int"


def frame(spark, rows):
    """With columns whose names clash with helpers'."""
    return spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], KIND)


def whole(v, d):
    return [math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (d - len(v))


def by_hand(rows):
    """x, n, S, covariance and eigenvalues (falling) of the distinct vectors, in whole numbers up to the covariance."""
    use = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in use)
    xs = [(i, whole(v, d)) for i, v in use]
    fit = sorted({tuple(x) for _, x in xs})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = [[n * a - b for a, b in zip(x, s)] for x in fit]
    cov = np.array([[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)], object) / n**3
    values, vectors = np.linalg.eigh(cov.astype(float))
    return xs, n, s, cov.astype(float), values[::-1], vectors[:, ::-1]


def check(got, rows, parts=16):
    xs, n, s, cov, values, vectors = by_hand(rows)
    k = min(parts, len(s))
    assert len(got) == len(xs) * k
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], []).append(r)
    for i, x in xs:
        mine = sorted(by_row[i], key=lambda r: r["component"])[:k]
        assert [r["component"] for r in mine] == list(range(1, k + 1)) or len(by_row[i]) > k
        y = [n * a - b for a, b in zip(x, s)]
        assert all(int(r["deviation"]) == sum(v * v for v in y) and r["n"] == n for r in mine)
    for j in range(k):
        assert all(math.isclose(r["explained"], values[j] / np.trace(cov), rel_tol=1e-9, abs_tol=1e-15) for r in got if r["component"] == j + 1)
        if values[j] > 1e-9 * values[0]:
            mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == j + 1}
            want = {i: float(np.dot([(n * a - b) / n for a, b in zip(x, s)], vectors[:, j]) / math.sqrt(values[j])) for i, x in xs}
            sign = np.sign(sum(mine[i] * want[i] for i in mine))
            assert all(math.isclose(sign * mine[i], want[i], rel_tol=1e-6, abs_tol=1e-7) for i in mine)
    return by_row


def test_whitening_by_hand(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 20)) * np.linspace(3, 0.2, 20) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[i % 3].tolist()) for i in range(200)]  # copies weigh nothing in the fit
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 18), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0.0] * 19), (2004, []), (2005, [0.0] * 20)]
    got = whitening.whiten(frame(spark, rows)).collect()
    by_row = check(got, rows)
    assert not {2000, 2001, 2002, 2003, 2004} & set(by_row) and 2005 in by_row
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-9
    # Whitened rows of the fit list have the identity as their covariance.
    w = np.array([[r["whitened"] for r in sorted(by_row[i], key=lambda r: r["component"])] for i in [*range(300), 2005]])
    w -= w.mean(0)
    assert np.abs(w.T @ w / len(w) - np.eye(16)).max() < 1e-9


def test_whitening_without_spread(spark):
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert len(one) == 6 and all(r["n"] == 1 and int(r["deviation"]) == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)
    line = whitening.whiten(frame(spark, [(i, [i / 64, 2 * i / 64, 0.0]) for i in range(9)])).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True, 3: True} and math.isclose(line[0]["explained"], 1.0, rel_tol=1e-12)
    assert whitening.whiten(frame(spark, [])).collect() == [] == whitening.whiten(frame(spark, [(1, None), (2, [])])).collect()
    assert whitening.whiten(frame(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_short_and_large_vectors(spark):
    rows = [(1, [1.0]), (1, [1.0, 2.0]), (2, [3.0, -4.0, 5.0]), (3, [0.1, 0.2, 0.3])]
    xs, n, s, *_ = by_hand(rows)
    got = whitening.whiten(frame(spark, rows), 2).where("component = 1").collect()
    assert sorted(int(r["deviation"]) for r in got) == sorted(sum((n * a - b) ** 2 for a, b in zip(x, s)) for _, x in xs)
    # Deviations past 64 bits stay exact; entries past what 64 bits hold take no part.
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 64.0]), (3, [12345.678, -1.0]), (4, [1e300, 0.0])]
    xs, n, s, *_ = by_hand(rows[:3])
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(frame(spark, rows)).collect()}
    assert got == {i: sum((n * a - b) ** 2 for a, b in zip(x, s)) for i, x in xs} and max(got.values()) > 2**70


@pytest.mark.parametrize("n", [3, 2**40])
def test_deviations_beyond_64_bits(n):
    model = whitening.Whitening(n, (7 * n + 1, -5), (7, -1), 2**30, np.ones(2), np.eye(2), 2.0)
    x = np.array([[9, 3], [2**30, -(2**29)]])
    want = [[n * int(a) - b for a, b in zip(row, model.s)] for row in x]
    assert [[int(v) for v in row] for row in model.deviations(x)] == want
    assert model.squares(model.deviations(x)) == [sum(v * v for v in row) for row in want]


def brute_top(rows, k=5, every=50):
    use = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) and math.isfinite(256 * c) for c in v):
            v = [math.floor(256 * c) for c in v]
            use[i] = min(use.get(i, v), v)
    out = []
    for q in use:
        if q % every == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(use[q], v)))), i) for i, v in use.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def top(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    """Clusters of unequal norms, one long vector, many equal ones, and ties."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 8))
    x = middles[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8)) * 0.1
    x[7] *= 1000
    x[100:600] = x[100]
    x[700:720] = np.round(x[700:720])
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_top_k_in_one_subtree(spark, clustered):
    assert top(metric_tree.exact_top_k(frame(spark, clustered))) == brute_top(clustered)


def test_top_k_over_many_levels(spark, clustered, monkeypatch):
    for name, value in (("SUBTREE_ROWS", 60), ("FANOUT", 4), ("CHUNK_ROWS", 100), ("QUERY_ROWS", 8)):
        monkeypatch.setattr(metric_tree, name, value)
    ws = Workspace(spark, "t")
    kept = metric_tree.usable(frame(spark, clustered))
    assert len(metric_tree.Tree(kept, 1500, ws).levels) >= 3
    assert top(metric_tree.exact_top_k(frame(spark, clustered))) == brute_top(clustered)
    monkeypatch.setattr(metric_tree, "LEVELS", 1)  # groups that are still too large are dealt into several subtrees
    assert top(metric_tree.exact_top_k(frame(spark, clustered))) == brute_top(clustered)


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, -2.0]), (50, [0.0, 0.0]), (51, [3.0]), (52, []), (53, None), (54, [None, 1.0]), (55, [float("nan"), 0.0]), (56, [float("inf"), 0.0]), (None, [1.0, 1.0]), (57, [0.5, 0.001, -7.0]), (100, [1e6, -1e6])]
    assert top(metric_tree.exact_top_k(frame(spark, rows))) == brute_top(rows)
    assert top(metric_tree.exact_top_k(frame(spark, rows), "vec_id > 0", 2)) == brute_top(rows, 2, 1)[2:]
    # Products past 2**53, past 64 bits, and lengths past what a double holds.
    rows = [(0, [1e12, 3.0]), (1, [1e6, 1.0]), (2, [1e6, 1.00390625]), (50, [1e300, 1e300]), (3, [-1e300, 1.0]), (4, [1e306, 0.0]), (5, [1e200, -1e200])]
    assert top(metric_tree.exact_top_k(frame(spark, rows))) == brute_top(rows)
    assert metric_tree.exact_top_k(frame(spark, [])).collect() == [] == metric_tree.exact_top_k(frame(spark, [(50, [1.0])])).collect()
    assert top(metric_tree.exact_top_k(frame(spark, [(50, []), (51, [])]))) == [(50, 1, 51, 0)]


def test_bounds_save_products():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 16)) * 200
    x = np.floor(middles[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 5)
    tree = metric_tree.Subtree(metric_tree.load_pages(np.arange(8000), x))
    for i in range(50):
        got = tree.search(x[i], i, 5, -np.inf)
        scores = x @ x[i]
        scores[i] = -np.inf
        order = np.lexsort((np.arange(8000), -scores))[:5]
        assert got == [(int(scores[j]), int(j)) for j in order]
    assert tree.products < 50 * 8000 / 8
    assert max(len(p[1]) for p in tree.pages.values()) <= metric_tree.PAGE and sum(len(p[1]) for p in tree.pages.values() if p[0]) == 8000
    # Vectors all alike make pages as well.
    same = metric_tree.load_pages(np.arange(1000), np.ones((1000, 3)))
    assert sorted(i for p in same if p[1] for i in p[2]) == list(range(1000))
