"""Near duplicates in a large loose family, the exact bounds, and repeated ids."""

import random

import numpy as np

from spliceframe.llm import near_dedup


def components(sets):
    """Of lists of hashes, by a matrix of all intersections."""
    every = {h: i for i, h in enumerate(sorted({h for s in sets for h in s}))}
    m = np.zeros((len(sets), len(every)), np.float32)
    for i, s in enumerate(sets):
        m[i, [every[h] for h in s]] = 1
    both, n = m @ m.T, m.sum(1)
    linked = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    root = np.arange(len(sets))
    while True:
        new = np.array([root[row].min() for row in linked])
        new = new[new]
        if (new == root).all():
            return root, linked
        root = new


def test_a_loose_family_of_2000(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = []
    for _ in range(2000):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            own[rng.randrange(60)] = f"x{rng.randrange(40)}"
        docs.append(" ".join(own))
    root, linked = components([near_dedup.shingle_set(t).tolist() for t in docs])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicate_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == {i: int(r) for i, r in enumerate(root)}
    assert 20 < len(set(root.tolist())) < 1900 and linked.sum() > 10_000


def test_bounds_never_turn_a_link_away():
    rng = random.Random(5)
    rows, sets = [], []
    for i in range(200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 12, 36, 70, 150, 700]))]
        other = list(words)
        for _ in range(rng.randrange(1, 2 + len(words) // 12)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
        other += [f"y{k}" for k in range(rng.randrange(1 + len(words) // 6))]
        sets += [near_dedup.shingle_set(" ".join(w)) for w in (words, other)]
    bits = [near_dedup.bitmap(s) for s in sets]
    able = {(i, j) for i in range(400) for j in range(i) if near_dedup._able(len(sets[i]), len(sets[j]), bits[i], bits[j])}
    similar = {(i, j) for i in range(400) for j in range(i) if near_dedup._similar(sets[i], sets[j])}
    assert similar <= able and 20 < len(similar) < len(able)
    assert all(near_dedup._apart(bits[i], bits[j]) <= len(np.setxor1d(sets[i], sets[j])) for i, j in able)
    rows = [(1, 0, 0, 0, 0, i, i, -1, len(s), b) for i, (s, b) in enumerate(zip(sets, bits))]  # a block of single classes without a largest one
    assert set(near_dedup._pairs_of(rows)) == able


def test_rows_that_repeat_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, a), (7, b), (3, f"{a} more"), (5, f"{b} more"), (9, "alone"), (9, None)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 37, 3, True), (5, 37, 3, False), (7, 36, 3, False), (7, 36, 3, False), (9, 0, 9, True), (9, 1, 9, True)]
