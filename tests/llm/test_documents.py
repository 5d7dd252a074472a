"""Document operators against brute force, and on odd rows."""

import hashlib
import itertools
import random
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceframe.llm import fingerprints, licenses, mixing, near_dedup, substring_dedup, toxicity
from spliceframe.llm.common import Workspace, byte_words, gram_hashes, word_hashes
from spliceframe.llm.components import connected_components


def words(rng, n, vocabulary=4000):
    return [f"v{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Random documents with exact copies, families of loose copies, shared passages and a common line."""
    rng = random.Random(11)
    docs = [words(rng, rng.choice([3, 5, 40, 200])) for _ in range(60)]
    for base in (docs[3], docs[7], words(rng, 150)):
        docs += [list(base) for _ in range(3)]
        now = list(base)
        for _ in range(40):  # a chain of edits: near its neighbours, far from its start
            now = list(now)
            for _ in range(rng.randrange(1, 6)):
                if now:
                    now[rng.randrange(len(now))] = f"e{rng.randrange(10**6)}"
            docs.append(now)
    passage, line = words(rng, 70), words(rng, 12)
    for d in rng.sample(docs, 25):
        at = rng.randrange(len(d) + 1)
        d[at:at] = passage[: rng.choice([49, 50, 70])]
    for d in docs[::2]:
        d[:0] = line
    rows = [(i, rng.choice([" ", "\n", "  "]).join(d)) for i, d in enumerate(docs)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = byte_words(t, True)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_all_pairs(corpus):
    rows, docs = corpus
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicate_groups(docs).collect()}
    want = brute_components(rows)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(want) - 20
    kept = near_dedup.drop_near_duplicates(docs)
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()} and kept.columns == docs.columns


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_dedup.near_duplicate_groups(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[1][0]["n_shingles"] == by[2][0]["n_shingles"] == by[3][0]["n_shingles"] == 0 and by[2][0]["component_id"] == 2
    assert by[5][0]["component_id"] == by[5][1]["component_id"] == 4 and by[9][0]["component_id"] == 8
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    assert near_dedup.near_duplicate_groups(none).count() == 0
    assert set(near_dedup.drop_near_duplicates(odd).columns) == set(odd.columns)


def brute_passages(rows, window=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = byte_words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if first.setdefault(k, i) < i:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("shard_words", [500, 1_000_000])
def test_repeated_passages_equal_all_windows(corpus, monkeypatch, shard_words):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(substring_dedup, "TASK_SEGMENTS", shard_words // 10)
    rows, docs = corpus
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], substring_dedup.kept_digest(r["text"])) for r in substring_dedup.remove_repeated_passages(docs).collect()}
    want = brute_passages(rows)
    assert got == want and sum(w[1] for w in want.values()) > 1000


def test_repeated_passages_of_repetitive_text(spark):
    rows = [(1, "a b " * 60), (2, "b a " * 60), (3, "a b " * 20), (4, "c " + "a b " * 30), (5, "z " * 49)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], substring_dedup.kept_digest(r["text"])) for r in substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_passages(rows)


def test_repeated_passages_of_odd_rows(odd, none):
    out = substring_dedup.remove_repeated_passages(odd)
    assert out.columns == [*odd.columns, "n_words", "n_removed"]
    got = {(r["doc_id"], r["text"] if r["text"] is None else len(r["text"])): r for r in out.collect()}
    assert len(out.collect()) == odd.count()
    assert got[1, None]["n_words"] == 0 and got[9, 4]["n_removed"] == 30_000 and got[9, 4]["text"] == "tail"
    assert got[3, 3]["text"] == " \t\n" and all(r["key"] == "clash" for r in got.values())
    assert substring_dedup.remove_repeated_passages(none).count() == 0


def test_grams_and_winnowing():
    h = word_hashes([b"%d" % (i % 7) for i in range(90)])
    g = gram_hashes(h, 50)
    assert len(g) == 41 and (g[:34] == g[7:41]).all() and len(set(g.tolist())) == 7
    at, grams = substring_dedup.selected(h)
    for s in range(len(at)):
        own = grams[s : s + 26]
        assert at[s] == s + int(np.argmin(own))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)] + [(2000, i) for i in range(2001, 2300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 5, 30, 200]), None if (s := rng.randrange(7)) == 6 else f"s{s}") for i in range(2000)] + [(9000, "only " * 11, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows) and sorted(got) == sorted(mixing.copies(docs.repartition(7)).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect())
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3 and r["source_size"] is not None
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted((s for s in size if s is not None)) + [None])}
    want, open_, total = {}, set(size), float(sum(size.values()))
    while True:  # share, stop at the cap, share the excess again
        rest, w = total - sum(want.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w > 3 * size[s]}
        want |= {s: 3.0 * size[s] for s in over}
        open_ -= over
        if not over:
            want |= {s: rest * weight[s] / w for s in open_}
            break
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] + 1e-9 for s in want)
    assert all(abs(taken[s] - target[s]) <= 100 for s in want)  # half the longest document
    assert taken["tiny"] == 33
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def filled(weight, cap, total):
    """Shares of total by weight, each stopping at its cap, the excess shared again."""
    got, open_ = {}, {k for k in weight if weight[k] > 0}
    while open_:
        rest, w = total - sum(got.values()), sum(weight[k] for k in open_)
        over = {k for k in open_ if rest * weight[k] / w >= cap[k]}
        got |= {k: cap[k] if over else rest * weight[k] / w for k in over or open_}
        open_ -= over or open_
    return got


def test_mixing_draws_by_pareto_order(spark):
    """Each row's copies by brute force: certain whole copies, then all rows of a source sorted by their odds ratio."""
    rng = random.Random(14)
    rows = [(i, "w " * rng.choice([0, 1, 3, 9, 40, 41, 300, 2000 if i % 97 == 0 else 7]), f"s{min(rng.randrange(12), 5)}") for i in range(3000)]
    rows += [(8000, "tiny text", "t"), (8001, None, "t"), (8002, "tiny " * 70, "t")] + [(8003, "again " * 31, "s1")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["copies"]) for r in mixing.copies(docs).select("row.doc_id", "copies").collect())
    drawn = [(r["doc_id"], r["source"], len((r["text"] or "").split()), r["h"]) for r in docs.withColumn("h", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text")).collect()]
    size = Counter()
    for _, s, n, _ in drawn:
        size[s] += n
    targets = filled({s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}, {s: 3.0 * n for s, n in size.items()}, float(sum(size.values())))
    want, fractions = Counter(), 0
    for s, target in targets.items():
        docs_ = [(i, n, h, max(n, 1).bit_length() - 1) for i, t, n, h in drawn if t == s]
        words = Counter()
        for _, n, _, b in docs_:
            words[b] += n
        share = filled({b: 2.0 ** (mixing.FAVOUR * b) * w for b, w in words.items()}, {b: 3.0 * w for b, w in words.items()}, target)
        copies = {b: round(share[b] / w, 9) if w else 0.0 for b, w in words.items()}
        left = target - sum(int(copies[b]) * w for b, w in words.items())
        order = []
        for i, n, h, b in docs_:
            p = copies[b] - int(copies[b])
            if p > 0 and n > 0:
                u = (((h & (1 << 64) - 1) >> 11) + 0.5) / 2**53
                order.append((u / (1 - u) / (p / (1 - p)), h, n))
        order.sort()
        fractions += len(order)
        chosen, behind = set(), []
        for key, same in itertools.groupby(order, lambda r: r[:2]):  # equal rows are taken together
            n = [r[2] for r in same]
            if not behind and sum(n) <= left:
                chosen.add(key)
                left -= sum(n)
            else:
                behind.append((abs(n[0] - left), *key))
        chosen |= {min(behind)[1:]} if behind and min(behind)[0] < left else set()
        for i, n, h, b in docs_:
            want[i, int(copies[b]) + any(h == k[1] for k in chosen)] += 1
    assert got == want and fractions > 1000 and len({c for _, c in got}) >= 3


def test_mixing_of_odd_rows(spark, odd, none):
    got = mixing.copies(odd).select("row.doc_id", "size", "copies").collect()
    assert len(got) == odd.count() and mixing.copies(none).count() == 0
    zero = odd.where("doc_id <= 3")
    assert [r["target"] for r in mixing.copies(zero).collect()] == [0.0, 0.0, 0.0]
    assert mixing.mix_sources(odd).columns == odd.columns


def order_min_hash_of(spark, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fingerprints.sketch(F.col("t")).alias("s")).orderBy("i").select("s").collect()]


def test_fingerprints_follow_edits(spark):
    rng = random.Random(8)
    base = words(rng, 400)
    swapped = base[200:] + base[:200]
    half = base[:200] + words(rng, 200)
    one = list(base)
    one[100] = "changed"
    rows = [(" ".join(x)) for x in (base, one, half, swapped, words(rng, 400))]
    s = order_min_hash_of(spark, rows)
    pairs = spark.createDataFrame([(s[0], x) for x in s], "a array<int>, b array<int>").select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()
    near = [r[0] for r in pairs]
    assert near[0] == 1.0 and near[1] > 0.85 and 0.02 < near[2] < 0.5 and near[4] == 0.0
    assert near[3] < 0.85  # almost the same k-mers, in another order


def test_fingerprints_of_text_without_spaces(spark):
    rng = random.Random(9)
    base = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(600))
    other = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(600))
    rows = [base, base[:300] + "改" + base[301:], "新" + base, base[:300] + other[:300], other, base[:200] + " " + base[200:]]
    s = order_min_hash_of(spark, rows)
    near = [r[0] for r in spark.createDataFrame([(s[0], x) for x in s], "a array<int>, b array<int>").select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()]
    assert near[0] == 1.0 and min(near[1], near[2], near[5]) > 0.85 and 0.02 < near[3] < 0.5 and near[4] < 0.1


def test_sketch_equals_its_definition(spark):
    """Occurrence numbers, two least of each bucket, text order: rebuilt in Python on the same hashes."""
    texts = ["a b a b a b a b c", "q", "", "x y", "t " * 300 + "u v w", "a " + "漢字🙂" * 15 + " z " + "w" * 32, "x" * 200]
    signed = lambda n: n - (1 << 64) if n >= 1 << 63 else n
    for t, got in zip(texts, order_min_hash_of(spark, texts)):
        w = [x for v in t.split() for x in (v if len(v) > fingerprints.LONG else [v])]
        grams = [w[i : i + 3] for i in range(max(1, len(w) - 2))] if w else []
        h = [r[0] for r in spark.createDataFrame([(i, g) for i, g in enumerate(grams)], "i int, g array<string>").orderBy("i").select(F.xxhash64("g")).collect()] if grams else []
        mask = (1 << 26) - 1
        high = [x & ~mask for x in h]
        seen, items = Counter(), []
        for i, x in enumerate(high):
            items.append((x, seen[x], i))
            seen[x] += 1
        if not items:
            assert got == []
            continue
        g = [r[0] for r in spark.createDataFrame([(i, x, o) for i, (x, o, _) in enumerate(items)], "i int, x long, o int").orderBy("i").select(F.xxhash64("x", "o")).collect()]
        packed = sorted((v & ~mask) | i for v, (_, _, i) in zip(g, items))
        buckets = defaultdict(list)
        for v in packed:
            if len(buckets[(v >> 58) & 63]) < 2:
                buckets[(v >> 58) & 63].append(v)
        want = []
        for b, vs in buckets.items():
            vs.sort(key=lambda v: v & mask)
            cols = [F.lit(signed((v & ~mask) & ((1 << 64) - 1))) for v in vs]
            value = spark.range(1).select(F.xxhash64(*cols)).first()[0]
            want.append(b << 18 | (value & ((1 << 64) - 1)) >> 46)
        assert sorted(got) == sorted(want), t[:20]


def test_edited_texts_and_neighbours(spark, odd, none):
    rows = [(30, "abcdefg"), (10, "ünïcode text of some words"), (20, None), (40, "z"), (50, "last one here")]
    for parts in (1, 3):
        got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
        texts = [t or "" for _, t in sorted(rows)]
        for k, (i, t) in enumerate(sorted(rows)):
            t, n = t or "", texts[(k + 1) % len(texts)]
            h = len(t) // 2
            edited = t[: len(t) - h] + n[:h]
            assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    many = fingerprints.fingerprint_documents(odd).collect()
    assert len(many) == odd.count() and fingerprints.fingerprint_documents(none).count() == 0
    same = [r["fingerprint"] for r in many if r["doc_id"] in (4, 5)]
    assert len(same) == 3 and len(set(same)) == 1
    alone = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0


def test_licenses(spark, odd, none):
    texts = ["Foo\nReleased under the MIT License.\nbar", "released, UNDER the mit license", "nothing here", "Licensed under the Apache License, Version 2.0!\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 2."]
    got = [r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert [r["license"] for r in got] == ["MIT-notice", "MIT-notice", None, "Apache-2.0-notice", "GPL-3.0-notice"]
    assert [r["n_matches"] for r in got] == [2, 1, 0, 3, 1] and got[0]["line"] == 2 and got[4]["score"] == 2 * 10 / 22
    assert len(licenses.scan_licenses(odd).collect()) == odd.count() and licenses.scan_licenses(none).count() == 0
    for n in range(1, 60):  # the bounds let nothing through that could reach the threshold
        lo, hi = licenses.bounds(n)
        best = lambda m: 2 * min(n, m) * 100 >= 75 * (n + m)
        assert all(best(m) == (lo <= m <= hi) for m in range(1, 200))


def test_licenses_wrapped_embedded_and_within_lines(spark):
    whole = dict(licenses.TEXTS)
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-2.0-or-later-notice")
    code = "\n".join(f"x{i} = compute({i}, y{i}) + offset{i}" for i in range(60))
    texts = [
        "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + whole["MIT"],
        "import os\n" + "\n".join("# " + x for x in textwrap.wrap(gpl, 72)) + "\n" + code,  # a wrapped header in a longer file
        code + "\n/*\n * " + whole["ISC"].replace("\n", "\n * ") + "\n */\n" + code,
        "Some words come before this, Released under the MIT License. And then others follow it in the same paragraph " + "of words " * 20,
        "\n".join([code, "* Released under", "* the MIT License.", code, "Released under", "the MIT License.", code]),  # two copies
        code,
        "Third parties\n" + code + "\n" + whole["Apache-2.0"],  # whole text within bounds
        "\n".join(f"z{i} = other({i}, y{i})" for i in range(2400)) + "\n" + whole["Apache-2.0"],
    ]
    got = [r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert [r["license"] for r in got[1:6]] == ["GPL-2.0-or-later-notice", "ISC", "MIT-notice", "MIT-notice", None]
    assert {("MIT", 0), ("MIT-grant", 5)} <= {(m["license"], m["line"]) for m in got[0]["matches"]}
    assert got[1]["line"] == 2 and got[1]["score"] == got[2]["score"] == got[3]["score"] == 1.0 and got[2]["line"] == 62 and got[3]["line"] == 1
    assert [m["line"] for m in got[4]["matches"]] == [61, 123] and got[5]["n_matches"] == 0
    assert {"Apache-2.0", "Apache-2.0-header"} <= {m["license"] for m in got[6]["matches"]} & {m["license"] for m in got[7]["matches"]}
    assert [m["line"] for m in got[7]["matches"] if m["license"] == "Apache-2.0"] == [2402]  # after an empty first line


def test_license_windows_equal_all_windows(spark):
    rng = random.Random(4)
    name, text = "T", "a b c d a b e f g c d h"
    t = set(licenses.template_bigrams([(name, text)])[0][1])
    rows = []
    for i in range(60):
        ws = [rng.choice("abcdefghxyz") for _ in range(30)]
        part = text.split()
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = rng.choice("abcdxyz")
        at = rng.randrange(30)
        ws[at:at] = part
        rows.append((i, "".join(w + rng.choice("   \n") for w in ws)))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r["m"] for r in docs.select("doc_id", licenses.scan(F.col("text"), 75, [(name, text)]).alias("m")).collect()}
    hits = 0
    for i, x in rows:
        w = x.split()
        g = [f"{a} {b}" for a, b in zip(w, w[1:])]
        dice = lambda u: 2 * len(set(u) & t) / (len(set(u)) + len(t))
        best = max(dice(g[a:b]) for a in range(len(g)) for b in range(a + 1, len(g) + 1))
        assert bool(got[i]) == (best >= 0.75)
        lines = [y.split() for y in x.split("\n")]
        if best >= 0.75 and max(dice(u) for u in [g, *([f"{a} {b}" for a, b in zip(y, y[1:])] for y in lines)]) < 0.75:
            assert abs(max(m["score"] for m in got[i]) - best) < 1e-12
            hits += 1
    assert 10 < hits < 60


def toxic_corpus(spark, n=1500):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        sents = [words(rng, rng.randrange(4, 9), 300) for _ in range(rng.randrange(1, 8))]
        if bad:
            rng.choice(sents).insert(1, rng.choice(["grr", "bah", "pfui"]))
        rows.append((i, ". ".join(" ".join(s) for s in sents) + ".", int(bad != (rng.random() < 0.03))))
    return rows, spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, docs, labels = toxic_corpus(spark)
    out = toxicity.score_documents(docs, labels).select("row.doc_id", "row.text", "held_out", "score", "predicted", "offending").collect()
    bad = {r[0]: any(w in r[1].replace(".", "").split() for w in ("grr", "bah", "pfui")) for r in rows}
    held = [r for r in out if r["held_out"]]
    assert 350 < len(held) < 650 and all(0 <= r["score"] <= 1 for r in out)
    assert np.mean([bool(r["predicted"]) == bad[r["doc_id"]] for r in held]) > 0.97
    for r in out:
        for o in r["offending"]:
            assert set("grr bah pfui".split()) & set(r["text"][o["start"] : o["end"]].split())


def test_toxicity_ignores_held_out_labels(spark):
    _, docs, labels = toxic_corpus(spark, 400)
    turned = labels.withColumn("toxic", F.when(toxicity.fold_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ([tuple(r) for r in toxicity.score_documents(docs, x).select("row.doc_id", "score").orderBy("doc_id").collect()] for x in (labels, turned))
    assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-9)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 1), (8, 0), (99, 1)], "doc_id long, toxic int")
    out = toxicity.score_documents(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_documents(none, labels).count() == 0
    assert toxicity.score_documents(odd, labels.where("doc_id > 1000")).count() == odd.count()
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
