"""BAM files, whole and damaged: what is read, and what is said of the rest."""

import random
import struct
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spliceframe.sources import bam

REFS = [("chr1", 100_000), ("chr2", 100_000)]


def records(n, seed=1, long_at=()):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ops = [("M", rng.randrange(1, 90)) for _ in range(1)] + [(rng.choice("NID"), rng.randrange(1, 2000)), ("M", 20)] * rng.randrange(3)
        out.append((f"read{i}" + "x" * rng.randrange(20), rng.randrange(4096), rng.randrange(-1, 2), rng.randrange(90_000), ops, rng.randrange(-1, 2), rng.randrange(90_000), rng.randrange(-500, 500), 40_000 if i in long_at else rng.randrange(120), rng.choice([None, 1, 2, 200])))
    return out


def size_of(r):
    return 4 + 32 + len(r[0]) + 1 + 4 * len(r[4]) + (r[8] + 1) // 2 + r[8] + (0 if r[9] is None else 8)


def blocks_of(raw):
    """(place, length) of each block of an undamaged file."""
    at, out = 0, []
    while at < len(raw):
        n = bam.Blocks.length(raw[at : at + 64])
        out.append((at, n))
        at += n
    return out


def as_row(r):
    return (r[0], r[1], r[2], r[3], r[6], r[7], r[8], r[9], [(o, n) for o, n in r[4]])


def rows_of(df):
    return [(x["qname"], x["flag"], x["ref_id"], x["pos"], x["mpos"], x["isize"], x["l_seq"], x["nh"], [(c["op"], c["len"]) for c in x["cigar"]]) for x in df.orderBy("ord").collect()]


@pytest.fixture(scope="module")
def plain(tmp_path_factory):
    rows = records(3000, long_at=(700, 1500))
    path = tmp_path_factory.mktemp("bam") / "one.bam"
    bam.write_bam(str(path), REFS, rows, 9000)
    return path, rows


@pytest.mark.parametrize("split", [20_000, 64 << 20])
def test_all_columns_of_a_whole_file(spark, plain, split):
    path, rows = plain
    got = bam.read_bam(spark, str(path), split)
    assert rows_of(got) == [as_row(r) for r in rows]
    assert got.rdd.getNumPartitions() == -(-path.stat().st_size // split)
    assert bam.scan_bam(spark, str(path), split).where("gap is not null").count() == 0
    some = bam.read_bam(spark, str(path), split, ["nh", "qname"])
    assert some.columns == ["nh", "qname"] and sorted((r["qname"], r["nh"] or 0) for r in some.collect()) == sorted((r[0], r[9] or 0) for r in rows)


def damage(raw, kind):
    """A damaged copy, and the places of blocks that are still sound."""
    blocks = blocks_of(raw)
    large = [b for b in blocks if b[1] > 500]  # long repeats make blocks of a few bytes
    at, n = large[len(large) // 2]
    sound = [b for b in blocks if b != (at, n)]
    if kind == "flipped byte":
        return raw[: at + 40] + bytes([raw[at + 40] ^ 255]) + raw[at + 41 :], sound
    if kind == "no header":
        return raw[:at] + b"\0" * 4 + raw[at + 4 :], sound
    if kind == "missing block":
        return raw[:at] + raw[at + n :], [(a, k) if a < at else (a - n, k) for a, k in sound]
    if kind == "three blocks zeroed":
        three = blocks[blocks.index((at, n)) : blocks.index((at, n)) + 3]
        z = sum(k for _, k in three)
        return raw[:at] + b"\0" * z + raw[at + z :], [b for b in blocks if b not in three]
    if kind == "cut in a block":
        return raw[: at + n // 2], [b for b in sound if b[0] < at]
    if kind == "cut at a border":
        return raw[:at], [b for b in sound if b[0] < at]
    if kind == "wrong size":
        return raw[: at + 16] + struct.pack("<H", n - 2) + raw[at + 18 :], sound
    if kind == "junk behind":
        return raw + b"junk" * 999, blocks
    if kind == "two places":
        a2, n2 = large[len(large) // 4]
        raw = raw[: at + 60] + b"\xaa" * 9 + raw[at + 69 :]
        return raw[: a2 + 3] + b"\0" * 20 + raw[a2 + 23 :], [b for b in sound if b != (a2, n2)]
    raise ValueError(kind)


KINDS = ["flipped byte", "no header", "missing block", "three blocks zeroed", "cut in a block", "cut at a border", "wrong size", "junk behind", "two places"]


@pytest.mark.parametrize("kind", KINDS)
def test_records_and_gaps_cover_a_damaged_file(spark, plain, tmp_path, kind):
    path, rows = plain
    raw, sound = damage(path.read_bytes(), kind)
    (tmp_path / "bad.bam").write_bytes(raw)
    inflated = sum(len(zlib.decompress(raw[a : a + n], 31)) for a, n in sound)
    header = 12 + sum(len(f"@SQ\tSN:{n}\tLN:{k}\n") for n, k in REFS) + sum(9 + len(n) for n, _ in REFS)
    by_name = {r[0]: r for r in rows}
    seen = set()
    for split in (7_000, 30_000, 64 << 20):
        out = bam.scan_bam(spark, str(tmp_path / "bad.bam"), split).cache()
        gaps = [r["gap"] for r in out.where("gap is not null").collect()]
        kept = rows_of(out.where("gap is null"))
        seen.add((tuple(sorted((g["offset"], -1 if g["within"] is None else g["within"], g["length"], g["reason"]) for g in gaps)), len(kept)))
        assert all(as_row(by_name[k[0]]) == k for k in kept) and len({k[0] for k in kept}) == len(kept)
        whole = sorted([(a, n) for a, n in sound] + [(g["offset"], g["length"]) for g in gaps if g["within"] is None and g["length"]])
        assert whole[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(whole, whole[1:])) and sum(whole[-1]) == len(raw)
        assert inflated == header + sum(size_of(by_name[k[0]]) for k in kept) + sum(g["length"] for g in gaps if g["within"] is not None)
        assert gaps and len(kept) > 1000
        out.unpersist()
    assert len(seen) == 1  # however the file is split
    with pytest.raises(PySparkException, match="bad.bam: "):
        bam.read_bam(spark, str(tmp_path / "bad.bam"), 30_000).count()


def test_damage_within_sound_blocks(spark, tmp_path):
    """Bytes overwritten before they were compressed: records go on at the next place where any begin."""
    rows = records(800)
    bam.write_bam(str(tmp_path / "a.bam"), REFS, rows, 4000)
    raw = (tmp_path / "a.bam").read_bytes()
    data = bytearray(b"".join(zlib.decompress(raw[a : a + n], 31) for a, n in blocks_of(raw)))
    at = len(data) // 2
    data[at : at + 300] = b"\xee" * 300
    with open(tmp_path / "b.bam", "wb") as f:
        for i in range(0, len(data), 4000):
            f.write(bam.block_of(bytes(data[i : i + 4000])))
        f.write(bam.CLOSING)
    by_name = {r[0]: r for r in rows}
    for split in (3_000, 64 << 20):
        out = bam.scan_bam(spark, str(tmp_path / "b.bam"), split).collect()
        kept, gaps = [r for r in out if r["gap"] is None], [r["gap"] for r in out if r["gap"] is not None]
        # A record whose sequence was hit is still one; those whose fixed fields were hit are gaps.
        lost = [r for r in rows if r[0] not in {k["qname"] for k in kept}]
        assert 0 < len(lost) <= 6 and sum(g["length"] for g in gaps) == sum(size_of(r) for r in lost)
        assert {g["reason"] for g in gaps} == {"no record begins here"} and by_name


def test_a_broken_header_and_many_files(spark, plain, tmp_path):
    paths = []
    for i in range(12):
        bam.write_bam(str(tmp_path / f"s{i}.bam"), REFS, records(30 + i, seed=i))
        paths.append(str(tmp_path / f"s{i}.bam"))
    files = bam.probe(spark, paths)
    assert [len(p) for p in bam.pieces_of(files, 1 << 20)] == [12]  # small files share a partition
    large = bam.probe(spark, [*paths, str(plain[0])])
    assert sorted(len(p) for p in bam.pieces_of(large, 100_000))[-1] > 3 and sum(len(p) for p in bam.pieces_of(large, 100_000)) == 12 + -(-plain[0].stat().st_size // 100_000)
    counts = {r["sample_id"]: r["count"] for r in bam.read_bam(spark, paths).groupBy("sample_id").count().collect()}
    assert counts == {f"s{i}": 30 + i for i in range(12)}
    marked = {r["sample_id"]: r["unmarked"] for r in bam.bam_samples(spark, files).collect()}
    assert marked == {f"s{i}": records(1, seed=i)[0][9] is None for i in range(12)}
    (tmp_path / "s3.bam").write_bytes(b"not a bam file at all")
    gaps = bam.scan_bam(spark, paths).where("gap is not null").collect()
    assert [(r["sample_id"], r["gap"]["offset"], r["gap"]["length"]) for r in gaps] == [("s3", 0, 21)]
    with pytest.raises(ValueError, match="s3.bam"):
        bam.read_bam(spark, paths)


def test_comparisons_are_made_before_decoding(spark, plain):
    path, rows = plain
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        got = bam.read_bam(spark, str(path), columns=["qname", "ref_id", "pos", "flag"]).where((F.col("ref_id") >= 0) & F.col("flag").isin(*range(0, 4096, 3)) & (F.col("pos") < 50_000))
        assert sorted(r["qname"] for r in got.collect()) == sorted(r[0] for r in rows if r[2] >= 0 and r[1] % 3 == 0 and r[3] < 50_000)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan or "pos" not in plan.split("Filter", 1)[1].splitlines()[0]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_tags_before_nh(spark):
    import numpy as np

    tags = [b"ASi\1\2\3\4XZZtext\0XBBs\2\0\0\0\1\0\2\0NHS\x2c\1", b"XCc\5", b"XHH0A\0NHi\7\0\0\0", b"", b"NHZno\0NHC\3", b"Q?"]
    data, at, end = b"", [], []
    for t in tags:
        at.append(len(data))
        data += t
        end.append(len(data))
    value, has = bam._nh(np.frombuffer(data, np.uint8), np.array(at), np.array(end))
    assert [int(v) if h else None for v, h in zip(value, has)] == [300, None, 7, None, 3, None]
