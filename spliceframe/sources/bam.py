"""BAM files as rows of model.ALIGNMENTS, and what could not be read of them.

A BAM file is a row of gzip blocks of at most 64 KiB, each with its size in its header, so a file can be cut anywhere: a task goes on to the first place from which a
whole block inflates. Records run across blocks; a task finds its first one as the first place from which a run of plausible records follows, and reads on behind its
end until the record that began before it is whole. ord is the virtual offset: the block's place in the file and the record's place in the block.

Nothing is lost silently. A block that has no header, is cut off, or fails to inflate or its checksum is a gap up to the next block that is sound; so are the remains of
records that ran into it, bytes where no record begins, and a missing closing block. read_bam() raises on the first of them, scan_bam() returns them as rows. Of each gap
in the file the task reports that read the block before it, so each is reported once however the file is split; records and gaps cover the file.

Records are decoded side by side with numpy, from a few megabytes of whole blocks at a time, and only the columns asked for."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from spliceframe.model import ALIGNMENTS

#: Letters of CIGAR operations by their codes, and the block that ends every file. Fixed values of the format.
OPS = "MIDNSHP=X"
CLOSING = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SPLIT, CHUNK, MOST = 64 << 20, 4 << 20, 1 << 26
GAP = "struct<path:string,offset:bigint,within:bigint,length:bigint,reason:string>"
_CIGAR = pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))
_ARROW = {
    "sample_id": pa.string(), "ord": pa.int64(), "qname": pa.string(), "flag": pa.int32(), "ref_id": pa.int32(), "pos": pa.int64(), "mpos": pa.int64(), "isize": pa.int32(), "l_seq": pa.int32(), "nh": pa.int32(), "cigar": _CIGAR,
    "gap": pa.struct([("path", pa.string()), ("offset", pa.int64()), ("within", pa.int64()), ("length", pa.int64()), ("reason", pa.string())]),
}
#: A record's fixed fields, from its size on.
_FIXED = np.dtype([("size", "<i4"), ("ref_id", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mref", "<i4"), ("mpos", "<i4"), ("isize", "<i4")])


def open_file(path: str):
    if "://" not in path:
        return open(path, "rb")
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def file_size(path: str) -> int:
    if "://" not in path:
        return os.path.getsize(path)
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.get_file_info(name).size


class Blocks:
    """Blocks of a file from a place on."""

    def __init__(self, f, size: int, at: int = 0):
        self.f, self.size, self.at = f, size, at

    @staticmethod
    def length(raw: bytes) -> int:
        """Size of the block whose first bytes these are; 0 if they aren't a block's."""
        if len(raw) < 18 or raw[:4] != b"\x1f\x8b\x08\x04":
            return 0
        extra, at = struct.unpack_from("<H", raw, 10)[0], 12
        while at + 4 <= min(len(raw), 12 + extra):
            key, n = raw[at : at + 2], struct.unpack_from("<H", raw, at + 2)[0]
            if key == b"BC" and n == 2 and at + 6 <= len(raw):
                return struct.unpack_from("<H", raw, at + 4)[0] + 1
            at += 4 + n
        return 0

    def block(self, at: int, raw: bytes | None = None) -> tuple[int, bytes] | str:
        """Length and content of the block at a place, or why there is none. raw: the file's bytes from there on, if at hand."""
        if raw is None:
            self.f.seek(at)
            raw = self.f.read(1 << 16)
        n = self.length(raw[:4096])
        if not n:
            return "no block header"
        if at + n > self.size:
            return "block is cut off"
        if n > len(raw):
            self.f.seek(at)
            raw = self.f.read(n)
        z = zlib.decompressobj(31)
        try:
            data = z.decompress(raw[:n])
        except zlib.error:
            return "block fails to inflate or its checksum"
        return (n, data) if z.eof and not z.unused_data else "block's size is wrong"

    def find(self, at: int, limit: int) -> int | None:
        """The first place from `at` on, before limit, where a whole block stands."""
        while at < min(limit, self.size):
            self.f.seek(at)
            raw = self.f.read(1 << 18)
            i = raw.find(b"\x1f\x8b\x08\x04")
            while i >= 0:
                if at + i >= limit:
                    return None
                if len(raw) - i < 1 << 16 and at + len(raw) < self.size and i:
                    break  # read on from here, so that the block is at hand
                if not isinstance(self.block(at + i, raw[i : i + (1 << 16)]), str):
                    return at + i
                i = raw.find(b"\x1f\x8b\x08\x04", i + 1)
            at += i if i > 0 else max(1, len(raw) - 3)
        return None

    def next(self) -> tuple[int, bytes] | tuple[int, int, str] | None:
        """The next block's place and content; or a gap's place, length and reason, up to the next sound block; None at the end."""
        if self.at >= self.size:
            return None
        here, got = self.at, self.block(self.at)
        if isinstance(got, str):
            after = self.find(here + 1, self.size)
            self.at = self.size if after is None else after
            return here, self.at - here, got
        self.at += got[0]
        return here, got[1]


class Header:
    """Reference names, and the block and the place in it where records begin."""

    def __init__(self, path: str, f, size: int):
        blocks, data, starts = Blocks(f, size), b"", []

        def need(n: int) -> None:
            nonlocal data
            while len(data) < n:
                got = blocks.next()
                if got is None or len(got) == 3:
                    raise ValueError(f"{path}: the header is cut off" if got is None else f"{path}: {got[2]} within the file's header, at byte {got[0]}")
                starts.append((len(data), got[0]))
                data += got[1]

        need(12)
        if data[:4] != b"BAM\x01":
            raise ValueError(f"{path}: not a BAM file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        need(at + 4)
        n = struct.unpack_from("<i", data, at)[0]
        at, self.names = at + 4, []
        for _ in range(n):
            need(at + 4)
            k = struct.unpack_from("<i", data, at)[0]
            need(at + 8 + k)
            self.names.append(data[at + 4 : at + 3 + k].decode())
            at += 8 + k
        while len(data) <= at and (got := blocks.next()) is not None and len(got) == 2:
            starts.append((len(data), got[0]))
            data += got[1]
        place = [(base, block) for base, block in starts if base <= at][-1]
        self.block, self.at = place[1], at - place[0]


def _ints(b: np.ndarray, at: int, n: int) -> np.ndarray:
    """The 32-bit number that stands at each of n places, from `at` on."""
    return (b[at : at + n].astype(np.uint32) | b[at + 1 : at + 1 + n].astype(np.uint32) << 8 | b[at + 2 : at + 2 + n].astype(np.uint32) << 16 | b[at + 3 : at + 3 + n].astype(np.uint32) << 24).view(np.int32)


def _sound(r: np.ndarray, n_ref: int) -> np.ndarray:
    """Which fixed fields may be a record's."""
    with np.errstate(over="ignore"):
        least = 32 + r["l_name"].astype(np.int64) + 4 * r["n_cigar"].astype(np.int64) + (r["l_seq"].astype(np.int64) + 1) // 2 + r["l_seq"]
    return (r["size"] >= 32) & (r["size"] < MOST) & (r["ref_id"] >= -1) & (r["ref_id"] < n_ref) & (r["mref"] >= -1) & (r["mref"] < n_ref) & (r["pos"] >= -1) & (r["mpos"] >= -1) & (r["l_name"] >= 1) & (r["l_seq"] >= 0) & (least <= r["size"])


def first_record(data: bytes, begin: int, n_ref: int, final: bool, run: int = 3) -> int | None:
    """The first place from begin on where a run of plausible records begins; final: nothing follows data, so a run may end with it, but holds a whole record. None: more is needed to tell, or nothing begins here."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - begin - 35
    if n > 0:
        size, ref, pos, mref = (_ints(b, begin + k, n) for k in (0, 4, 8, 24))
        maybe = np.flatnonzero((size >= 32) & (size < MOST) & (ref >= -1) & (ref < n_ref) & (pos >= -1) & (mref >= -1) & (mref < n_ref)) + begin
        for i in maybe.tolist():
            at, whole = i, 0
            while whole < run:
                if at + 36 > len(data):
                    break
                r = np.frombuffer(data, _FIXED, 1, at)
                end = at + 35 + int(r["l_name"][0])
                if not _sound(r, n_ref)[0] or (end < len(data) and data[end] != 0):
                    whole = -1
                    break
                if at + 4 + int(r["size"][0]) > len(data):
                    break
                at += 4 + int(r["size"][0])
                whole += 1
            if whole == run or (final and whole > 0):
                return i
            if whole >= 0 and not final:
                return None
    return None


_WIDTHS = np.zeros(256, np.int64)
for _kinds, _width in (("AcC", 1), ("sS", 2), ("iIf", 4)):
    _WIDTHS[list(_kinds.encode())] = _width
_INTS = {"c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4"}


def _nh(b: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """NH of each record, and whether it has one: all records step from tag to tag side by side."""
    value, has, at = np.zeros(len(at), np.int64), np.zeros(len(at), bool), at.copy()
    zeros = np.flatnonzero(b == 0)
    b = np.concatenate([b, np.zeros(8, np.uint8)])
    open_ = np.flatnonzero(at + 3 <= end)
    while len(open_):
        p = at[open_]
        kind = b[p + 2]
        here = (b[p] == ord("N")) & (b[p + 1] == ord("H"))
        done = np.zeros(len(open_), bool)
        for letter, form in _INTS.items():
            pick = np.flatnonzero(here & (kind == ord(letter)))
            if len(pick):
                width = np.dtype(form).itemsize
                value[open_[pick]] = b[(p[pick] + 3)[:, None] + np.arange(width)].view(form)[:, 0]
                has[open_[pick]] = done[pick] = True
        step = 3 + _WIDTHS[kind]
        text = np.flatnonzero((kind == ord("Z")) | (kind == ord("H")))
        if len(text):
            z = np.searchsorted(zeros, p[text] + 3)
            step[text] = np.where(z < len(zeros), zeros[np.minimum(z, len(zeros) - 1)] + 1, end[open_[text]]) - p[text] if len(zeros) else end[open_[text]] - p[text]
        many = np.flatnonzero(kind == ord("B"))
        if len(many):
            count = b[(p[many] + 4)[:, None] + np.arange(4)].view("<i4")[:, 0]
            step[many] = 8 + _WIDTHS[b[p[many] + 3]] * np.maximum(count, 0)
        done |= step == 3  # no kind that the format has
        at[open_] += step
        open_ = open_[~done & (at[open_] + 3 <= end[open_])]
    return value, has


def _runs(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all bytes (or items) of runs, one after the other, and where each run begins among them."""
    offsets = np.concatenate([[0], np.cumsum(length)])
    return np.repeat(first - offsets[:-1], length) + np.arange(offsets[-1]), offsets


def decode(data: bytes, starts: np.ndarray, sample: str, ord_: np.ndarray, columns: list[str], keep=None) -> pa.RecordBatch:
    """The records that begin at starts, as a batch of the columns. keep: of the numeric columns by name, which records to keep."""
    b = np.frombuffer(data, np.uint8)
    starts = np.asarray(starts, np.int64)
    r = b[starts[:, None] + np.arange(36)].view(_FIXED)[:, 0]
    ops_at = starts + 36 + r["l_name"]
    n_ops = r["n_cigar"].astype(np.int64)
    numeric = {c: r[c].astype(np.int64) for c in ("flag", "ref_id", "pos", "mpos", "isize", "l_seq")} | {"ord": ord_}
    nh = None
    if "nh" in columns:
        l_seq = r["l_seq"].astype(np.int64)
        nh = _nh(b, ops_at + 4 * n_ops + (l_seq + 1) // 2 + l_seq, starts + 4 + r["size"])
    if keep is not None:
        left = np.flatnonzero(keep(numeric))
        starts, r, ops_at, n_ops, numeric = starts[left], r[left], ops_at[left], n_ops[left], {c: v[left] for c, v in numeric.items()}
        nh = nh and (nh[0][left], nh[1][left])
    out = []
    for c in columns:
        if c in numeric:
            out.append(pa.array(numeric[c], _ARROW[c]))
        elif c == "sample_id":
            out.append(pa.array([sample] * len(starts), pa.string()))
        elif c == "nh":
            out.append(pa.array(nh[0], pa.int32(), mask=~nh[1]))
        elif c == "qname":
            at, offsets = _runs(starts + 36, r["l_name"].astype(np.int64) - 1)
            text = b[at]
            if (text > 127).any():
                raw = text.tobytes()
                out.append(pa.array([raw[i:j].decode("ascii", "replace") for i, j in zip(offsets[:-1], offsets[1:])], pa.string()))
            else:
                out.append(pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)))
        elif c == "cigar":
            at, offsets = _runs(np.zeros(len(starts), np.int64), n_ops)
            own = np.repeat(np.arange(len(starts)), n_ops)
            codes = b[(ops_at[own] + 4 * at)[:, None] + np.arange(4)].view("<u4")[:, 0] if len(own) else np.zeros(0, np.uint32)
            letters = pa.array(list(OPS) + ["?"] * (16 - len(OPS))).take(pa.array(codes & 15))
            pairs = pa.StructArray.from_arrays([letters, pa.array((codes >> 4).astype(np.int32))], ["op", "len"])
            out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs))
        else:
            out.append(pa.nulls(len(starts), _ARROW[c]))
    return pa.RecordBatch.from_arrays(out, schema=pa.schema([(c, _ARROW[c]) for c in columns]))


def _walk(data: bytes, at: int, n_ref: int) -> tuple[np.ndarray, int, bool]:
    """Where whole records begin from `at` on, each behind the one before; where they end; and whether they end for want of data rather than at what can't be a record."""
    starts, sound = [], True
    while at + 36 <= len(data):
        n = struct.unpack_from("<i", data, at)[0]
        if not 32 <= n < MOST:
            sound = False
            break
        if at + 4 + n > len(data):
            break
        starts.append(at)
        at += 4 + n
    s = np.array(starts, np.int64)
    if starts:
        b = np.frombuffer(data, np.uint8)
        r = b[s[:, None] + np.arange(36)].view(_FIXED)[:, 0]
        good = _sound(r, n_ref)
        good &= b[s + 35 + np.where(good, r["l_name"], 1)] == 0
        if not good.all():
            bad = int(np.flatnonzero(~good)[0])
            s, at, sound = s[:bad], int(s[bad]), False
    if not sound and len(s) and not _consistent(data, int(s[-1])):  # its own size may have led astray, as behind a block that is missing
        s, at = s[:-1], int(s[-1])
    return s, at, sound


def _consistent(data: bytes, at: int) -> bool:
    """Whether a record's operations are ones that the format has, and its tags end where it does."""
    r = np.frombuffer(data, _FIXED, 1, at)[0]
    end, p = at + 4 + int(r["size"]), at + 36 + int(r["l_name"])
    if any(data[p + 4 * i] & 15 >= len(OPS) for i in range(int(r["n_cigar"]))):
        return False
    p += 4 * int(r["n_cigar"]) + (int(r["l_seq"]) + 1) // 2 + int(r["l_seq"])
    while p + 3 <= end:
        kind = data[p + 2]
        if kind in b"ZH":
            z = data.find(b"\0", p + 3, end)
            if z < 0:
                return False
            p = z + 1
        elif kind == ord("B") and p + 8 <= end and _WIDTHS[data[p + 3]]:
            p += 8 + int(_WIDTHS[data[p + 3]]) * max(0, struct.unpack_from("<i", data, p + 4)[0])
        elif _WIDTHS[kind]:
            p += 3 + int(_WIDTHS[kind])
        else:
            return False
    return p == end


class _Piece:
    """A range of one file."""

    def __init__(self, file: dict, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _Packed(InputPartition):
    def __init__(self, pieces: list[_Piece]):
        self.pieces = pieces


class _Damaged(ValueError):
    pass


def pieces_of(files: list[dict], split: int) -> list[list[_Piece]]:
    """Ranges of large files, one for each partition, and whole small files, packed until a partition has about split bytes."""
    out, pack, held = [], [], 0
    for f in sorted(files, key=lambda f: -f["size"]):
        if f["size"] > split:
            out += [[_Piece(f, at, min(at + split, f["size"]))] for at in range(0, f["size"], split)]
            continue
        if pack and held + f["size"] > split:
            out.append(pack)
            pack, held = [], 0
        pack.append(_Piece(f, 0, f["size"]))
        held += f["size"]
    return out + [pack] if pack else out


class BamReader(DataSourceReader):
    def __init__(self, files: list[dict], split: int, columns: list[str], strict: bool):
        self.files, self.split, self.columns, self.strict, self.filters = files, split, columns, strict, []

    def partitions(self):
        return [_Packed(p) for p in pieces_of(self.files, self.split)]

    def read(self, part: _Packed) -> Iterator[pa.RecordBatch]:
        for piece in part.pieces:
            yield from self._piece(piece)

    def _gap(self, file: dict, offset: int, within: int | None, length: int, reason: str) -> Iterator[pa.RecordBatch]:
        if self.strict:
            raise _Damaged(f"{file['path']}: {reason}: {length} bytes from byte {offset}" + ("" if within is None else f", {within} bytes into what that block inflates to"))
        row = {"sample_id": file["sample_id"], "gap": {"path": file["path"], "offset": offset, "within": within, "length": length, "reason": reason}}
        yield pa.RecordBatch.from_pylist([{c: row.get(c) for c in self.columns}], schema=pa.schema([(c, _ARROW[c]) for c in self.columns]))

    def _keep(self, numeric: dict[str, np.ndarray]) -> np.ndarray:
        ok = np.ones(len(numeric["flag"]), bool)
        for name, test, value in self.filters:
            ok &= test(numeric[name], value)
        return ok

    def _piece(self, piece: _Piece) -> Iterator[pa.RecordBatch]:
        file, end = piece.file, piece.end
        if file["error"] is not None:
            yield from self._gap(file, 0, None, file["size"], file["error"])
            return
        with open_file(file["path"]) as f:
            blocks = Blocks(f, file["size"])
            if end == file["size"]:
                f.seek(max(0, file["size"] - len(CLOSING)))
                if f.read(len(CLOSING)) != CLOSING:
                    yield from self._gap(file, file["size"], None, 0, "no closing block")
            # at: where the next record begins in data, or None while that is looked for from `search` on. What is skipped then is the end of a record of
            # the range before; behind damage it is logged.
            if piece.start <= file["first_block"] < end:
                blocks.at, at = file["first_block"], file["first_at"]
            else:
                found = None if end <= file["first_block"] else blocks.find(piece.start, end)
                if found is None:
                    return
                blocks.at, at = found, None
            search, log, data, bases, places, last = 0, False, b"", [], [], -1

            def place(i: int) -> tuple[int, int]:
                k = int(np.searchsorted(bases, i, "right")) - 1
                return places[k], i - bases[k]

            while True:
                parts, size = [data], len(data)
                enough = size + CHUNK
                while size < enough:
                    got = blocks.next()
                    if got is None or len(got) == 3:
                        break
                    last = got[0]
                    bases.append(size)
                    places.append(last)
                    parts.append(got[1])
                    size += len(got[1])
                    if last >= end:  # what lies behind the range only completes its last record
                        enough = min(enough, len(data) + (1 << 17))
                data, broken = b"".join(parts), got is None or len(got) == 3
                while True:
                    if at is None:
                        at = first_record(data, search, file["n_ref"], broken)
                        if at is None and not broken:
                            break
                        at = len(data) if at is None else at
                        if log and at > search:
                            yield from self._gap(file, *place(search), at - search, "no record begins here")
                        log = False
                    starts, at, sound = _walk(data, at, file["n_ref"])
                    if len(starts):
                        k = np.searchsorted(bases, starts, "right") - 1
                        block = np.array(places, np.int64)[k]
                        own = block < end
                        if own.any():
                            yield decode(data, starts[own], file["sample_id"], (block[own] << 16) | (starts[own] - np.array(bases, np.int64)[k[own]]), self.columns, self._keep if self.filters else None)
                        if not own.all():
                            return
                    if sound:
                        break
                    search, at, log = at, None, True
                if broken:
                    if at < len(data) and place(at)[0] < end:
                        yield from self._gap(file, *place(at), len(data) - at, "record is cut off")
                    if got is None or last >= end:
                        return
                    yield from self._gap(file, got[0], None, *got[1:])
                    data, bases, places, at, search, log = b"", [], [], None, 0, True
                    continue
                # Only what a record that isn't whole yet needs is kept.
                start = search if at is None else at
                k = max(0, int(np.searchsorted(bases, start, "right")) - 1)
                cut = bases[k]
                data, bases, places = data[cut:], [x - cut for x in bases[k:]], places[k:]
                at, search = (None if at is None else at - cut), max(0, search - cut)


class _FilteringReader(BamReader):
    """Takes over comparisons of numeric columns, which are then made before names and CIGARs are decoded."""

    _TESTS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal, In: np.isin}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in ("flag", "ref_id", "pos", "mpos", "isize", "l_seq", "ord") and (type(f) in self._TESTS or isinstance(f, IsNotNull)):
                if not isinstance(f, IsNotNull):
                    self.filters.append((name, self._TESTS[type(f)], list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f


class BamDataSource(DataSource):
    """Options: files (what probe() found, as JSON), split, columns (separated by commas), strict, push."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def _columns(self) -> list[str]:
        return self.options["columns"].split(",")

    def schema(self) -> str:
        kinds = dict(c.strip().split(" ", 1) for c in ALIGNMENTS.replace("struct<op:string,len:int>", "struct<op:string;len:int>").split(",")) | {"gap": GAP}
        return ", ".join(f"{c} {kinds[c].replace(';', ',')}" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("push") == "true" else BamReader
        return kind(json.loads(self.options["files"]), int(self.options.get("split", SPLIT)), self._columns(), self.options.get("strict", "true") == "true")


def paths_of(path: str | list[str]) -> list[str]:
    """Files separated by commas, or a list of them: local paths, or addresses of a shared file system."""
    return [p.strip().removeprefix("file://") for p in (path.split(",") if isinstance(path, str) else path)]


_PROBED = "path string, sample_id string, size long, n_ref int, first_block long, first_at long, marked boolean, error string"


def _probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            sample = os.path.basename(path).rsplit(".", 1)[0]
            size = file_size(path)
            try:
                with open_file(path) as f:
                    h = Header(path, f, size)
                rows.append((path, sample, size, len(h.names), h.block, h.at, _first_marked(path, size, h), None))
            except ValueError as e:
                rows.append((path, sample, size, 0, 0, 0, None, str(e)))
        yield pd.DataFrame(rows, columns=["path", "sample_id", "size", "n_ref", "first_block", "first_at", "marked", "error"])


def _first_marked(path: str, size: int, h: Header) -> bool | None:
    """Whether the file's first record has an NH; None without a record."""
    with open_file(path) as f:
        blocks, data = Blocks(f, size, h.block), b""
        while (got := blocks.next()) is not None and len(got) == 2:
            data += got[1]
            at = h.at
            if at + 36 <= len(data):
                n = struct.unpack_from("<i", data, at)[0]
                if not 32 <= n < MOST:
                    return None
                if at + 4 + n <= len(data):
                    return bool(decode(data, np.array([at]), "", np.zeros(1, np.int64), ["nh"]).column(0)[0].is_valid)
    return None


def probe(spark: SparkSession, path: str | list[str]) -> list[dict]:
    """Size, header and first record of each file, read once each by tasks: a row for each file comes back, nothing of its records."""
    paths = paths_of(path)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 1000))
    return sorted((r.asDict() for r in listed.mapInPandas(_probed, _PROBED).collect()), key=lambda r: paths.index(r["path"]) if len(paths) < 1000 else r["path"])


def _load(spark: SparkSession, path, split: int, columns: list[str], strict: bool, files: list[dict] | None) -> DataFrame:
    spark.dataSource.register(BamDataSource)
    files = probe(spark, path) if files is None else files
    bad = [f["error"] for f in files if f["error"] is not None]
    if strict and bad:
        raise ValueError(bad[0])
    push = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    return spark.read.format("bam").options(files=json.dumps(files), split=split, columns=",".join(columns), strict=str(strict).lower(), push=push).load()


COLUMNS = [c.strip().split(" ")[0] for c in ALIGNMENTS.replace("op:string,len", "op;len").split(",")]


def read_bam(spark: SparkSession, path: str | list[str], split: int = SPLIT, columns: list[str] | None = None, files: list[dict] | None = None) -> DataFrame:
    """Records of BAM files, of model.ALIGNMENTS the columns asked for. Damage of any kind raises, and names the place. files: what probe() found, if it is at hand."""
    return _load(spark, path, split, columns or COLUMNS, True, files)


def scan_bam(spark: SparkSession, path: str | list[str], split: int = SPLIT, columns: list[str] | None = None, files: list[dict] | None = None) -> DataFrame:
    """As read_bam(), but damage gives rows: of those only sample_id and gap are set.

    gap.offset is a place in the file. Without gap.within, length bytes of the file from there on could not be read; with it, so many bytes of what the block at offset and those
    behind it inflate to, from place within on. A missing closing block has length 0."""
    return _load(spark, path, split, [*(columns or COLUMNS), "gap"], False, files)


def bam_refs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ref_name, ref_id from the first file's header; all files of one run have the same ones."""
    first = paths_of(path)[0]
    with open_file(first) as f:
        names = Header(first, f, file_size(first)).names
    return spark.createDataFrame(list(enumerate(names)), "ref_id int, ref_name string").select("ref_name", "ref_id")


def bam_samples(spark: SparkSession, files: list[dict]) -> DataFrame:
    """sample_id, unmarked (the first record has no NH) of each file that probe() found."""
    return spark.createDataFrame([(f["sample_id"], not f["marked"]) for f in files if f["marked"] is not None], "sample_id string, unmarked boolean")


def block_of(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(path: str, refs: list[tuple[str, int]], records: list[tuple], block: int = 60_000) -> None:
    """A small BAM file, for tests and examples. records: (qname, flag, ref_id, pos, [(op, len)], mref, mpos, isize, l_seq, nh or None)."""
    text = "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in refs).encode()
    data = bytearray(b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)))
    for n, k in refs:
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    with open(path, "wb") as f:
        for qname, flag, ref, pos, ops, mref, mpos, isize, l_seq, nh in records:
            name = qname.encode() + b"\0"
            body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 0, 0, len(ops), flag, l_seq, mref, mpos, isize) + name
            body += b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for o, n in ops) + b"\x11" * ((l_seq + 1) // 2) + b"\xff" * l_seq
            body += b"" if nh is None else b"XSA+" + b"NHC" + bytes([nh])
            data += struct.pack("<i", len(body)) + body
            while len(data) >= block:
                f.write(block_of(bytes(data[:block])))
                del data[:block]
        if data:
            f.write(block_of(bytes(data)))
        f.write(CLOSING)
