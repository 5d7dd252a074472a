"""WARC archives: a writer of per-record gzip members with revisits, and a reader that salvages damaged archives.

Each task writes its own archive into the shared folder under a name of its attempt, and reports it when it is closed; only
reported archives are read, so a lost task leaves nothing that counts. The reader deals archives out in byte ranges. A range owns the
records that begin in it and finds the first by searching for a valid member or version line, which is also how it goes on
after damage. What lies between is returned as a gap with its bytes and the reason. Records are checked piece by piece: a task holds a window of a few
CHUNKs and one header, and a payload only if payloads are asked for. A plain record's end is looked at before its block is read, so a damaged length costs no reading.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceframe.llm.common import Workspace

LEAST_REVISIT, RANGE_BYTES, ARCHIVE_BYTES, CHUNK = 100, 32 << 20, 256 << 20, 1 << 20
#: A header of more bytes counts as damage. A member may inflate to any size, but where payloads are returned, as one value of a row, to MEMBER_BYTES at most.
HEADER_BYTES, MEMBER_BYTES = 64 << 20, 1 << 31
DATE = "2024-01-01T00:00:00Z"
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_RECORD = "path string, offset long, length long, kind string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary, reason string"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the full payload's length, and leaves out the payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _writer(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base)
        out, size, n, name = None, 0, 0, ""
        for pdf in batches:
            for page_id, url, html, digest, refers_to in zip(*(pdf[c] for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = _member(record_bytes(None if pd.isna(page_id) else int(page_id), url, (html or "").encode("utf-8", "surrogatepass"), digest, None if pd.isna(refers_to) else int(refers_to)))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [f"{root}/{name}"], "bytes": [size], "records": [n]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{root}/{name}"], "bytes": [size], "records": [n]})

    return run


def write_archives(pages: DataFrame, ws: Workspace) -> DataFrame:
    """pages(page_id, url, html, ...) -> path, bytes, records of the archives written into the shared folder.

    A payload is the html in UTF-8, null as empty. Among records with equal payloads of at least LEAST_REVISIT bytes the least page_id is the
    response and the others revisit it; rows that repeat that page_id are responses too. A null page_id comes after all others."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256).alias("digest"))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= LEAST_REVISIT
    shared = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    rows = rows.join(shared, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")
    return ws.save(rows.mapInPandas(_writer(ws.path("warc")), "path string, bytes long, records long"), "archives")


class _Bytes:
    """A window over a file that grows forward on demand and may forget what lies before floor; a place that it has forgotten is read anew."""

    def __init__(self, f, size: int, at: int):
        self.f, self.size, self.base, self.buf, self.floor = f, size, at, bytearray(), at
        f.seek(at)

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from at on; fewer only at the end of the file."""
        if not self.base <= at <= self.base + len(self.buf):
            self.base, self.buf = at, bytearray()
            self.f.seek(at)
        if self.floor - self.base > 4 * CHUNK:
            drop = min(self.floor, at) - self.base
            del self.buf[:drop]
            self.base += drop
        while self.base + len(self.buf) < min(at + n, self.size):
            more = self.f.read(max(CHUNK, at + n - self.base - len(self.buf)))
            if not more:
                break
            self.buf += more
        return bytes(self.buf[at - self.base : at - self.base + n])

    def peek(self, at: int, n: int) -> bytes:
        """n bytes from elsewhere; the window stays where it is."""
        self.f.seek(at)
        out = self.f.read(n)
        self.f.seek(self.base + len(self.buf))
        return out

    def pieces(self, at: int) -> Iterator[bytes]:
        """What follows from at on: a short piece, then longer ones. What has been given may be forgotten."""
        n = 1 << 16
        while piece := self.get(at, n):
            yield piece
            at, n = at + len(piece), CHUNK
            self.floor = at


class _Record:
    """A record that is taken in piece by piece. Of its payload it holds the digest and length, and the bytes only if they are kept."""

    def __init__(self, keep: bool):
        self.keep, self.raw, self.head, self.length, self.left, self.tail = keep, bytearray(), None, 0, 0, b""
        self.top, self.parts, self.n, self.sha = bytearray(), [], 0, None  # top: the block's begin, until it is known where the payload starts

    def feed(self, piece: bytes) -> bytes:
        """Takes what belongs to the record and returns what follows it."""
        if self.head is None:
            seen = len(self.raw)
            self.raw += piece
            end = self.raw.find(b"\r\n\r\n", max(0, seen - 3))
            if end < 0:
                if len(self.raw) > HEADER_BYTES:
                    raise ValueError(f"header of more than {HEADER_BYTES} bytes")
                return b""
            lines = self.raw[:end].decode("utf-8", "replace").split("\r\n")
            head = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}
            n = head.get("content-length", "")
            if not self.raw.startswith(_VERSION) or not re.fullmatch("[0-9]{1,18}", n) or "warc-type" not in head:
                raise ValueError("not one whole record")
            self.head, self.left, self.length = head, int(n), end + 8 + int(n)
            piece, self.raw = bytes(self.raw[end + 4 :]), bytearray()
        block, rest = piece[: self.left], piece[self.left :]
        self.left -= len(block)
        if block:
            self._block(block)
        if not self.left:
            need = 4 - len(self.tail)
            self.tail, rest = self.tail + rest[:need], rest[need:]
        return rest

    def _block(self, piece: bytes) -> None:
        if self.sha is not None:
            return self._payload(piece)
        seen = len(self.top)
        self.top += piece
        http = self.top.startswith(b"HTTP/") or b"HTTP/".startswith(self.top)
        end = self.top.find(b"\r\n\r\n", max(0, seen - 3)) if http and len(self.top) > 5 else -1
        if end >= 0:
            self._split(end + 4)
        elif not http or len(self.top) > HEADER_BYTES:
            self._split(0)

    def _split(self, at: int) -> None:
        self.sha, rest = hashlib.sha256(), bytes(self.top[at:])
        del self.top[at:]
        self._payload(rest)

    def _payload(self, piece: bytes) -> None:
        self.sha.update(piece)
        self.n += len(piece)
        if self.keep and self.head["warc-type"] != "revisit":
            if self.n > MEMBER_BYTES:
                raise ValueError(f"payload of more than {MEMBER_BYTES} bytes")
            self.parts.append(piece)

    def whole(self) -> tuple[dict, bytes, int]:
        """Header fields, payload (empty if it isn't kept, or of a revisit) and the payload's full length; raises ValueError if the record isn't whole or its digest doesn't hold."""
        if self.head is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("not one whole record")
        if self.sha is None:
            self._split(0)
        if self.head["warc-type"] == "revisit":
            m = re.search(rb"(?i)\ncontent-length:\s*(\d+)", self.top)
            return self.head, b"", int(m[1]) if m else 0
        declared = self.head.get("warc-payload-digest", "")
        if declared.startswith("sha256:") and self.sha.hexdigest() != declared[7:]:
            raise ValueError("payload digest differs")
        return self.head, b"".join(self.parts), self.n


def _inflate(win: _Bytes, at: int, record: _Record) -> int:
    """Feeds the member at a place to a record and returns its length; raises zlib.error if it is damaged or cut off."""
    z, read, out = zlib.decompressobj(31), 0, 0
    for piece in win.pieces(at):
        read += len(piece)
        while piece and not z.eof:
            part = z.decompress(piece, CHUNK)
            out, piece = out + len(part), z.unconsumed_tail
            if record.keep and out > MEMBER_BYTES:
                raise zlib.error(f"inflates to more than {MEMBER_BYTES} bytes")
            if record.feed(part):
                raise ValueError("not one whole record")
        if z.eof:
            return read - len(z.unused_data)
    raise zlib.error("cut off")


def _starts(win: _Bytes, at: int) -> bool:
    """Whether a record seems to begin here: a version line, or a member that inflates to one."""
    head = win.get(at, 4096)
    if head.startswith(_VERSION):
        return bool(re.match(rb"WARC/1\.\d\r\n", head))
    if not head.startswith(_MAGIC):
        return False
    try:
        return zlib.decompressobj(31).decompress(head, 16).startswith(_VERSION)
    except zlib.error:
        return False


def _search(win: _Bytes, at: int) -> int:
    """The next place from at on where a record seems to begin, or the end of the file."""
    while at < win.size:
        win.floor = at
        piece = win.get(at, CHUNK)
        if not piece:
            return win.size
        for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.", piece):
            if _starts(win, at + m.start()):
                return at + m.start()
        if at + len(piece) >= win.size:
            return win.size
        at += max(1, len(piece) - len(_VERSION))
    return win.size


def _one(win: _Bytes, at: int, keep: bool) -> tuple[dict, bytes, int, int]:
    """The record at a place, checked: header fields, payload, its full length, and the record's length in the file; raises ValueError or zlib.error."""
    begin, record = win.get(at, 8), _Record(keep)
    if begin.startswith(_MAGIC):
        length = _inflate(win, at, record)
        return *record.whole(), length
    if not begin.startswith(_VERSION):
        raise ValueError("no record here")
    known = False
    for piece in win.pieces(at):
        record.feed(piece)
        if record.head and not known:
            known, end = True, at + record.length
            if end > win.size or end > win.base + len(win.buf) and win.peek(end - 4, 4) != b"\r\n\r\n":
                raise ValueError("not one whole record")
        if record.head and not record.left and len(record.tail) == 4:
            break
    return *record.whole(), record.length


def salvage(f, size: int, start: int, end: int, keep: bool = True) -> Iterator[tuple]:
    """Records that begin in [start, end) as (offset, length, head, payload, payload_bytes, ""), and gaps as (offset, length, None, None, 0, reason). Payloads are empty unless they are kept."""
    win = _Bytes(f, size, start)
    at = start if start == 0 else _search(win, start)
    seen = False
    while at < min(end, size):
        win.floor, seen = at, True
        try:
            head, payload, n, length = _one(win, at, keep)
            yield at, length, head, payload, n, ""
            at += length
        except (ValueError, zlib.error) as e:
            win.floor = at
            on = _search(win, at + 1)
            yield at, on - at, None, None, 0, str(e)
            at = on
    else:
        # What follows the range's last record is its own if nothing seems to begin there: the next range would search past it.
        if end <= at < size and (start == 0 or seen) and not _starts(win, at):
            yield at, _search(win, at + 1) - at, None, None, 0, "no record here"


def _reader(with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, size, start in zip(pdf["path"], pdf["bytes"], pdf["start"]):
                fs, name = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for at, length, head, payload, n, reason in salvage(f, size, start, start + RANGE_BYTES, with_payload):
                        if head is None:
                            rows.append((path, at, length, "gap", None, None, None, 0, None, None, reason))
                        else:
                            digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
                            rows.append((path, at, length, head["warc-type"], head.get("warc-record-id"), head.get("warc-target-uri"), digest, n, head.get("warc-refers-to"), payload if with_payload else None, None))
                        held += len(payload or b"") + 500
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RECORD.split(", ")])
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RECORD.split(", ")])

    return run


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """archives(path, bytes) -> one row for each record (kind: its WARC-Type) and each quarantined gap (kind: gap, with its reason), with offset and length in the file.

    Reads gzip members and plain records. A damaged, cut-off or mismatching record becomes a gap that reaches to the next record found; an archive of
    zero bytes gives no rows."""
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(RANGE_BYTES).cast("long"))).alias("start"))
    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(parts).mapInPandas(_reader(with_payload), _RECORD)


def archive_pages(pages: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """Writes pages and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to for each record. A gap in what was just written raises."""
    ws = ws or Workspace(pages.sparkSession, "archives")
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:x-page:(-?\d*)>$", 1), F.lit("")).cast("long")
    whole = F.when(F.col("kind") == "gap", F.raise_error(F.concat(F.col("path"), F.lit(" is damaged at "), F.col("offset").cast("string"), F.lit(": "), F.col("reason")))).otherwise(F.col("kind"))
    return read_archives(write_archives(pages, ws)).withColumn("kind", whole).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))


def archive_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The archives at given paths, with their sizes."""
    found = []
    for p in paths:
        fs, name = pafs.FileSystem.from_uri(p)
        found.append((p, fs.get_file_info(name).size))
    return spark.createDataFrame(found, "path string, bytes long")
