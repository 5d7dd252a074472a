"""SentencePiece encoding with sampled segmentations, and lossless decoding.

The pieces of a vocabulary that match a text form a lattice over its characters. A segmentation is a path, its weight the product of its pieces'
weights. Forward filtering sums the weights of all paths to each place; backward sampling draws the last piece in proportion to what it adds,
then the one before it, and so on: an exact draw of a whole path. No piece continues past a space mark, so the lattice falls apart into
units (a run of spaces and what follows), whose sums are computed once for each distinct unit and drawn from at each occurrence, all units
of a chunk side by side; a unit of more than LONG characters is walked by itself and keeps one number a character. Random numbers come from a hash of the row's key, the unit's number and the step, so a row's segmentation
depends on nothing but its key and text. Characters without a piece become byte pieces, as does a space mark that stands in the text itself.
Piece files give ranks, not probabilities: a piece's weight is (rank + RANK_SHIFT) ** -alpha.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spliceframe.llm.common import mix, release

ALPHA, RANK_SHIFT, CHUNK_CHARS, UNKNOWN, LONG = 1.0, 10.0, 600_000, 1e-9, 256
_MARK, _LITERAL = "▁", "\ud800"  # the second stands for a mark of the text itself: no valid text holds a lone surrogate
_UNIT = re.compile(f"{_MARK}+[^{_MARK}]*|[^{_MARK}]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def default_model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@dataclass
class Vocabulary:
    ids: dict[str, int]
    weights: np.ndarray
    bytes_of: list[bytes]
    byte_ids: list[int]
    #: By length of piece: a hash table of 2 ** bits slots, with a piece's hash and its id (-1: none); pieces whose slot is taken stand in a dict.
    tables: dict[int, tuple[np.ndarray, np.ndarray, dict[int, int]]]
    bits: int = 18


_loaded: dict[tuple[str, float], Vocabulary] = {}


def load(path: str | None = None, alpha: float = ALPHA) -> Vocabulary:
    """The vocabulary of a piece file, once for each worker. Control, unknown and unused pieces take no part."""
    path = path or default_model_path()
    if (path, alpha) not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        ids, byte_ids, bytes_of, rank = {}, [-1] * 256, [b""] * n, 0
        weights = np.zeros(n)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                rank += 1
                ids[piece], weights[i], bytes_of[i] = i, (rank + RANK_SHIFT) ** -alpha, piece.replace(_MARK, " ").encode()
        assert all(_MARK not in p.lstrip(_MARK) for p in ids) and min(byte_ids) >= 0, "units need marks at the start of pieces only, and byte pieces"
        _loaded[path, alpha] = Vocabulary(ids, weights, bytes_of, byte_ids, _tables(ids))
    return _loaded[path, alpha]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _next_hash(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (h ^ (code + _GOLD)) * np.uint64(0xD6E8FEB86659FD93)


def _tables(ids: dict[str, int], bits: int = 18) -> dict:
    out: dict = {}
    for piece, i in ids.items():
        h = np.zeros(1, np.uint64)
        for c in _codes(piece):
            h = _next_hash(h, c)
        slots, found, more = out.setdefault(len(piece), (np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), {}))
        at = int(h[0] >> np.uint64(64 - bits))
        if found[at] < 0:
            slots[at], found[at] = h[0], i
        else:
            more[int(h[0])] = i
    return out


def _matches(codes: np.ndarray, left: np.ndarray, v: Vocabulary):
    """For each length: places where a piece of it begins, and the piece. left: characters from a place to the end of its unit."""
    h, at = np.zeros(len(codes), np.uint64), np.arange(len(codes))
    for n in range(1, max(v.tables) + 1):
        keep = left[at] >= n
        at, h = at[keep], h[keep]
        if not len(at):
            return
        h = _next_hash(h, codes[at + n - 1])
        if n in v.tables:
            slots, found, more = v.tables[n]
            slot = h >> np.uint64(64 - v.bits)
            hit = slots[slot] == h
            piece = np.where(hit, found[slot], -1)
            if more:
                odd = np.flatnonzero(~hit & (found[slot] >= 0))
                piece[odd] = [more.get(int(x), -1) for x in h[odd]]
            ok = piece >= 0
            yield n, at[ok], piece[ok]


def lattices(units: list[str], v: Vocabulary) -> tuple[np.ndarray, ...]:
    """Forward sums of all units. Edges in order of the node they lead to: running share of the weight that reaches it; the first edge of each node; piece,
    node they come from; and each unit's first and last node. A negative piece is -1 - c for a character c that no piece covers."""
    lens = np.array([len(u) for u in units])
    codes = _codes("".join(units))
    ends = np.cumsum(lens)
    starts = ends - lens
    unit = np.repeat(np.arange(len(units)), lens)
    first = starts + np.arange(len(units))  # a unit of n characters has n + 1 nodes
    node = np.arange(len(codes)) + unit  # in front of each character
    src, dst, piece, weight, covered = [], [], [], [], np.zeros(len(codes), bool)
    for n, at, p in _matches(codes, ends[unit] - np.arange(len(codes)), v):
        src.append(node[at])
        dst.append(node[at] + n)
        piece.append(p)
        weight.append(v.weights[p])
        if n == 1:
            covered[at] = True
    bare = np.flatnonzero(~covered)
    src.append(node[bare])
    dst.append(node[bare] + 1)
    piece.append(-1 - codes[bare].astype(np.int64))
    weight.append(np.full(len(bare), UNKNOWN))
    src, dst, piece, weight = np.concatenate(src), np.concatenate(dst), np.concatenate(piece).astype(np.int32), np.concatenate(weight)
    order = np.argsort(dst, kind="stable")
    src, dst, piece, weight = src[order], dst[order], piece[order], weight[order]
    # Nodes at one distance from their unit's start are summed side by side. Each sum is kept as a logarithm, so long units don't run out of range.
    total = len(codes) + len(units)
    scale = np.zeros(total)
    depth = dst - first[np.repeat(np.arange(len(units)), lens + 1)[dst]]
    by_depth = np.argsort(depth, kind="stable")
    stops = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max()) + 2)) if len(depth) else []
    value = np.zeros(len(src))
    for lo, hi in zip(stops[:-1], stops[1:]):
        e = by_depth[lo:hi]
        new = np.flatnonzero(np.concatenate([[True], dst[e][1:] != dst[e][:-1]]))
        to = dst[e][new]
        ref = scale[src[e]]
        top = np.maximum.reduceat(ref, new)
        x = weight[e] * np.exp(ref - np.repeat(top, np.diff(np.append(new, len(e)))))
        s = np.add.reduceat(x, new)
        value[e] = x / np.repeat(s, np.diff(np.append(new, len(e))))
        scale[to] = top + np.log(s)
    # Running shares begin anew at each node, in the order of its edges, so that they depend on the unit alone.
    head = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])[: len(dst)])
    size = np.diff(np.append(head, len(dst)))
    share = value.copy()
    at, left = head, size
    while (more := left > 1).any():
        at, left = at[more] + 1, left[more] - 1
        share[at] += share[at - 1]
    share[head + size - 1] = 1.0
    begin = np.zeros(total + 1, np.int64)
    begin[dst[head] + 1] = size
    return share, np.cumsum(begin), piece, src, first, first + lens


def _edges(unit: str, at: int, v: Vocabulary) -> list[tuple[int, int, float]]:
    """Pieces that end at a place, shortest first, where they begin, and their weights; a character without a piece as in lattices()."""
    out = []
    for start in range(at - 1, max(at - max(v.tables), 0) - 1, -1):
        p = v.ids.get(unit[start:at])
        if p is not None:
            out.append((p, start, float(v.weights[p])))
        elif start == at - 1:
            out.append((-1 - ord(unit[start]), start, UNKNOWN))
    return out


def _sums(unit: str, v: Vocabulary) -> array:
    """Logarithm of the summed weights of all paths to each place of a long unit."""
    sums = array("d", [0.0])
    for at in range(1, len(unit) + 1):
        edges = _edges(unit, at, v)
        top = max(sums[start] for _, start, _ in edges)
        sums.append(top + math.log(sum(w * math.exp(sums[start] - top) for _, start, w in edges)))
    return sums


_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    x &= _MASK
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & _MASK
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & _MASK
    return x ^ (x >> 33)


def _walk(unit: str, sums: array, seed: int, v: Vocabulary) -> list[int]:
    """A path through a long unit, drawn from its end with the same random numbers as any other."""
    at, step, out = len(unit), 0, []
    while at:
        step += 1
        left = (_mix(seed + step * int(_GOLD)) >> 11) * 2.0**-53
        for piece, start, w in (edges := _edges(unit, at, v)):
            left -= w * math.exp(sums[start] - sums[at])
            if left < 0:
                break
        else:
            piece, start, _ = edges[-1]
        out.append(piece)
        at = start
    return out[::-1]


def encode_many(texts: list[str | None], keys: np.ndarray, v: Vocabulary) -> list[np.ndarray]:
    """Sampled piece ids of each text; keys: one unsigned 64-bit number for each."""
    seen: dict[str, int] = {}
    units, counts, long = [], [], {}
    for t in texts:
        raw = (t or "").replace(_MARK, _LITERAL).replace(" ", _MARK)
        own = _UNIT.findall(raw)
        long.update((len(units) + i, u) for i, u in enumerate(own) if len(u) > LONG)
        units += [seen.setdefault(u, len(seen)) if len(u) <= LONG else -1 for u in own]
        counts.append(len(own))
    if not units:
        return [np.zeros(0, np.int32) for _ in texts]
    unit, counts = np.array(units), np.array(counts)
    number = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
    seed = mix(np.repeat(keys, counts) + number.astype(np.uint64) * _GOLD)
    lengths, steps = np.zeros(len(unit), np.int64), []
    if seen:
        share, begin, piece, origin, starts, ends = lattices(list(seen), v)
        active = np.flatnonzero(unit >= 0)
        node = ends[unit[active]]
        while len(active):
            u = (mix(seed[active] + np.uint64((len(steps) + 1) * int(_GOLD) & _MASK)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e, open_ = begin[node], np.arange(len(node))  # a node has as many edges as lengths of pieces at most
            while len(open_):
                open_ = open_[share[e[open_]] <= u[open_]]
                e[open_] += 1
            steps.append((active, piece[e]))
            lengths[active] += 1
            node = origin[e]
            more = node != starts[unit[active]]
            node, active = node[more], active[more]
    sums = {u: _sums(u, v) for u in set(long.values())}
    walked = {i: _walk(u, sums[u], int(seed[i]), v) for i, u in long.items()}
    for i, path in walked.items():
        lengths[i] = len(path)
    stop = np.cumsum(lengths)
    ids = np.zeros(int(stop[-1]), np.int32)
    for k, (who, p) in enumerate(steps):
        ids[stop[who] - 1 - k] = p
    for i, path in walked.items():
        ids[stop[i] - len(path) : stop[i]] = path
    bounds = np.concatenate([[0], stop])[np.cumsum(counts)]
    return [_with_bytes(x, v) for x in np.split(ids, bounds[:-1])]


def _with_bytes(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Characters without a piece as the byte pieces of their UTF-8 form."""
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids
    forms = {c: np.array([v.byte_ids[b] for b in (_MARK if chr(-1 - c) == _LITERAL else chr(-1 - c)).encode("utf-8", "surrogatepass")], np.int32) for c in set(ids[bare].tolist())}
    parts, at = [], 0
    for i in bare:
        parts += [ids[at:i], forms[int(ids[i])]]
        at = i + 1
    return np.concatenate([*parts, ids[at:]])


def decode(ids, v: Vocabulary) -> bytes:
    return b"".join(map(v.bytes_of.__getitem__, np.asarray(ids).tolist()))


def chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Start and length of runs of texts of about CHUNK_CHARS in all, so that memory follows the chunk and not the batch."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= CHUNK_CHARS or i + 1 == len(sizes):
            yield start, i + 1 - start
            start, held = i + 1, 0


def encoder(path: str | None = None, alpha: float = ALPHA, with_ids: bool = True):
    """A column function of key (long) and text: n_pieces, n_bytes that fell back to byte pieces, lossless (whether decoding gives the text back), ids_sha256, and the ids."""
    import hashlib

    @arrow_udf("struct<n_pieces:long,lossless:boolean,ids_sha256:string,piece_ids:array<int>>")
    def encode(key: pa.Array, text: pa.Array) -> pa.Array:
        release()  # what the batch before has left
        v, out, lists = load(path, alpha), [], []
        keys = key.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for at, n in chunks(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
            texts = text.slice(at, n).to_pylist()
            coded = encode_many(texts, keys[at : at + n], v)
            out += [(len(ids), decode(ids, v) == (t or "").encode("utf-8", "surrogatepass"), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()) for t, ids in zip(texts, coded)]
            lists.append(pa.array(coded, pa.list_(pa.int32())) if with_ids else pa.nulls(n, pa.list_(pa.int32())))
        return pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.string()), pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))], ["n_pieces", "lossless", "ids_sha256", "piece_ids"])

    return encode


def decoder(path: str | None = None):
    """A column function from piece ids to text."""

    @arrow_udf("string")
    def back(ids: pa.Array) -> pa.Array:
        v = load(path)
        return pa.array([None if x is None else decode(x, v).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return back


def encode_documents(docs: DataFrame, path: str | None = None, alpha: float = ALPHA, with_ids: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_pieces, lossless, ids_sha256, piece_ids for each row.

    A row's key is the hash of its doc_id, so reruns, other partitions and rows that repeat a doc_id and text get the same segmentation. Null and empty
    texts have no pieces. alpha 0 weighs all pieces alike, large alpha nears the single best path."""
    e = encoder(path, alpha, with_ids)(F.xxhash64("doc_id"), F.col("text"))
    return docs.select("doc_id", e.alias("e")).select("doc_id", "e.n_pieces", "e.lossless", "e.ids_sha256", "e.piece_ids")
