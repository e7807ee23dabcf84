"""Suffix-array dedup: bytes of passages that also start in an earlier document.

Every 50-byte window belongs to one anchor: of the 26 k-grams (25 bytes) inside it, the leftmost one
of least hash. Equal windows have equal anchors at equal places, so windows only have to be compared
where their anchors are shared. The steps, all between hash partitions of document chunks and anchor
buckets:

1. chunks send the hashes of their anchors to buckets (compact lists, not rows);
2. buckets tell chunks which anchors are shared with another chunk or repeat in the chunk;
3. chunks send, once each, the distinct segments (all windows of an anchor) around shared anchors,
   with the smallest document id that holds them: a thousand copies are one segment per chunk;
4. a bucket sorts the windows of an anchor's different segments as suffixes, those of a hash that no other window at
   their place has left out, as they equal none. The mergesort compares
   by prefix polynomial hashes: a binary search over the length finds the common extension of two
   suffixes in six steps. Neighbours with a common extension of 50 bytes are one class, verified byte
   by byte, and the class has the smallest document id;
5. chunks mark the bytes of windows whose class has a smaller id than the document.

The documents are shuffled once (the exchange is reused by all three chunk steps). Chunks and buckets
exchange arrays of plain numbers; a pair of them without a common anchor exchanges nothing, so rows never outnumber anchors.
Segments are told apart by 64-bit identities, which are checked byte by byte wherever two of them are taken for one.
An anchor's different segments meet in one task, where they are sorted in parts of bounded size: equal windows have equal hashes and so are in the same part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import as_bytes, blocks_of, mixed, POWERS, prefix_hashes, ranges, span_hashes, tidied_group
from docforge.plans.tables import bounded_arrow

WINDOW, K = 50, 25
W = WINDOW - K + 1
#: Bytes of text of a chunk of documents.
CHUNK_BYTES = 6 << 20
#: Bytes of text whose anchors are found at once: the arrays of so many k-grams stay in a processor's cache.
ANCHOR_BYTES = 1 << 17
#: Segments that a bucket sorts at once, and windows of a part of a larger anchor group.
SORTED_SEGMENTS, SORTED_WINDOWS = 30_000, 200_000
#: What chunks and buckets exchange: the arrays of a blob and their types.
HASHES = (("h", "<u4"), ("many", "u1"))
SHARED = (("h", "<u4"),)
SEGMENTS = (("h", "<u4"), ("sid", "<u8"), ("left", "u1"), ("size", "u1"), ("least", "<i8"), ("many", "u1"), ("text", "u1"))
RUNS = (("h", "<u4"), ("sid", "<u8"), ("runs", "u1"), ("n", "u1"), ("least", "<i8"))
#: Blobs of more bytes are compressed.
PLAIN_BYTES = 256
_C1, _C2, _C3 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


class Anchors:
    """The anchors of concatenated texts: place, first and last window, hash, and identity of the segment."""

    __slots__ = ("code", "hi", "lo", "place", "sid")

    def __init__(self, data: np.ndarray, at: np.ndarray, buckets: int) -> None:
        parts = [x for a, b in blocks_of(np.diff(at), ANCHOR_BYTES) if at[b] - at[a] >= WINDOW for x in [self._block(data[at[a] : at[b]], at[a : b + 1] - at[a], int(at[a]))]]
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        self.place, self.lo, self.hi, h, self.sid = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
        #: The bucket in the upper half, the hash within it in the lower.
        self.code = (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)

    @staticmethod
    def _block(x: np.ndarray, at: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
        n = len(x)
        prefix = prefix_hashes(x)
        _, down = POWERS.upto(n + 1)
        g = mixed((prefix[K:] - prefix[:-K]) * down[: n - K + 1])
        bits = np.uint64((1 << max(20, n.bit_length())) - 1)
        m = (g & ~bits) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while width * 2 <= W:  # least key of 2, 4, 8, 16 k-grams, and then of W
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < W:
            m = np.minimum(m[: width - W], m[W - width :])
        a = (m & bits).astype(np.int64)
        valid = np.zeros(len(a) + 1, np.int32)
        long = np.diff(at) >= WINDOW
        np.add.at(valid, at[:-1][long], 1)
        np.add.at(valid, at[1:][long] - WINDOW + 1, -1)
        valid = np.cumsum(valid[:-1]) > 0
        cut = np.flatnonzero((a[1:] != a[:-1]) | (valid[1:] != valid[:-1])) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]]) - 1
        lo, hi = lo[valid[lo]], hi[valid[lo]]
        place = a[lo]
        span = (prefix[hi + WINDOW] - prefix[lo]) * down[lo]
        sid = mixed(span ^ (place - lo).astype(np.uint64) * _C1 ^ (hi - lo).astype(np.uint64) * _C2)
        return place + base, lo + base, hi + base, mixed(g[place] ^ _C3), sid


def _texts(table: pa.Table, only_known: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a chunk's texts; without those that have no id, unless asked."""
    ids = table.column("__doc_id").combine_chunks()
    text = as_bytes(table.column("__text"))
    if only_known and ids.null_count:
        text, ids = text.filter(ids.is_valid()), ids.drop_null()
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return ids.fill_null(-(1 << 63)).to_numpy(), data, at - at[0]


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One compressor and decompressor of a worker: a blob is often smaller than what making them costs."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(fields: tuple[tuple[str, str], ...], **arrays: np.ndarray) -> bytes:
    """Arrays of known types as bytes: their lengths, then each one's bytes by planes."""
    own = [np.ascontiguousarray(arrays[name].astype(kind, copy=False)) for name, kind in fields]
    planes = [x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() for x in own]
    raw = np.array([len(x) for x in own], "<u4").tobytes() + b"".join(planes)
    return b"\0" + raw if len(raw) <= PLAIN_BYTES else b"\1" + _zstd()[0].compress(raw)


def unpacked(fields: tuple[tuple[str, str], ...], value) -> dict[str, np.ndarray]:
    view = memoryview(value)
    raw = view[1:] if view[0] == 0 else _zstd()[1].decompress(view[1:])
    out, at = {}, 4 * len(fields)
    for (name, kind), n in zip(fields, np.frombuffer(raw, "<u4", len(fields)).tolist(), strict=True):
        wide = np.dtype(kind).itemsize
        own = np.frombuffer(raw, np.uint8, n * wide, at)
        out[name] = np.ascontiguousarray(own.reshape(wide, n).T).view(kind).ravel() if n else np.zeros(0, kind)
        at += n * wide
    return out


def checked(data: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> None:
    """Raise unless segment at[i] has the same bytes as segment at[i] - 1 (places in start and size)."""
    if not np.array_equal(size[at], size[at - 1]):
        raise RuntimeError(COLLISION)
    for a in range(0, len(at), 1 << 15):
        k = at[a : a + (1 << 15)]
        if not np.array_equal(data[ranges(start[k], size[k])], data[ranges(start[k - 1], size[k])]):
            raise RuntimeError(COLLISION)


COLLISION = "two segments with one identity differ: choose another base of the prefix hashes"


def _one(table: pa.Table, name: str):
    return table.column(name)[0].as_py()


_A = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])
_B = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
_SQL = {"A": "bucket int, chunk int, blob binary", "B": "chunk int, bucket int, blob binary"}


def _by_bucket(code: np.ndarray) -> list[tuple[int, slice]]:
    b = (code >> np.uint64(32)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]) if len(b) else np.zeros(1, np.int64)
    return [(int(b[s]), slice(int(s), int(e))) for s, e in zip(cut[:-1], cut[1:], strict=True)]


def _send_hashes(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        _, data, at = _texts(table)
        code, count = np.unique(Anchors(data, at, buckets).code, return_counts=True)
        chunk = _one(table, "__chunk")
        rows = [(b, chunk, packed(HASHES, h=np.diff((code[s] & np.uint64(0xFFFFFFFF)).astype(np.int64), prepend=0), many=np.packbits(count[s] > 1))) for b, s in _by_bucket(code)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ([],) * 3, _A.types, strict=True)], schema=_A)

    return run


def _share(table: pa.Table) -> pa.Table:
    """In a bucket: for each chunk, the anchors that another chunk has too or that repeat in the chunk."""
    chunks = table.column("chunk").to_pylist()
    h, many = [], []
    for blob in table.column("blob"):
        x = unpacked(HASHES, blob.as_buffer())
        h.append(np.cumsum(x["h"].astype(np.int64)).astype(np.uint32))
        many.append(np.unpackbits(x["many"], count=len(h[-1])).astype(bool))
    row = np.repeat(np.arange(len(h)), [len(x) for x in h])
    hs, shared = np.concatenate(h), np.concatenate(many)
    order = np.argsort(hs, kind="stable")
    same = hs[order][1:] == hs[order][:-1]
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    at = np.searchsorted(row, np.arange(len(h) + 1))
    rows = []
    for i, c in enumerate(chunks):
        own = hs[at[i] : at[i + 1]][shared[at[i] : at[i + 1]]]
        if len(own):
            rows.append((c, _one(table, "bucket"), packed(SHARED, h=np.diff(own.astype(np.int64), prepend=0))))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ([],) * 3, _B.types, strict=True)], schema=_B)


def _send_segments(buckets: int):
    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows or not shared.num_rows:
            return _A.empty_table()
        ids, data, at = _texts(table)
        x = Anchors(data, at, buckets)
        known = []
        for b, blob in zip(shared.column("bucket").to_pylist(), shared.column("blob"), strict=True):
            known.append(np.cumsum(unpacked(SHARED, blob.as_buffer())["h"].astype(np.int64)).astype(np.uint64) | np.uint64(b) << np.uint64(32))
        known = np.sort(np.concatenate(known))
        spot = np.minimum(np.searchsorted(known, x.code), len(known) - 1)
        c = np.flatnonzero(known[spot] == x.code)
        c = c[np.lexsort((x.sid[c], x.code[c]))]
        new = np.flatnonzero(np.concatenate([[True], (x.sid[c][1:] != x.sid[c][:-1]) | (x.code[c][1:] != x.code[c][:-1])])) if len(c) else c
        if not len(new):
            return _A.empty_table()
        size = x.hi - x.lo + WINDOW
        again = np.ones(len(c), bool)
        again[new] = False
        checked(data, x.lo[c], size[c], np.flatnonzero(again))
        doc = ids[np.searchsorted(at, x.lo[c], side="right") - 1]
        least, most = np.minimum.reduceat(doc, new), np.maximum.reduceat(doc, new)
        u = c[new]
        size, lo, left, code, sid, many = size[u], x.lo[u], x.place[u] - x.lo[u], x.code[u], x.sid[u], least != most
        h = code & np.uint64(0xFFFFFFFF)
        chunk, rows = _one(table, "__chunk"), []
        for b, s in _by_bucket(code):  # only slices in here: there are as many buckets as half the chunks
            rows.append((b, chunk, packed(SEGMENTS, h=h[s], sid=sid[s], left=left[s], size=size[s], least=least[s], many=many[s], text=data[ranges(lo[s], size[s])])))
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _A.types, strict=True)], schema=_A)

    return run


class Suffixes:
    """Windows of segments as suffixes: comparisons by prefix hashes, sorted by merges."""

    def __init__(self, rows: np.ndarray) -> None:
        up, self.down = POWERS.upto(rows.shape[1] + 1)
        self.rows = rows
        self.prefix = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * up[: rows.shape[1]], axis=1, out=self.prefix[:, 1:])

    def twins(self, group: np.ndarray, seg: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Places of the windows with another one of the same hash in their group; any other is a class of its own and needs no sorting."""
        flat, a = self.prefix.ravel(), seg * self.prefix.shape[1] + off
        key = mixed((flat[a + WINDOW] - flat[a]) * self.down[off] ^ mixed(group.astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        out = np.zeros(len(key), bool)
        out[order[1:][same]] = out[order[:-1][same]] = True
        return np.flatnonzero(out)

    def common(self, s: np.ndarray, o: np.ndarray, t: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Common extension of suffixes (s at o) and (t at p), up to WINDOW bytes, by binary search."""
        flat, width = self.prefix.ravel(), self.prefix.shape[1]
        a, b = s * width + o, t * width + p
        pa_, pb, da, db = flat[a], flat[b], self.down[o], self.down[p]
        full = (flat[a + WINDOW] - pa_) * da == (flat[b + WINDOW] - pb) * db
        low, high = np.where(full, WINDOW, 0), np.where(full, WINDOW, WINDOW - 1)
        while True:
            k = np.flatnonzero(low < high)
            if not len(k):
                return low
            mid = (low[k] + high[k] + 1) // 2
            same = (flat[a[k] + mid] - pa_[k]) * da[k] == (flat[b[k] + mid] - pb[k]) * db[k]
            low[k] = np.where(same, mid, low[k])
            high[k] = np.where(same, high[k], mid - 1)

    def before(self, s, o, t, p, or_equal: bool) -> np.ndarray:
        """Whether suffix (s at o) sorts before (t at p)."""
        n = self.common(s, o, t, p)
        full = n == WINDOW
        k = np.minimum(n, WINDOW - 1)
        return np.where(full, or_equal, self.rows[s, o + k] < self.rows[t, p + k])

    def sort(self, group: np.ndarray, seg: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Order of the suffixes within groups (given in runs of equal numbers): bottom-up mergesort, all groups at once."""
        start = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
        size = np.diff(np.append(start, len(group)))
        base, total = np.repeat(start, size), np.repeat(size, size)
        order = np.arange(len(group))
        width = 1
        while width < size.max():
            at = np.flatnonzero(total > width)  # groups that are not sorted yet
            b, n = base[at], total[at]
            pos = at - b
            pair = pos // (2 * width) * (2 * width)
            left = pos - pair < width
            lo = np.where(left, np.minimum(pair + width, n), pair)  # the other run
            hi = np.where(left, np.minimum(pair + 2 * width, n), np.minimum(pair + width, n))
            first, me = lo.copy(), order[at]
            while True:  # place of each suffix in the other run
                k = np.flatnonzero(lo < hi)
                if not len(k):
                    break
                mid = (lo[k] + hi[k]) // 2
                other = order[b[k] + mid]
                goes = np.zeros(len(k), bool)
                for side in (True, False):
                    q = np.flatnonzero(left[k] == side)
                    goes[q] = self.before(seg[other[q]], off[other[q]], seg[me[k[q]]], off[me[k[q]]], or_equal=not side)
                lo[k] = np.where(goes, mid + 1, lo[k])
                hi[k] = np.where(goes, hi[k], mid)
            own = np.where(left, pos - pair, pos - pair - width)
            new = order.copy()
            new[b + pair + own + (lo - first)] = me
            order = new
            width *= 2
        return order

    def classes(self, group: np.ndarray, seg: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sorted order of all windows, and where a class of equal windows begins in it."""
        order = self.sort(group, seg, off)
        s, o = seg[order], off[order]
        new = np.ones(len(order), bool)
        near = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
        equal = near[self.common(s[near], o[near], s[near - 1], o[near - 1]) == WINDOW]
        cols = np.arange(WINDOW)
        for a in range(0, len(equal), 1 << 16):  # verified byte by byte
            e = equal[a : a + (1 << 16)]
            ok = (self.rows[s[e][:, None], o[e][:, None] + cols] == self.rows[s[e - 1][:, None], o[e - 1][:, None] + cols]).all(1)
            if not ok.all():
                raise RuntimeError("two windows with one hash differ: choose another base of the prefix hashes")
            new[e] = False
        return order, new


def _large(text: np.ndarray, start: np.ndarray, left: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows of one large group (n windows of each segment) in parts: their places in sorted order, and where classes begin."""
    total = int(n.sum())
    off = ranges(np.zeros(len(n), np.int64), n)
    at, place = np.repeat(start, n) + off, np.repeat(left, n) - off
    parts = -(-total // SORTED_WINDOWS)
    part = np.zeros(total, np.uint32)
    cut = np.concatenate([[0], np.cumsum(n)])
    for a, b in blocks_of(n, SORTED_WINDOWS):
        own = slice(cut[a], cut[b])
        rows = text[at[own][:, None] + np.arange(WINDOW)].ravel()
        edge = np.arange(0, len(rows) + 1, WINDOW)
        part[own] = span_hashes(prefix_hashes(rows), edge[:-1], edge[1:]) % np.uint64(parts)
    for p in range(parts):
        k = np.flatnonzero(part == p)
        if len(k):
            k = k[np.argsort(place[k], kind="stable")]
            order, new = Suffixes(text[at[k][:, None] + np.arange(WINDOW)]).classes(place[k], np.arange(len(k)), np.zeros(len(k), np.int64))
            yield k[order], np.flatnonzero(new)


def _compare(table: pa.Table) -> pa.Table:
    """In a bucket: for each chunk's segments, runs of windows with the smallest document id of their class."""
    chunks = table.column("chunk").to_pylist()
    parts = [unpacked(SEGMENTS, blob.as_buffer()) for blob in table.column("blob")]
    row = np.repeat(np.arange(len(parts)), [len(p["h"]) for p in parts])
    h, sid, left, size, least, many = (np.concatenate([p[k] for p in parts]) for k in ("h", "sid", "left", "size", "least", "many"))
    text = np.concatenate([p["text"] for p in parts])
    left, size = left.astype(np.int64), size.astype(np.int64)
    text_at = np.cumsum(size) - size
    order = np.lexsort((sid, h))
    first = np.flatnonzero(np.concatenate([[True], (sid[order][1:] != sid[order][:-1]) | (h[order][1:] != h[order][:-1])]))
    u_of = np.empty(len(h), np.int64)
    u_of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    again = np.ones(len(h), bool)
    again[first] = False
    checked(text, text_at[order], size[order], np.flatnonzero(again))
    u = order[first]
    u_least = np.minimum.reduceat(least[order], first)
    windows = size[u] - WINDOW + 1
    group_at = np.flatnonzero(np.concatenate([[True], h[u][1:] != h[u][:-1]]))
    group_n = np.diff(np.append(group_at, len(u)))
    w_at = np.cumsum(windows) - windows
    w_least = np.repeat(u_least, windows)
    several = np.flatnonzero(group_n > 1)
    for a, b in blocks_of(group_n[several], SORTED_SEGMENTS):
        g = several[a:b]
        own = ranges(group_at[g], group_n[g])
        n = windows[own]
        if len(own) > SORTED_SEGMENTS:  # one large group, in parts
            least_of, where = np.repeat(u_least[own], n), ranges(w_at[own], n)
            for k, begin in _large(text, text_at[u[own]], left[u[own]], n):
                w_least[where[k]] = np.repeat(np.minimum.reduceat(least_of[k], begin), np.diff(np.append(begin, len(k))))
            continue
        rows = np.zeros((len(own), int(size[u[own]].max())), np.uint8)
        inside = np.arange(rows.shape[1]) < size[u[own]][:, None]
        rows[inside] = text[ranges(text_at[u[own]], size[u[own]])]
        seg = np.repeat(np.arange(len(own)), n)
        off = ranges(np.zeros(len(own), np.int64), n)
        group = np.repeat(np.repeat(np.arange(len(g)), group_n[g]), n) * 64 + np.repeat(left[u[own]], n) - off
        suffixes = Suffixes(rows)
        by = suffixes.twins(group, seg, off)
        if not len(by):
            continue
        by = by[np.argsort(group[by], kind="stable")]
        where = ranges(w_at[own], n)[by]
        sorted_, new = suffixes.classes(group[by], seg[by], off[by])
        begin = np.flatnonzero(new)
        low = np.minimum.reduceat(np.repeat(u_least[own], n)[by][sorted_], begin)
        w_least[where[sorted_]] = np.repeat(low, np.diff(np.append(begin, len(sorted_))))
    w_seg = np.repeat(np.arange(len(u)), windows)
    run_at = np.flatnonzero(np.concatenate([[True], (w_seg[1:] != w_seg[:-1]) | (w_least[1:] != w_least[:-1])]))
    run_n, run_least = np.diff(np.append(run_at, len(w_seg))), w_least[run_at]
    runs = np.bincount(w_seg[run_at], minlength=len(u))
    runs_at = np.cumsum(runs) - runs
    u_low = np.minimum.reduceat(run_least, runs_at)
    wanted = np.flatnonzero(many.astype(bool) | (u_low[u_of] < least))
    at = np.searchsorted(row[wanted], np.arange(len(parts) + 1))
    rows_out = []
    for i, c in enumerate(chunks):
        k = wanted[at[i] : at[i + 1]]
        if len(k):
            r = ranges(runs_at[u_of[k]], runs[u_of[k]])
            rows_out.append((c, _one(table, "bucket"), packed(RUNS, h=h[k], sid=sid[k], runs=runs[u_of[k]], n=run_n[r], least=run_least[r])))
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows_out, strict=True) if rows_out else ([],) * 3, _B.types, strict=True)], schema=_B)


def covered(table: pa.Table, found: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a chunk, whether each is removed, and the texts' offsets (all rows of the chunk)."""
    ids, data, at = _texts(table, only_known=False)
    delta = np.zeros(len(data) + 1, np.int32)
    if found.num_rows:
        parts = [unpacked(RUNS, blob.as_buffer()) for blob in found.column("blob")]
        sid, runs, n, least = (np.concatenate([p[k] for p in parts]) for k in ("sid", "runs", "n", "least"))
        code = np.concatenate([p["h"].astype(np.uint64) | np.uint64(b) << np.uint64(32) for p, b in zip(parts, found.column("bucket").to_pylist(), strict=True)])
        runs, n = runs.astype(np.int64), n.astype(np.int64)
        runs_at = np.cumsum(runs) - runs
        offset = np.cumsum(n) - n - np.repeat((np.cumsum(n) - n)[runs_at], runs)  # of a run within its segment
        order = np.argsort(sid)
        if (sid[order][1:] == sid[order][:-1]).any():
            raise RuntimeError(COLLISION)
        x = Anchors(data, at, buckets)
        spot = np.minimum(np.searchsorted(sid[order], x.sid), len(sid) - 1)
        hit = np.flatnonzero((sid[order][spot] == x.sid) & (code[order][spot] == x.code))  # of a shared anchor: its segments were checked
        s = order[spot[hit]]
        r = ranges(runs_at[s], runs[s])
        lo = np.repeat(x.lo[hit], runs[s]) + offset[r]
        doc = ids[np.searchsorted(at, lo, side="right") - 1]
        cut = least[r] < doc  # a text without an id has the least one there is, and so keeps everything
        np.add.at(delta, lo[cut], 1)
        np.add.at(delta, lo[cut] + n[r][cut] - 1 + WINDOW, -1)
    np.cumsum(delta, out=delta)
    return data, delta[:-1] > 0, at


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text, without arrays of the chunk's length."""
    out = np.zeros(len(at) - 1, np.int64)
    some = at[1:] > at[:-1]
    if some.any():
        out[some] = np.add.reduceat(flags, at[:-1][some], dtype=np.int64)
    return out


_SPANS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _digest(buckets: int, with_kept: bool):
    schema = _SPANS if with_kept else pa.schema(list(_SPANS)[:-1])

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        data, gone, at = covered(table, found, buckets)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        starts = at[:-1][at[:-1] < len(data)]
        begins[starts] = gone[starts]
        removed, spans = per_text(gone, at), per_text(begins, at)
        del begins
        kept = memoryview(data[~gone].tobytes())
        cut = at - np.concatenate([[0], np.cumsum(removed)])
        texts = [kept[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        arrays = [table.column("__doc_id").combine_chunks(), np.diff(at), removed, spans, [hashlib.sha256(t).hexdigest() for t in texts], [bytes(t) for t in texts] if with_kept else None][: len(schema)]
        return pa.Table.from_arrays([pa.array(a, t) if not isinstance(a, pa.Array) else a for a, t in zip(arrays, schema.types, strict=True)], schema=schema)

    return run


def _rewrite(buckets: int, text_col: str):
    """Rows with their text cut; a character of several bytes stays unless all of it is removed."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        data, gone, at = covered(table, found, buckets)
        kept = ~gone
        inside = (data & 0xC0) == 0x80  # bytes of a character after its first
        for _ in range(3):  # a byte that stays keeps its character's other bytes
            kept[1:] |= kept[:-1] & inside[1:]
        for _ in range(3):
            kept[:-1] |= kept[1:] & inside[1:]
        cut = np.concatenate([[0], np.cumsum(per_text(kept, at))]).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data[kept])))
        i = table.schema.get_field_index(text_col)
        out = table.set_column(i, text_col, pa.chunked_array([pa.array(texts)]))
        return out.select([n for n in out.column_names if n not in ("__chunk", "__doc_id", "__text")])

    return run


def _chunked(docs: DataFrame, id_col: str, text_col: str, extra: bool) -> tuple[DataFrame, int]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, math.ceil(total / CHUNK_BYTES))
    own = [F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.when(F.col(id_col).isNull(), F.xxhash64(text))), F.lit(chunks)).cast("int").alias("__chunk"), F.col(id_col).cast("long").alias("__doc_id"), text.alias("__text")]
    return docs.select(*own, *([F.col(c) for c in docs.columns] if extra else [])), chunks


def _found(chunked: DataFrame, chunks: int) -> tuple[DataFrame, int]:
    """For each chunk, the windows' least ids around shared anchors; and the number of buckets."""
    buckets = max(1, chunks // 2)
    hashes = chunked.groupBy("__chunk").applyInArrow(tidied_group(_send_hashes(buckets)), _SQL["A"])
    shared = hashes.groupBy("bucket").applyInArrow(tidied_group(_share), _SQL["B"])
    segments = chunked.groupBy("__chunk").cogroup(shared.groupBy("chunk")).applyInArrow(tidied_group(_send_segments(buckets)), _SQL["A"])
    return segments.groupBy("bucket").applyInArrow(tidied_group(_compare), _SQL["B"]), buckets


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """What is left of each whole text without bytes that a 50-byte string of an earlier document covers.

    A byte goes if a 50-byte string that covers it also starts in a document of smaller doc_id; strings
    are judged on the input and never cross documents. Returns one row per input row: doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256, kept (binary; left out unless ``with_kept``). A null text is empty; a text
    without doc_id keeps everything and removes nothing elsewhere; rows that repeat a doc_id don't cut
    each other; other columns are ignored; an empty table gives no rows.
    """
    bounded_arrow(docs.sparkSession)
    chunked, chunks = _chunked(docs, id_col, text_col, extra=False)
    found, buckets = _found(chunked, chunks)
    return chunked.groupBy("__chunk").cogroup(found.groupBy("chunk")).applyInArrow(tidied_group(_digest(buckets, with_kept)), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, and their texts cut as in repeated_spans().

    A cut never splits a character: one that is removed in part stays. Null texts become empty.
    """
    bounded_arrow(docs.sparkSession)
    chunked, chunks = _chunked(docs, id_col, text_col, extra=True)
    found, buckets = _found(chunked, chunks)
    return chunked.groupBy("__chunk").cogroup(found.groupBy("chunk")).applyInArrow(tidied_group(_rewrite(buckets, text_col)), docs.schema)
