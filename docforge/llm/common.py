"""What several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rules: exactly what bytes.split() splits at (space, \\t, \\n, \\v, \\f, \\r).
WORD_RULE = r"[^\x20\x09-\x0D]+"


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under the names doc_id and text."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fold(key: Column, modulus: int) -> Column:
    """crc32 of a key's decimal text, by a modulus."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def as_bytes(column: pa.Array) -> pa.BinaryArray:
    """A string column as bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary())


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space."""
    return text.lower().split()


def trim() -> None:
    """Give memory that is no longer used back to the system: workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(f: Callable) -> Callable:
    """A function over batches that tidies up after its last one."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def tidied_group(f: Callable) -> Callable:
    """A function over groups that tidies up after each one."""

    def one(table: pa.Table) -> pa.Table:
        out = f(table)
        trim()
        return out

    def two(table: pa.Table, other: pa.Table) -> pa.Table:
        out = f(table, other)
        trim()
        return out

    return two if len(inspect.signature(f).parameters) == 2 else one


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift) of unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def blocks_of(lengths: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive row ranges whose lengths sum to about ``limit`` at most (one row at least)."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            out.append((start, i))
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        out.append((start, len(lengths)))
    return out


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2^64; the tables grow as needed."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                    x = np.full(n, base, np.uint64)
                    x[0] = 1
                    setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


POWERS = _Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes modulo 2^64: n + 1 sums of (byte + 1) * base^i."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans [start, end), the same wherever the bytes stand; mixed with the length."""
    _, down = POWERS.upto(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of many texts as arrays: hash (of the lower-cased bytes), text number, and place in data.

    Words are compared by 64-bit hashes.
    """

    __slots__ = ("data", "doc", "end", "hash", "n_docs", "start")

    def __init__(self, texts: pa.BinaryArray, spaces: np.ndarray = _SPACE, lower: bool = True, block: int = 1 << 20) -> None:
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        at -= at[0]
        self.n_docs = len(texts)
        parts: list[tuple[np.ndarray, ...]] = []
        for a, b in blocks_of(np.diff(at), block):
            lo, hi = at[a], at[b]
            if hi == lo:
                continue
            x = self.data[lo:hi]
            inside = ~spaces[x]
            first = np.zeros(len(x) + 1, bool)
            first[(at[a:b] - lo)] = True
            first[-1] = True
            before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
            after = np.concatenate([inside[1:], [False]]) & ~first[1:]
            start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            h = span_hashes(prefix_hashes(x), start, end)
            doc = np.searchsorted(at[a : b + 1] - lo, start, side="right") - 1 + a
            parts.append((h, doc, start + lo, end + lo))
        if parts:
            self.hash, self.doc, self.start, self.end = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            self.hash = np.zeros(0, np.uint64)
            self.doc = self.start = self.end = np.zeros(0, np.int64)

    def bounds(self) -> np.ndarray:
        """For each text the range of its words, as n_docs + 1 offsets."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def spelled(self, which: np.ndarray) -> pa.BinaryArray:
        """The bytes of chosen words."""
        return gathered(self.data, self.start[which], self.end[which])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside a text, and their text numbers.

        A text of fewer words (one at least) has its whole sequence as its only shingle.
        """
        odd = np.uint64(0x9FB21C651E98DF25)
        n = np.diff(self.bounds())
        acc, doc = self.hash.copy(), self.doc
        short_acc, short_doc = [], []
        for i in range(1, k):
            ends = np.flatnonzero(n == i)  # texts of i words: what is gathered so far is their whole sequence
            if len(ends):
                at = np.searchsorted(doc, ends)
                short_acc.append(mixed(acc[at] ^ np.uint64(i)))
                short_doc.append(ends)
            if len(self.hash) <= i:
                acc, doc = acc[:0], doc[:0]
                break
            same = self.doc[i:] == self.doc[:-i]
            nxt = mixed(acc[: len(self.hash) - i] * odd + self.hash[i:]) if i == 1 else None
            if nxt is None:
                full = np.zeros(len(self.hash), np.uint64)
                full[place] = acc
                nxt = mixed(full[: len(self.hash) - i] * odd + self.hash[i:])
            place = np.flatnonzero(same)
            acc, doc = nxt[place], self.doc[place]
        if short_doc:
            acc, doc = np.concatenate([acc, *short_acc]), np.concatenate([doc, *short_doc])
            order = np.argsort(doc, kind="stable")
            acc, doc = acc[order], doc[order]
        return acc, doc


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """Byte spans of data as a binary array."""
    n = (end - start).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    index = np.repeat(start - at[:-1], n) + np.arange(at[-1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[index]))])


class PairTable:
    """Integers to integers by open addressing: vectorised lookups of 64-bit keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int) -> None:
        self.bits = max(8, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.missing = np.full(size, -1, np.int64), np.full(size, missing, values.dtype), missing
        keys, values = keys.astype(np.int64), values.copy()
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            _, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[keys[left] != self.keys[slot[left]]]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = self.values[slot]
        miss = np.flatnonzero((found != keys) & (found != -1))
        out[found != keys] = self.missing
        while len(miss):
            slot[miss] = (slot[miss] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[miss]]
            hit = found == keys[miss]
            out[miss[hit]] = self.values[slot[miss[hit]]]
            miss = miss[~hit & (found != -1)]
        return out


def batches_of(batches, limit: int = 12 << 20):
    """Arrow batches to slices whose second column holds about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        lengths = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset : batch.column(1).offset + len(batch) + 1]) if len(batch) else np.zeros(0, int)
        for a, b in blocks_of(lengths, limit):
            yield batch.slice(a, b - a)


def packed(**arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed value. Integers of several bytes go by byte planes, which compress better."""
    import json

    import zstandard

    head, body = [], []
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        head.append([name, x.dtype.str, len(x)])
        raw = x.view(np.uint8)
        body.append((raw.reshape(-1, x.dtype.itemsize).T if x.dtype.itemsize > 1 else raw).tobytes())
    top = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(top).to_bytes(4, "little") + top + b"".join(body))


def unpacked(value: bytes) -> dict[str, np.ndarray]:
    import json

    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int.from_bytes(raw[:4], "little")
    out, at = {}, 4 + n
    for name, kind, size in json.loads(raw[4:at]):
        dtype = np.dtype(kind)
        own = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at)
        out[name] = (np.ascontiguousarray(own.reshape(dtype.itemsize, size).T).view(dtype).ravel() if dtype.itemsize > 1 else own.view(dtype)) if size else np.zeros(0, dtype)
        at += size * dtype.itemsize
    return out


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The integers start .. start + n - 1 of each range, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
