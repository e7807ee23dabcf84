"""Benchmark decontamination: short test items found inside long documents.

Containment of an item in a document is the share of the item's word shingles that the document
holds. Items are partitioned by size; each size class keeps a MinHash sketch (the k shingles of
lowest hash, a random sample without replacement) and the least number of sketch shingles that a
document must hold, so that an item at the threshold is missed with at most a chosen probability.
The sketches are probed with every shingle of a whole document, of any length; what remains is
verified by the exact shared count of full shingle sets. Documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import as_bytes, batches_of, id_text, ranges, tidied, Words
from docforge.plans.tables import bounded_arrow, release, written

#: Upper item sizes of the classes (in shingles) and their sketch sizes; larger items have the last.
CLASSES = ((32, 32), (128, 40), (512, 48), (1 << 62, 64))
#: Bytes of items' shingles that are held (and broadcast) at once; more items are taken in blocks.
BLOCK_BYTES = 32 << 20
_BITS = 22


def least_matches(size: int, sketch: int, threshold: float, miss: float) -> int:
    """Sketch shingles that an item of ``size`` at the threshold has in a document, but for ``miss``."""
    good = math.ceil(threshold * size - 1e-9)
    if sketch >= size:
        return good
    total, below = math.comb(size, sketch), 0.0
    for m in range(sketch + 1):
        below += math.comb(good, m) * math.comb(size - good, sketch - m) / total if sketch - m <= size - good else 0.0
        if below > miss:
            return m
    return sketch


@dataclass
class Items:
    """An index of one block of items."""

    ids: np.ndarray
    offsets: np.ndarray
    shingles: np.ndarray  # sorted within an item
    percent: int
    miss: float

    def __post_init__(self) -> None:
        size = np.diff(self.offsets)
        hashes, owners, self.least = [], [], np.zeros(len(size), np.int64)
        for i, n in enumerate(size):
            k = next(s for top, s in CLASSES if n <= top)
            hashes.append(self.shingles[self.offsets[i] : self.offsets[i] + min(n, k)])
            owners.append(np.full(min(n, k), i))
            self.least[i] = max(1, least_matches(int(n), k, self.percent / 100, self.miss))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.sketch, first = np.unique(h[order], return_index=True)
        self.owner, self.owner_at = o[order], np.append(first, len(h))
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.sketch >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, shingles: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents (numbers, ascending in doc), items and shared shingles of what is contained."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.sketch) or not len(shingles):
            return none
        near = np.flatnonzero(self.bitmap[(shingles >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.searchsorted(self.sketch, shingles[near])
        at[at == len(self.sketch)] = 0
        real = self.sketch[at] == shingles[near]
        if not real.any():
            return none
        pairs = np.unique(doc[near[real]].astype(np.int64) << 32 | at[real])
        d, s = pairs >> 32, pairs & 0xFFFFFFFF
        n = self.owner_at[s + 1] - self.owner_at[s]
        item = self.owner[np.repeat(self.owner_at[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both, count = np.unique(np.repeat(d, n) << 32 | item, return_counts=True)
        both = both[count >= self.least[both & 0xFFFFFFFF]]
        if not len(both):  # sketch shingles were met, but too few of any item
            return none
        out = []
        docs, first = np.unique(both >> 32, return_index=True)
        for x, a, b in zip(docs, first, np.append(first[1:], len(both)), strict=True):
            own = np.unique(shingles[np.searchsorted(doc, x) : np.searchsorted(doc, x, side="right")])
            wanted = both[a:b] & 0xFFFFFFFF
            size = self.offsets[wanted + 1] - self.offsets[wanted]
            want = self.shingles[ranges(self.offsets[wanted], size)]
            held = own[np.minimum(np.searchsorted(own, want), len(own) - 1)] == want
            shared = np.add.reduceat(held.astype(np.int64), np.cumsum(size) - size)
            ok = 100 * shared >= self.percent * size
            out.append((np.full(ok.sum(), x), wanted[ok], shared[ok]))
        return tuple(np.concatenate(parts) for parts in zip(*out, strict=True)) if out else none


def _item_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            h, doc = Words(as_bytes(batch.column(1))).shingles(k)
            at = np.searchsorted(doc, np.arange(len(batch) + 1))
            sets = [np.unique(h[a:b]).astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["item_id", "shingles"])

    return run


def item_blocks(items: DataFrame, k: int, percent: int, miss: float, id_col: str, text_col: str) -> Iterator[tuple[Items, bool]]:
    """Indexes of the items, block by block, and whether it is the last one: each is of bounded size, whatever their number."""
    bounded_arrow(items.sparkSession)
    sets = written(id_text(items, id_col, text_col).mapInArrow(tidied(_item_sets(k)), "item_id bigint, shingles binary"), "items")
    total = sets.agg(F.sum(F.octet_length("shingles") + 16)).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for b in range(n):
        rows = sets.where(F.octet_length("shingles") > 0).where(F.pmod(F.xxhash64("shingles"), F.lit(n)) == b).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, bytes(r.shingles)))
        parts = [np.frombuffer(r.shingles, "<u8").astype(np.uint64) for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        yield Items(np.array([r.item_id for r in rows], object), offsets, np.concatenate(parts) if parts else np.zeros(0, np.uint64), percent, miss), b == n - 1
    release(sets)


def contained_items(docs: DataFrame, items: DataFrame, *, shingle: int = 5, percent: int = 80, miss: float = 1e-7, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and an item with at least ``percent`` of the item's shingles in the document.

    Words are lower-cased (A-Z) and split at ASCII white space; an item or text of fewer words than
    ``shingle`` has its whole sequence as its only shingle. Returns doc_id, item_id, n_item_shingles,
    n_shared, containment; documents without an item have no row. Null or empty texts and items match
    nothing; null ids stay null; repeated rows (of either table) give repeated pairs; other columns are
    ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    parts = []
    for block, last in item_blocks(items, shingle, percent, miss, item_id, item_text):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            x: Items = held.value
            for batch in batches_of(batches):
                d, i, n = x.hits(*Words(as_bytes(batch.column(1))).shingles(shingle))
                size = np.diff(x.offsets)[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(d)), pa.array(list(x.ids[i]), pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n / np.maximum(size, 1), pa.float64())],
                    names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
                )

        found = rows.mapInArrow(tidied(run), "doc_id bigint, item_id bigint, n_item_shingles bigint, n_shared bigint, containment double")
        parts.append(found if last and not parts else _pass(found, held, "hits"))
    return reduce(DataFrame.unionByName, parts)


def _pass(found: DataFrame, held, kind: str) -> DataFrame:
    """A pass's rows, written, and its block given back: blocks are held one at a time."""
    out = written(found, kind)
    held.destroy()
    return out


def decontaminated(docs: DataFrame, items: DataFrame, *, shingle: int = 5, percent: int = 80, miss: float = 1e-7, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that contain no item.

    Null and empty texts contain nothing and stay; null and empty items are contained in nothing; repeated
    rows all stay or go; empty tables take nothing away. Words and shingles are those of contained_items().
    """
    spark = docs.sparkSession
    place = docs.columns.index(text_col)
    mine: list[DataFrame] = []
    for block, last in item_blocks(items, shingle, percent, miss, item_id, item_text):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            x: Items = held.value
            for batch in batches:
                texts = batch.column(place).cast(pa.string()).fill_null("")
                d, _, _ = x.hits(*Words(as_bytes(texts)).shingles(shingle))
                keep = np.ones(len(batch), bool)
                keep[d] = False
                yield batch.filter(pa.array(keep))

        kept = docs.mapInArrow(tidied(run), docs.schema)
        if last:
            return kept
        before, docs = mine, _pass(kept, held, "clean")
        mine = [docs]
        release(*before)
    raise AssertionError("there is always a last block")
