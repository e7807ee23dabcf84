"""Byte-level BPE encoding and decoding.

Pre-tokens are cut by the JVM's regular expressions. A Python worker dictionary-encodes them block
by block (Arrow, no Python objects), so each block carries its distinct words once. The ranked merges
are folded over the bytes of the distinct words, the ids are spread back over the documents, and
decoding concatenates the pieces. No row is shuffled: every document stays in its partition.

Two folds give the same ids. ``native=True`` is the one of Spark higher-order functions with a literal
rank map: one interpreted lambda for each step and word. The default folds all distinct words of a
block together in numpy, as the first can't meet the CPU limit (README: figures).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import as_bytes, blocks_of, id_text, PairTable, tidied
from docforge.plans.tables import bounded_arrow

#: The public pattern, with Unicode's White_Space spelt out as Java needs it.
JAVA_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
#: Buckets of the literal rank map: a lookup compares with the few keys of one bucket.
BUCKETS = 1 << 14
#: A cost is a rank times STEP; NEVER is above all of them. STEP is above FOLD_BYTES.
STEP = 1 << 10
NEVER = 1 << 40
#: Words of more bytes than this are folded with a heap in the Arrow step, as an array fold takes squared time.
FOLD_BYTES = 192
#: Tokens of a block at most (one document at least); bounds the memory of a task.
BLOCK_TOKENS = 250_000


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _map_json(path: str) -> str:
    """The rank map as JSON: an array of BUCKETS small maps; a byte is the character of the same number."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in read_ranks(path).items():
        text = token.decode("latin-1")
        buckets[zlib.crc32(text.encode()) % BUCKETS][text] = rank
    return json.dumps(buckets, separators=(",", ":"))


def _rank(text: str) -> str:
    """SQL of a token's rank, null where it is no token."""
    return f"element_at(get(rank_map, cast(pmod(crc32(cast({text} as binary)), {BUCKETS}) as int)), {text})"


def _fold_sql(word: str) -> str:
    """SQL that folds the ranked merges over a word of bytes (as Latin-1 characters) into ids.

    The state holds the n pieces p, and n + 1 costs r: the rank of each neighbouring pair times STEP,
    between two that are NEVER. The least cost plus its place gives the leftmost pair of lowest rank at
    once. (array_position and concat would say the same, at several times the cost: the first leaves its
    loop by an exception, the second walks a lazy list.)
    """
    cost = lambda text: f"coalesce({_rank(text)} * {STEP}L, {NEVER}L)"
    least = lambda r: f"array_min(transform({r}, (c, j) -> c + j))"
    state = lambda p, r: f"transform(array({r}), q -> struct({p} as p, q as r, {least('q')} as b))[0]"
    chars = f"transform(sequence(1, length({word})), j -> substr({word}, j, 1))"
    pairs = f"transform(sequence(0, length({word})), j -> if(j = 0 or j = length({word}), {NEVER}L, {cost(f'substr({word}, j, 2)')}))"
    merge = (
        f"transform(array(cast(s.b % {STEP} as int)), i -> transform(array(get(s.p, i - 1) || get(s.p, i)), m -> "
        + state(
            "flatten(array(slice(s.p, 1, i - 1), array(m), slice(s.p, i + 2, size(s.p))))",
            f"flatten(array(slice(s.r, 1, i - 1), array({cost('(get(s.p, i - 2) || m)')}, {cost('(m || get(s.p, i + 1))')}), slice(s.r, i + 3, size(s.r))))",
        )
        + ")[0])[0]"
    )
    fold = f"aggregate(sequence(1, length({word})), {state(chars, pairs)}, (s, k) -> if(s.b >= {NEVER}L, s, {merge}), s -> transform(s.p, x -> {_rank('x')}))"
    return f"if(length({word}) > {FOLD_BYTES}, cast(null as array<int>), coalesce(nvl2({_rank(word)}, array({_rank(word)}), null), {fold}))"


def heap_bpe(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, in n log n: leftmost lowest rank first."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    piece, nxt, prv = [word[i : i + 1] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = nxt[i]
        if not piece[i] or j >= n or len(piece[i]) + len(piece[j]) != len(both) or piece[i] + piece[j] != both:
            continue  # one of the two has been merged since
        piece[i], piece[j] = both, b""
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for a in (prv[i], i):
            b = nxt[a] if a >= 0 else n
            if a >= 0 and b < n and (r := ranks.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (r, a, piece[a] + piece[b]))
    return [ranks[p] for p in piece if p]


_BLOCK = "doc_ids array<bigint>, sizes array<int>, places binary, words array<string>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' tokens to blocks: ids, token numbers, and each token's place in the block's distinct words."""
    ids: list[pa.Array] = []
    toks: list[pa.Array] = []
    held = 0

    def block() -> pa.RecordBatch:
        lists = [x for t in toks for x in ([t] if isinstance(t, pa.Array) else t.chunks)]
        sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.int32)
        flat = pa.chunked_array([x.flatten() for x in lists], pa.string()).combine_chunks()
        coded = flat.dictionary_encode() if isinstance(flat, pa.Array) else flat.combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a.cast(kind))
        doc_ids = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [one(doc_ids, pa.int64()), one(pa.array(sizes), pa.int32()), pa.array([coded.indices.to_numpy(zero_copy_only=False).astype("<i4").tobytes()], pa.binary()), one(coded.dictionary, pa.string())],
            names=["doc_ids", "sizes", "places", "words"],
        )

    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy()) if len(batch) else np.zeros(0, int)
        for a, b in blocks_of(sizes, BLOCK_TOKENS):  # one batch may hold the tokens of several blocks
            own = int(sizes[a:b].sum())
            if ids and held + own > BLOCK_TOKENS:
                yield block()
                ids, toks, held = [], [], 0
            ids.append(batch.column(0).slice(a, b - a))
            toks.append(batch.column(1).slice(a, b - a))
            held += own
    if ids:
        yield block()


class Merges:
    """The ranked merges of a rank file over many words at once."""

    NEVER = 1 << 30

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 24 | b)
                    values.append(rank)
        self.table = PairTable(np.array(keys, np.int64), np.array(values, np.int64), self.NEVER)
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def fold(self, words: pa.BinaryArray) -> pa.ListArray:
        """Ids of each word: in every round each word merges its leftmost pair of lowest rank."""
        n_words = len(words)
        whole = np.array([-1 if (r := self.ranks.get(w)) is None else r for w in words.to_pylist()], np.int64)
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n_words + 1].astype(np.int64)
        sizes = np.diff(at)
        done_word, done_tok = [np.flatnonzero(whole >= 0)], [whole[whole >= 0]]
        for i in np.flatnonzero((whole < 0) & (sizes > FOLD_BYTES)):
            ids = heap_bpe(words[i].as_py(), self.ranks)
            done_word.append(np.full(len(ids), i))
            done_tok.append(np.array(ids, np.int64))
        word = np.flatnonzero((whole < 0) & (sizes > 0) & (sizes <= FOLD_BYTES))
        n = sizes[word]
        if len(word):
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            place = np.repeat(at[word] - starts, n) + np.arange(n.sum())
            tok = self.single[np.frombuffer(words.buffers()[2], np.uint8)[place]]
            owner = np.repeat(np.arange(len(word)), n)
            cost = self._costs(tok, owner, np.arange(len(tok)))
        while len(word):
            low = np.minimum.reduceat(cost << 32 | np.arange(len(tok)), starts)
            ended = low >> 32 >= self.NEVER
            keep = np.ones(len(tok), bool)
            if ended.any():
                keep = ~ended[owner]
                done_word.append(word[owner[~keep]])
                done_tok.append(tok[~keep])
            left = low[~ended]
            at_pair = left & 0xFFFFFFFF
            tok[at_pair] = left >> 32
            keep[at_pair + 1] = False
            new = np.cumsum(keep) - 1
            at_pair = new[at_pair]
            word, n = word[~ended], n[~ended] - 1
            tok, cost = tok[keep], cost[keep]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(word)), n)
            touched = np.concatenate([at_pair, at_pair[at_pair > 0] - 1])
            cost[touched] = self._costs(tok, owner, touched)
        owners, toks = np.concatenate(done_word), np.concatenate(done_tok)
        order = np.argsort(owners, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=n_words))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(toks[order].astype(np.int32)))

    def _costs(self, tok: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), self.NEVER, np.int64)
        ok = np.flatnonzero(at + 1 < len(tok))
        ok = ok[owner[at[ok]] == owner[at[ok] + 1]]
        out[ok] = self.table.get(tok[at[ok]] << 24 | tok[at[ok] + 1])
        return out


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(read_ranks(path))


def _joined(parts: pa.BinaryArray, offsets: np.ndarray) -> pa.BinaryArray:
    """Neighbouring values of a binary array joined between offsets; no copy of the bytes."""
    at = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
    bounds = np.ascontiguousarray(at[offsets].astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(bounds), parts.buffers()[2]])


def _spread_out(words: pa.BinaryArray, index: pa.Array, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of all tokens in order, and where each document's begin and end."""
    if not len(index):
        return memoryview(b""), np.zeros(len(ends), np.int64)
    tokens = words.take(index)
    at = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    return memoryview(tokens.buffers()[2] or b""), at[ends].astype(np.int64)


def _encoder(rank_file: str, keep_ids: bool, keep_decoded: bool, native: bool):
    """Blocks of documents to results. native: the ids of distinct words come with the block."""

    def tables() -> tuple[pa.BinaryArray, pa.BinaryArray]:
        ranks = read_ranks(rank_file)
        names = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            names[rank] = token
        return pa.array([b"%d," % i for i in range(len(names))], pa.binary()), pa.array(names, pa.binary())

    def results(doc_ids, sizes, places, ids, digits, pieces) -> pa.RecordBatch:
        offsets = ids.offsets.to_numpy()
        flat = ids.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(ids) else pa.array([], pa.int32())
        offsets = offsets - (offsets[0] if len(offsets) else 0)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        index = pa.array(places)
        n_ids = np.concatenate([[0], np.cumsum(np.diff(offsets).astype(np.int64)[places])]) if len(places) else np.zeros(1, np.int64)
        cuts = lambda at: zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
        buf, at = _spread_out(_joined(digits.take(flat), offsets), index, ends)
        ids_sha = [hashlib.sha256(buf[s : max(s, e - 1)]).hexdigest() for s, e in cuts(at)]
        raw, at = _spread_out(_joined(pieces.take(flat), offsets), index, ends)
        out_sha = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in cuts(at)]
        arrays = [doc_ids, pa.array(n_ids[ends[1:]] - n_ids[ends[:-1]], pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            spread = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat).take(index).flatten() if len(places) else flat
            arrays.append(pa.ListArray.from_arrays(pa.array(n_ids[ends].astype(np.int32)), spread.cast(pa.int32())))
            names.append("ids")
        if keep_decoded:
            arrays.append(pa.array([bytes(raw[s:e]) for s, e in cuts(at)], pa.binary()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits, pieces = tables()
        for batch in _blocks(batches):
            words = as_bytes(batch.column(3).flatten())
            yield results(batch.column(0).flatten(), batch.column(1).flatten().to_numpy(), np.frombuffer(batch.column(2)[0].as_buffer(), "<i4"), merges(rank_file).fold(words), digits, pieces)

    def run_native(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits, pieces = tables()
        for batch in batches:
            for row in range(batch.num_rows):
                col = {n: batch.column(i).slice(row, 1) for i, n in enumerate(batch.schema.names)}
                ids = col["ids"].flatten()  # one list of ids for each distinct word
                if ids.null_count:
                    words = as_bytes(col["words"].flatten())
                    ids = pa.array([heap_bpe(words[i].as_py(), read_ranks(rank_file)) if not ids[i].is_valid else ids[i].as_py() for i in range(len(ids))], pa.list_(pa.int32()))
                yield results(col["doc_ids"].flatten(), col["sizes"].flatten().to_numpy(), np.frombuffer(col["places"][0].as_buffer(), "<i4"), ids, digits, pieces)

    return run_native if native else run


def encode(docs: DataFrame, rank_file: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_decoded: bool = False, native: bool = False) -> DataFrame:
    """Encode and decode each row's whole text by the ranks of a tiktoken file, without special tokens.

    Returns one row for each input row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by
    commas), decoded_sha256 (of the decoded bytes), with ``keep_ids`` also ids array<int>, and with
    ``keep_decoded`` decoded binary. A null or empty text has no tokens and the digest of no bytes; a null id stays
    null; repeated rows give repeated results; other columns are ignored, whatever their names; an
    empty table gives no rows. The rank file must be at the same path on every node.

    The merges of a block's distinct words are folded together, round by round, in arrays. ``native``
    folds them by Spark's higher-order functions instead, with the same results (README: figures).
    """
    spark = docs.sparkSession
    bounded_arrow(spark, 4 << 20)
    more = ", ids array<int>" * keep_ids + ", decoded binary" * keep_decoded
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + more
    tokens = id_text(docs, id_col, text_col).select("doc_id", F.regexp_extract_all("text", F.lit(JAVA_PATTERN), F.lit(0)).alias("toks"))
    if not native:
        return tokens.mapInArrow(tidied(_encoder(rank_file, keep_ids, keep_decoded, False)), schema)
    with_map = tokens.mapInArrow(tidied(_blocks), _BLOCK).withColumn("rank_map", F.from_json(F.lit(_map_json(rank_file)), "array<map<string,int>>"))
    latin = "transform(words, u -> decode(cast(u as binary), 'ISO-8859-1'))"
    coded = with_map.selectExpr(
        "doc_ids", "sizes", "places",
        f"transform(words, u -> if(octet_length(u) > {FOLD_BYTES}, u, null)) as words",
        f"transform({latin}, w -> {_fold_sql('w')}) as ids",
    )
    return coded.mapInArrow(tidied(_encoder(rank_file, keep_ids, keep_decoded, True)), schema)
