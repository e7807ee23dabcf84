"""Token counts by trie-shared dynamic programming over a unigram piece vocabulary.

The distinct pre-tokens of a block go into a trie (here: sorted rows, whose common prefixes are the
shared nodes). Forward scores are computed once per node, level by level in arrays: the best score of
a prefix is the best over the pieces that may end there. Terminal nodes hold token counts, which are
then summed over the documents. Nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docforge.llm.common import as_bytes, batches_of, id_text, mixed, PairTable, POWERS, ranges, tidied, Words
from docforge.plans.tables import bounded_arrow

#: A byte without a piece costs this much more than the rarest piece.
UNKNOWN_PENALTY = 10.0
#: Pre-tokens of more bytes go into tries of their own, with others of about their length; rows and cells of a trie; fewer rows are scored word by word.
ROW_BYTES, ROWS, CELLS, FEW = 40, 1 << 16, 1 << 22, 8


@lru_cache(maxsize=2)
def piece_scores(model_file: str) -> dict[bytes, float]:
    """Pieces of a sentencepiece model (a space for its mark) with log-probabilities by Zipf's law.

    The model's pieces are ranked by its own scores; the piece of rank r (from 0) has probability
    1 / ((r + 1) * H), with H the sum over all ranks. Control, unknown and byte pieces are left out.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [(-sp.get_score(i), i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces.sort()
    total = sum(1.0 / (r + 1) for r in range(len(pieces)))
    return {p.replace("▁", " ").encode(): -math.log((r + 1) * total) for r, (_, _, p) in enumerate(pieces)}


class Lattice:
    """Best segmentations of many words at once."""

    def __init__(self, pieces: dict[bytes, float]) -> None:
        self.pieces = pieces
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.lengths = sorted({len(p) for p in pieces} | {1}, reverse=True)
        names = list(pieces)
        hashes = np.array([self._hash(np.frombuffer(p, np.uint8)) for p in names], np.uint64)
        self.table = PairTable((hashes >> np.uint64(1)).astype(np.int64), np.arange(len(names), dtype=np.int32), -1)
        self.scores = np.array([*pieces.values(), -np.inf])

    @staticmethod
    def _hash(p: np.ndarray) -> int:
        up, _ = POWERS.upto(len(p) + 1)
        with np.errstate(over="ignore"):
            return int(mixed(np.array([((p.astype(np.uint64) + np.uint64(1)) * up[: len(p)]).sum(dtype=np.uint64)]) ^ np.uint64(len(p)))[0])

    def one(self, word: bytes) -> tuple[float, int]:
        """Score and token count of a single word, by the plain recurrence."""
        best, count = [0.0] + [-math.inf] * len(word), [0] * (len(word) + 1)
        for d in range(1, len(word) + 1):
            for n in self.lengths:
                if n > d:
                    continue
                s = self.pieces.get(word[d - n : d], self.unknown if n == 1 else -math.inf)
                if (best[d - n] + s, -count[d - n] - 1) > (best[d], -count[d] if best[d] > -math.inf else -math.inf):
                    best[d], count[d] = best[d - n] + s, count[d - n] + 1
        return best[-1], count[-1]

    def many(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and token counts of distinct words."""
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        size = np.diff(at)
        score, count = np.zeros(len(words)), np.zeros(len(words), np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
        short = np.flatnonzero((size > 0) & (size <= ROW_BYTES))
        long = np.flatnonzero(size > ROW_BYTES)
        long = long[np.argsort(size[long], kind="stable")]
        blocks = [short] if len(short) else []
        a = 0
        while a < len(long):  # by rising length, so that a block's rows are nearly full
            b = a + 1
            while b < len(long) and b - a < ROWS and (b + 1 - a) * size[long[b]] <= CELLS:
                b += 1
            blocks.append(long[a:b])
            a = b
        for own in blocks:
            if len(own) < FEW and size[own[-1]] > ROW_BYTES:
                for i in own:
                    score[i], count[i] = self.one(words[i].as_py())
                continue
            width = int(size[own].max())
            rows = np.zeros((len(own), width), np.uint8)
            inside = np.arange(width) < size[own][:, None]
            rows[inside] = data[ranges(at[own], size[own])] + 1  # no byte of UTF-8 is 255
            order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
            rows, own = rows[order], own[order]
            for i in range(0, len(own), ROWS):
                part = slice(i, min(i + ROWS, len(own)))
                score[own[part]], count[own[part]] = self._trie(rows[part], size[own[part]])
        return score, count

    def _trie(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = rows.shape
        up, down = POWERS.upto(width + 1)
        prefix = np.zeros((n, width + 1), np.uint64)
        np.cumsum(rows.astype(np.uint64) * up[:width], axis=1, out=prefix[:, 1:])
        same = rows[1:] == rows[:-1]
        shared = np.concatenate([[0], np.where(same.all(1), width, same.argmin(1))])
        node = np.zeros((n, width + 1), np.int32)
        best, count = [np.zeros(1)], [np.zeros(1, np.int64)]
        base = 1
        new_at = []
        for d in range(1, width + 1):
            new = (shared < d) & (size >= d)
            node[:, d] = base + np.cumsum(new) - 1
            new_at.append(np.flatnonzero(new))
            base += len(new_at[-1])
        best, count = np.full(base, -np.inf), np.zeros(base, np.int64)
        best[0] = 0.0
        for d in range(1, width + 1):
            r = new_at[d - 1]
            top, num = np.full(len(r), -np.inf), np.zeros(len(r), np.int64)
            for k in self.lengths:
                if k > d or not len(r):
                    continue
                h = mixed((prefix[r, d] - prefix[r, d - k]) * down[d - k] ^ np.uint64(k)) >> np.uint64(1)
                s = self.scores[self.table.get(h.astype(np.int64))]
                if k == 1:
                    s = np.where(s == -np.inf, self.unknown, s)
                prev = node[r, d - k]
                s, c = best[prev] + s, count[prev] + 1
                take = (s > top) | ((s == top) & (c < num) & (s > -np.inf))
                top[take], num[take] = s[take], c[take]
            at = node[r, d]
            best[at], count[at] = top, num
        last = node[np.arange(n), size]
        return best[last], count[last]


@lru_cache(maxsize=2)
def lattice(model_file: str) -> Lattice:
    return Lattice(piece_scores(model_file))


_BLANK = np.zeros(256, bool)
_BLANK[32] = True


def _counter(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_file)
        lone_score, lone_count = lat.one(b" ")
        for batch in batches_of(batches):
            texts = as_bytes(batch.column(1))
            words = Words(texts, _BLANK, lower=False)
            n_bytes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]).astype(np.int64)
            _, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
            spelled = words.spelled(first)
            score, count = lat.many(pa.array([b" " + w for w in spelled.to_pylist()], pa.binary()))
            n = len(batch)
            n_words = np.bincount(words.doc, minlength=n)
            inside = np.bincount(words.doc, weights=(words.end - words.start), minlength=n).astype(np.int64)
            slots = np.where(n_bytes > 0, n_bytes - inside + 1, 0)  # each space begins a pre-token, and so does a text
            lone = slots - n_words
            tokens = np.bincount(words.doc, weights=count[place], minlength=n).astype(np.int64) + lone * lone_count
            total = np.bincount(words.doc, weights=score[place], minlength=n) + lone * lone_score
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(slots), pa.array(n_bytes), pa.array(total)], names=["doc_id", "n_tokens", "n_pretokens", "n_bytes", "log_prob"])

    return run


def token_counts(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each row's whole text under the most probable unigram segmentation.

    A text gets one leading space; a pre-token is a space and the run of other characters after it
    (perhaps none). Returns doc_id, n_tokens, n_pretokens, n_bytes, log_prob (of the segmentation).
    Ties of score go to fewer tokens. A null or empty text has 0 of each; a null id stays null;
    repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
    """
    bounded_arrow(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(tidied(_counter(model_file)), "doc_id bigint, n_tokens bigint, n_pretokens bigint, n_bytes bigint, log_prob double")
