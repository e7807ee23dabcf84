"""Texts scored by a log-bilinear language model over word classes.

The model's probability of a token is P(class | the two classes before) * P(word | class). Frequent
words are classes of their own; the others belong to one of some spelling classes, a mixture over
byte pairs. Class vectors are log-bilinear: the context predicts a vector, a linear map of the vectors
of the two classes before, and a class scores by its product with it. They are trained in numpy by
noise-contrastive estimation, in passes over all class trigrams counted in the training texts. Spelling
classes are started on the most frequent words and fitted to all distinct ones; their number grows with
these. Batched matrix
products over all contexts give normalised log-probabilities, a table of which scores tokens.
P(word | class) and the base score come from exact counts of every training token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docforge.llm.common import as_bytes, batches_of, fold, ranges, tidied, Words
from docforge.plans.tables import bounded_arrow, written

#: No word can be this: it stands for the end of a text.
END = b"\n"
HEAD, SPELLINGS, SIZE = 79, 48, 32
#: Words that are classed at once, and byte pairs up to which their sums go place by place.
WORD_BLOCK, LONG = 1_024, 256
#: Bytes of text that a worker takes apart at once, and rows of counts that it returns at once.
TEXT_BLOCK, ROW_BLOCK = 4 << 20, 1 << 18
#: Words whose spelling starts the classes, and words whose counts are held by every task.
FIT_WORDS, HELD_WORDS = 20_000, 131_072
#: Gradient steps at least, passes over all counted contexts at least, contexts of a step, and noise for each token.
STEPS, EPOCHS, BATCH, NOISE = 1_500, 150, 2_048, 10
#: Passes over all distinct words that shape the spelling classes, classes more for each doubling of the words past HELD_WORDS, and the most of them.
PASSES, GROWN, MOST_SPELLINGS = 2, 4, 128


def summed_rows(logp: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each range of ``row`` (start, size) the column whose sum over the chosen rows of logp is the greatest.

    Ranges are taken by size and summed place by place in blocks, so that what is added stays in the processor's cache.
    """
    best = np.zeros(len(at), np.int64)
    by = np.argsort(-n, kind="stable")
    for i in range(0, len(by), WORD_BLOCK):
        own = by[i : i + WORD_BLOCK]
        start, size = at[own], n[own]
        score = logp[row[start]]
        longer = np.searchsorted(-size, -np.arange(1, min(size[0], LONG)), side="left")
        for j, m in enumerate(longer, 1):
            score[:m] += logp[row[start[:m] + j]]
        for w in np.flatnonzero(size > LONG):
            for a in range(start[w] + LONG, start[w] + size[w], WORD_BLOCK):
                score[w] += logp[row[a : min(a + WORD_BLOCK, start[w] + size[w])]].sum(0)
        best[own] = score.argmax(1)
    return best


@dataclass
class Classes:
    """Words to classes: 0 the end, then frequent words, then spelling classes."""

    head: np.ndarray  # sorted hashes
    head_class: np.ndarray
    pair_row: np.ndarray  # of 65536 byte pairs, the row of logp
    logp: np.ndarray
    n: int

    def spelling(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spelling classes of chosen words, counted from 0; their byte pairs one after the other, and how many each has."""
        start, end = words.start[which], words.end[which]
        n = end - start + 1
        at = np.cumsum(n) - n
        left = np.zeros(int(n.sum()), np.int64)
        right = np.zeros(int(n.sum()), np.int64)
        inner = np.ones(len(left), bool)
        inner[at] = False  # a word's first pair has nothing on its left
        flat = np.repeat(start - at - 1, n) + np.arange(len(left))
        left[inner] = words.data[flat[inner]]
        inner[:] = True
        inner[at + n - 1] = False
        right[inner] = words.data[flat[inner] + 1]
        pair = left << 8 | right
        return summed_rows(self.logp, self.pair_row[pair], at, n), pair, n

    def of(self, words: Words, which: np.ndarray) -> np.ndarray:
        """Classes of chosen words."""
        out = self.spelling(words, which)[0] + (self.n - self.logp.shape[1])
        if len(self.head):
            spot = np.minimum(np.searchsorted(self.head, words.hash[which]), len(self.head) - 1)
            own = self.head[spot] == words.hash[which]
            out[own] = self.head_class[spot[own]]
        return out


def _pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = [(0, *w, 0) for w in words]
    owner = np.repeat(np.arange(len(words)), [len(x) - 1 for x in flat])
    return owner, np.array([a << 8 | b for x in flat for a, b in zip(x[:-1], x[1:], strict=True)], np.int64)


def spellings_for(distinct: int) -> int:
    """The number of spelling classes for so many distinct words."""
    return min(MOST_SPELLINGS, SPELLINGS + GROWN * max(0, int(np.log2(max(1, distinct) / HELD_WORDS))))


def fit_classes(top: list[tuple[bytes, int]], spellings: int = SPELLINGS) -> Classes:
    """Classes from the most frequent words and their counts: a mixture of byte-pair distributions, by EM."""
    head, rest = [w for w, _ in top[:HEAD]], top[HEAD:] or top
    k = min(spellings, max(1, len(rest)))
    hashes = Words(pa.array(head, pa.binary())).hash if head else np.zeros(0, np.uint64)
    by = np.argsort(hashes)
    row = np.zeros(1 << 16, np.int64)
    logp = np.zeros((1, k), np.float32)
    if rest:
        owner, pair = _pairs([w for w, _ in rest])
        known, index = np.unique(pair, return_inverse=True)
        row[known] = np.arange(1, len(known) + 1)
        weight = np.sqrt(np.array([n for _, n in rest], float))
        rng = np.random.default_rng(7)
        resp = rng.dirichlet(np.full(k, 0.1), len(rest))
        size = np.bincount(owner, minlength=len(rest))
        at = np.cumsum(size) - size
        for _ in range(25):
            counts = np.zeros((len(known), k))
            np.add.at(counts, index, (resp * weight[:, None])[owner])
            table = np.log((counts + 0.02) / (counts.sum(0) + 0.02 * (len(known) + 1)))
            mass = np.log(((resp * weight[:, None]).sum(0) + 1) / (weight.sum() + k))
            score = np.add.reduceat(table[index], at, axis=0) + mass
            score -= score.max(1, keepdims=True)
            resp = np.exp(score)
            resp /= resp.sum(1, keepdims=True)
        unseen = np.log(0.02 / (counts.sum(0) + 0.02 * (len(known) + 1)))
        logp = np.concatenate([unseen[None], table]).astype(np.float32)
    return Classes(hashes[by], (np.arange(len(head)) + 1)[by], row, logp, 1 + len(head) + k)


def _spelled(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: Classes = held.value
        k = classes.logp.shape[1]
        sums = np.zeros(k << 16, np.int64)
        for batch in batches:
            words = Words(batch.column(0))
            if not len(words.hash):
                continue
            rest = np.flatnonzero(~np.isin(words.hash, classes.head)) if len(classes.head) else np.arange(len(words.hash))
            best, pair, n = classes.spelling(words, rest)
            weight = np.round(np.sqrt(batch.column(1).to_numpy()[words.doc[rest]]) * 1024).astype(np.int64)
            np.add.at(sums, pair * k + np.repeat(best, n), np.repeat(weight, n))
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums[cell])], names=["cell", "n"])

    return run


def refined(classes: Classes, counts: DataFrame) -> Classes:
    """The spelling classes fitted anew to the byte pairs of all distinct words, each word in the best class so far."""
    held = counts.sparkSession.sparkContext.broadcast(classes)
    found = counts.where(F.col("word") != F.lit(END)).mapInArrow(tidied(_spelled(held)), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    held.destroy()
    if not found.num_rows:
        return classes
    k = classes.logp.shape[1]
    cell, n = found.column("cell").to_numpy(), found.column("n").to_numpy() / 1024
    known, index = np.unique(cell // k, return_inverse=True)
    sums = np.zeros((len(known) + 1, k))  # the first is of pairs that no word has
    sums[index + 1, cell % k] = n
    row = np.zeros(1 << 16, np.int64)
    row[known] = np.arange(1, len(known) + 1)
    logp = np.log((sums + 0.02) / (sums.sum(0) + 0.02 * (len(known) + 1)))
    return Classes(classes.head, classes.head_class, row, logp.astype(np.float32), classes.n)


def train(cells: np.ndarray, counts: np.ndarray, c: int) -> np.ndarray:
    """log10 P(class | two classes before), for all contexts, from trigram counts (cell = (a * c + b) * c + class)."""
    rng = np.random.default_rng(11)
    y = cells % c
    unigram = np.bincount(y, weights=counts, minlength=c) + 0.5
    noise = unigram / unigram.sum()
    log_noise = np.log(noise)
    first, second = rng.normal(0, 0.1, (c, SIZE)), rng.normal(0, 0.1, (c, SIZE))
    out, bias = rng.normal(0, 0.1, (c, SIZE)), log_noise.copy()
    if len(cells):
        context, row = np.unique(cells // c, return_inverse=True)
        a, b = context // c, context % c
        times = np.bincount(row, weights=counts, minlength=len(context))
        by = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[by], np.arange(len(context) + 1))
        scale = len(context) / counts.sum()
        seen = {k: np.full(v.shape, 1e-6) for k, v in (("first", first), ("second", second), ("out", out), ("bias", bias))}
        one = np.eye(c)
        blocks = -(-len(context) // BATCH)
        for step in range(-(-max(STEPS, EPOCHS * blocks) // blocks) * blocks):
            if step % blocks == 0:
                order = rng.permutation(len(context))
            i = order[step % blocks :: blocks]
            own = by[ranges(ends[i], ends[i + 1] - ends[i])]
            n = np.zeros((len(i), c))
            n[np.repeat(np.arange(len(i)), ends[i + 1] - ends[i]), y[own]] = counts[own] * scale
            ctx = first[a[i]] + second[b[i]]
            noisy = 1 / (1 + np.exp(ctx @ out.T + bias - log_noise - np.log(NOISE)))
            # of the log-likelihood that a context's tokens are data and NOISE for each are noise, all of them expected
            g = n * noisy - NOISE * scale * times[i][:, None] * noise * (1 - noisy)
            grad_ctx = g @ out
            for name, x, total in (("out", out, g.T @ ctx), ("bias", bias, g.sum(0)), ("first", first, one[a[i]].T @ grad_ctx), ("second", second, one[b[i]].T @ grad_ctx)):
                seen[name] += total**2
                x += 0.3 * total / np.sqrt(seen[name])
    table = np.empty((c * c, c), np.float32)
    for i in range(c):  # contexts with the same class two before
        score = (first[i] + second) @ out.T + bias
        top = score.max(1, keepdims=True)
        table[i * c : (i + 1) * c] = (score - top - np.log(np.exp(score - top).sum(1, keepdims=True))) / np.log(10)
    return table


def _sequences(words: Words, of_word: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens with each text's end, their texts, and the cells of context and token but for the token."""
    n = np.bincount(words.doc, minlength=n_docs) + 1
    ends = np.cumsum(n) - 1
    cls = np.zeros(int(n.sum()), np.int64)
    inside = np.ones(len(cls), bool)
    inside[ends] = False
    cls[inside] = of_word
    doc = np.repeat(np.arange(n_docs), n)
    one, two = np.zeros_like(cls), np.zeros_like(cls)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    start = ends - n + 1
    one[start] = two[start] = 0
    second = start[n > 1] + 1
    two[second] = 0
    return cls, doc, np.stack([two, one])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, TEXT_BLOCK):
        words = Words(as_bytes(batch.column(1)))
        _, first, count = np.unique(words.hash, return_index=True, return_counts=True)
        spelled = words.spelled(first)
        yield pa.RecordBatch.from_arrays([spelled, pa.array(count.astype(np.int64))], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([len(batch)], pa.int64())], names=["word", "n"])


def _trigrams(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: Classes = held.value
        c = classes.n
        sums = np.zeros(c**3, np.int64)
        for batch in batches_of(batches, TEXT_BLOCK):
            words = Words(as_bytes(batch.column(1)))
            _, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
            cls, _, (two, one) = _sequences(words, classes.of(words, first)[place], len(batch))
            np.add.at(sums, (two * c + one) * c + cls, 1)
        cell = np.flatnonzero(sums)
        for i in range(0, len(cell), ROW_BLOCK):
            own = cell[i : i + ROW_BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sums[own])], names=["cell", "n"])

    return run


def _class_sizes(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: Classes = held.value
        for batch in batches:
            words = Words(batch.column(0))  # a word each: rows of the end have none
            cls = classes.of(words, np.arange(len(words.hash)))
            n = batch.column(1).to_numpy()[words.doc]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes.n)), pa.array(np.bincount(cls, weights=n, minlength=classes.n).astype(np.int64)), pa.array(np.bincount(cls, minlength=classes.n).astype(np.int64))], names=["cls", "n", "v"])

    return run


@dataclass
class Model:
    classes: Classes
    table: np.ndarray
    log_size: np.ndarray  # log10(N + V + 1) of spelling classes, 0 for the others
    known: np.ndarray  # sorted hashes of the most frequent words
    count: np.ndarray
    end_count: int


def _scorer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m: Model = held.value
        c, spelled_from = m.classes.n, m.classes.n - m.classes.logp.shape[1]
        row = 0
        for batch in batches_of(batches, TEXT_BLOCK):
            n = len(batch)
            words = Words(as_bytes(batch.column(1)))
            uniq, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
            own = m.classes.of(words, first)
            cls, doc, (two, one) = _sequences(words, own[place], n)
            score = np.bincount(doc, weights=m.table[two * c + one, cls], minlength=n)
            spot = np.minimum(np.searchsorted(m.known, uniq), max(0, len(m.known) - 1))
            held_word = m.known[spot] == uniq if len(m.known) else np.zeros(len(uniq), bool)
            count = np.where(held_word, m.count[spot], 0) if len(m.known) else np.zeros(len(uniq))
            log_count = np.log10(count + 1)
            sums = lambda per_word: np.bincount(words.doc, weights=per_word[place], minlength=n)  # noqa: E731, B023
            score += sums(np.where(own >= spelled_from, log_count - m.log_size[own], 0.0))
            base = sums(log_count) + np.log10(m.end_count + 1)
            known = sums(held_word.astype(float)).astype(np.int64) + (m.end_count > 0)
            rare = ~held_word[place]
            pair, times = np.unique(words.doc[rare] << 32 | place[rare], return_counts=True)
            at = np.searchsorted(pair >> 32, np.arange(n + 1)).astype(np.int32)
            spelled = words.spelled(first[pair & 0xFFFFFFFF])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, TaskContext.get().partitionId()), pa.int32()), pa.array(np.arange(row, row + n), pa.int64()), batch.column(0), batch.column(2),
                    pa.array(np.bincount(words.doc, minlength=n) + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(at), spelled), pa.ListArray.from_arrays(pa.array(at), pa.array(times.astype(np.int64))),
                ],
                names=["part", "row", "doc_id", "held_out", "n_tokens", "known", "base", "lm", "rare", "times"],
            )
            row += n

    return run


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all whole texts, learnt from those whose crc32(id as text) mod 7 is not 2.

    Returns doc_id, held_out (remainder is 2), n_tokens, n_known (tokens counted in training), train_tokens
    (N), base_score (sum of log10((c + 1) / (N + V + 1))) and score (the model's log10 probability).
    Tokens are A-Z lower-cased words and one end per text. A null text is empty: an end alone. A row
    without id is a training row; repeated rows count and are scored each; other columns are ignored.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_arrow(spark, TEXT_BLOCK)
    held_out = F.coalesce(fold(F.col(id_col).cast("long"), 7) == 2, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    training = rows.where(~F.col("held_out")).select("doc_id", "text")
    counts = written(training.mapInArrow(tidied(_counter), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("n"), "word").limit(HELD_WORDS).toArrow()
    spelled, count = top.column("word").combine_chunks(), top.column("n").to_numpy()
    end_count = (counts.where(F.col("word") == F.lit(END)).first() or (0, 0))[1]
    classes = fit_classes(list(zip(spelled.slice(0, FIT_WORDS).to_pylist(), count[:FIT_WORDS].tolist(), strict=True)), spellings_for(int(v)))
    for _ in range(PASSES):
        classes = refined(classes, counts)
    held_classes = spark.sparkContext.broadcast(classes)
    cells = training.mapInArrow(tidied(_trigrams(held_classes)), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sizes = counts.where(F.col("word") != F.lit(END)).mapInArrow(tidied(_class_sizes(held_classes)), "cls bigint, n bigint, v bigint").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    log_size = np.zeros(classes.n)
    for r in sizes:
        log_size[r.cls] = np.log10(r.n + r.v + 1)
    log_size[: classes.n - classes.logp.shape[1]] = 0
    by = np.argsort(cells.column("cell").to_numpy(), kind="stable")
    table = train(cells.column("cell").to_numpy()[by], cells.column("n").to_numpy()[by].astype(float), classes.n)
    hashes = Words(spelled).hash if len(spelled) else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    model = Model(classes, table, log_size, hashes[order], count[order].astype(float), int(end_count))
    scored = written(
        rows.mapInArrow(tidied(_scorer(spark.sparkContext.broadcast(model))), "part int, row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, lm double, rare array<binary>, times array<bigint>"),
        "scored",
    )
    rare = scored.select("part", "row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("part", "row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    added = rare.join(counts, "word").groupBy("part", "row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("seen"))
    out = scored.drop("rare", "times").join(added, ["part", "row"], "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("lm") + more).alias("score"),
    )
