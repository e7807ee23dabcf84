"""Toxicity by weak supervision.

Voters are entries of a fixed lexicon, words and word beginnings that labelled training rows set apart
(mined from a bounded sample of them; one that only repeats better ones is left out), patterns of style (direct address, masked words, shouting), and
rules on how many entries a text holds and how densely. A generative label model, fitted by EM, estimates
for each voter how it votes on toxic and on other texts. Voters that go together beyond what the label
explains form cliques, of which the model has the joint distribution of votes. The labels only mine the lexicon and
start the EM; the posterior is that of the votes. A linear classifier is trained on the posterior and
scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import as_bytes, batches_of, fold, id_text, ranges, tidied, Words
from docforge.plans.tables import bounded_arrow, release, written

#: Labelled rows that are used at most, and of a part of the sample, which is too small in bytes to be dealt to several tasks by itself.
SAMPLE_ROWS, SAMPLE_PART = 20_000, 625
BEGINNINGS = range(4, 9)
#: Least log-likelihood ratio of a mined pattern (a chance of about 1e-6, as many are tried), and how much more frequent it is in toxic texts.
LEAST_GAIN, LEAST_RATIO = 24.0, 4.0
#: What a text counts for further patterns once one is chosen that it holds.
COVERED = 0.5
#: The share of the toxic texts from which on a whole word is judged on all texts, not on what others leave.
COMMON = 0.05
#: Voters whose residual correlation is greater are modelled jointly, this many at most in one clique.
CORRELATED, CLIQUE = 0.15, 4
# Insults and abuse in English, German, French and Spanish that are hardly anything else.
LEXICON = (
    "idiot idiots moron morons imbecile stupid dumbass scum scumbag loser losers pathetic worthless disgusting retard retarded bastard bastards bitch asshole assholes jerk creep pervert"
    " vermin subhuman fuck fucking fucker motherfucker shit bullshit cunt whore slut douchebag twat wanker"
    " arschloch hurensohn wichser fotze schlampe vollidiot dummkopf abschaum missgeburt drecksau scheisse scheiße untermensch schwachkopf"
    " connard connards connasse salaud salope enculé pute putain abruti crétin débile ordure imbécile bâtard"
    " gilipollas pendejo pendeja cabrón cabrones puta mierda imbécil estúpido estúpida hijueputa malparido subnormal escoria"
).split()
#: Patterns of style, each over a whole text: one of some phrases in lower case, a masked word, three words in capitals in a row, or a run of marks.
ADDRESS = tuple(x.encode() for x in ("you are a ", "you are an ", "you are so ", "you are such ", "you're a ", "you're an ", "you're so ", "du bist ein ", "du bist so ", "tu es un ", "tu es une ", "eres un ", "eres una ", "eres tan "))
DISMISSAL = tuple(x.encode() for x in ("shut up", "go to hell", "get lost", "drop dead", "kill yourself", "halt die klappe", "ta gueule", "vete a la mierda"))
MASKED = re.compile(rb"[a-z]\*{2,}")
STYLES = 5
_LETTERS = re.compile(r"[^\W\d_]+")


def forms(word: bytes) -> list[str]:
    """Runs of letters of a word, in lower case."""
    return _LETTERS.findall(word.decode("utf-8", "replace").lower())


def patterns_of(form: str) -> list[str]:
    """A form as a whole (marked by a final blank), and its beginnings of 4 to 8 letters."""
    return [form + " ", *(form[:k] for k in BEGINNINGS if len(form) > k)]


def _presence(hits: list[list[int]], place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, entry) pairs, from the entries of each distinct word and the words' places."""
    size = np.array([len(h) for h in hits], np.int64)
    flat = np.array([i for h in hits for i in h], np.int64)
    at = np.cumsum(size) - size
    pair = np.unique(np.repeat(doc, size[place]) << 32 | flat[ranges(at[place], size[place])]) if len(place) else np.zeros(0, np.int64)
    return pair >> 32, pair & 0xFFFFFFFF


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every pattern of a batch the numbers of toxic and of other texts that hold it."""
    for batch in batches_of(batches, 4 << 20):
        words = Words(as_bytes(batch.column(1)))
        _, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
        index: dict[str, int] = {}
        hits = [[index.setdefault(p, len(index)) for p in {p for f in forms(w) for p in patterns_of(f)}] for w in words.spelled(first).to_pylist()]
        doc, entry = _presence(hits, place, words.doc)
        toxic = batch.column(2).to_numpy(zero_copy_only=False) > 0
        count = lambda rows: pa.array(np.bincount(entry[rows], minlength=len(index)))  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(list(index), pa.string()), count(toxic[doc]), count(~toxic[doc])], names=["pattern", "toxic", "other"])


def shouted(texts: pa.BinaryArray, words: Words) -> np.ndarray:
    """Texts with three words in a row that have three capitals at least and no small letter."""
    if len(words.start) < 3:
        return np.zeros(0, np.int64)
    first = int(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset])
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[first : first + len(words.data)]
    capitals = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90), dtype=np.int32)])
    small = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122), dtype=np.int32)])
    loud = (capitals[words.end] - capitals[words.start] >= 3) & (small[words.end] == small[words.start])
    row = loud[2:] & loud[1:-1] & loud[:-2] & (words.doc[2:] == words.doc[:-2])
    return np.unique(words.doc[2:][row])


@dataclass
class Matcher:
    """Patterns by name; a text's matches by its distinct words."""

    patterns: list[str]

    def __post_init__(self) -> None:
        self.index = {p: i for i, p in enumerate(self.patterns)}

    def words(self, spelled: list[bytes]) -> list[list[int]]:
        get = self.index.get
        out = []
        for w in spelled:
            own: list[int] = []
            for f in forms(w):
                own += [i for p in patterns_of(f) if (i := get(p)) is not None]
            out.append(own)
        return out

    def texts(self, texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Presence of each pattern in each text; words, distinct words, matching words and distinct ones; and presence of each style."""
        words = Words(texts)
        n = len(texts)
        _, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
        hits = self.words(words.spelled(first).to_pylist())
        some = np.flatnonzero(np.array([bool(h) for h in hits], bool)[place]) if len(place) else np.zeros(0, np.int64)
        present = np.zeros((n, len(self.patterns)), bool)
        present[_presence(hits, place[some], words.doc[some])] = True
        counts = np.zeros((n, 4 + STYLES))
        counts[:, 0] = np.bincount(words.doc, minlength=n)
        counts[:, 1] = np.bincount(np.unique(words.doc << 32 | place) >> 32, minlength=n)
        counts[:, 2] = np.bincount(words.doc[some], minlength=n)
        counts[:, 3] = np.bincount(np.unique(words.doc[some] << 32 | place[some]) >> 32, minlength=n)
        for i, text in enumerate(texts.to_pylist()):
            low = text.lower() if text else b""
            counts[i, 4:8] = any(x in low for x in ADDRESS), any(x in low for x in DISMISSAL), b"**" in low and MASKED.search(low) is not None, b"!!!" in low
        counts[shouted(texts, words), 8] = 1
        return present, counts


def features(present: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The classifier's inputs: patterns, numbers of matches, their densities, the text's length and variety, and styles."""
    words, distinct, hits, kinds = counts.T[:4]
    more = [np.log1p(kinds), np.log1p(hits), np.minimum(kinds, 3), np.log1p(1000 * kinds / (words + 20)), np.log1p(1000 * hits / (words + 20)), np.log1p(words), distinct / (words + 1)]
    return np.column_stack([present.astype(float), *more, counts[:, 4:]])


def votes(present: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Voters: 1 toxic, -1 not, 0 no opinion. One per pattern, then rules on numbers and densities, then one per style."""
    words, _, _, kinds = counts.T[:4]
    dense = 1000 * kinds / (words + 20)
    rules = [
        np.where(kinds >= 2, 1, 0), np.where(kinds >= 3, 1, 0), np.where(kinds >= 5, 1, 0), np.where(dense >= 4, 1, 0), np.where(dense >= 8, 1, 0), np.where(dense >= 16, 1, 0),
        np.where(kinds == 0, -1, 0), np.where((kinds <= 1) & (words >= 100), -1, 0), np.where(dense < 2, -1, 0), np.where((dense < 4) & (words >= 300), -1, 0),
    ]
    return np.column_stack([present.astype(np.int8), *rules, counts[:, 4:].astype(np.int8)]).astype(np.int8)


def cliques_of(v: np.ndarray, q: np.ndarray) -> list[list[int]]:
    """Voters in groups: those whose votes go together under each label, strongest first, up to CLIQUE of them."""
    mean1, mean0 = (q @ v) / max(q.sum(), 1e-9), ((1 - q) @ v) / max((1 - q).sum(), 1e-9)
    rest = v - np.outer(q, mean1) - np.outer(1 - q, mean0)
    norm = np.sqrt((rest**2).sum(0)) + 1e-9
    r = np.triu(np.abs(rest.T @ rest / np.outer(norm, norm)), 1)
    of = list(range(v.shape[1]))
    own = {j: [j] for j in of}
    a, b = np.nonzero(r > CORRELATED)
    for i in np.argsort(-r[a, b], kind="stable"):
        x, y = of[a[i]], of[b[i]]
        if x != y and len(own[x]) + len(own[y]) <= CLIQUE:
            own[x] += own.pop(y)
            for j in own[x]:
                of[j] = x
    return [sorted(c) for _, c in sorted(own.items())]


def label_model(v: np.ndarray, start: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Posterior of each row under a generative model of votes given a hidden label, by EM from ``start``.

    A voter's rates, and a clique's joint distribution of votes, are estimated under the posterior; a
    joint distribution is drawn to that of independent voters by the weight of one row. The structure
    is estimated from the start and again half-way.
    """
    q = np.clip(start.astype(float), 0.05, 0.95)
    for step in range(rounds):
        if step in (0, rounds // 2):  # each clique's voters, their distinct votes, and each row's place among these
            cliques = [(c, *np.unique(v[:, c], axis=0, return_inverse=True)) for c in cliques_of(v, q)]
        prior = (q.sum() + 1) / (len(q) + 2)
        odds = np.full(len(q), np.log(prior / (1 - prior)))
        sides = [(own, {x: (own @ (v == x) + 0.5) / (own.sum() + 1.5) for x in (-1, 0, 1)}) for own in (q, 1 - q)]
        for who, values, row in cliques:
            toxic, other = (
                (np.bincount(row.ravel(), weights=own, minlength=len(values)) + [math.prod(rate[x][j] for x, j in zip(value, who, strict=True)) for value in values]) / (own.sum() + 1)
                for own, rate in sides
            )
            odds += np.log(toxic / other)[row.ravel()]
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q


@dataclass
class Model:
    """A fitted classifier; constant where the labels have one class only."""

    patterns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    constant: float | None = None

    def scores(self, texts: pa.BinaryArray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = (features(*Matcher(self.patterns).texts(texts)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.coef[:-1] + self.coef[-1], -30, 30)))


def _linear(x: np.ndarray, q: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (q - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _gain(k: Column, m: Column, n1: float, n0: float) -> Column:
    """Log-likelihood ratio of a pattern in k of n1 toxic and m of n0 other texts."""
    cells = [(k, k + m, n1), (m, k + m, n0), (F.lit(n1) - k, F.lit(n1 + n0) - k - m, n1), (F.lit(n0) - m, F.lit(n1 + n0) - k - m, n0)]
    parts = [F.when(x > 0, x * F.log(x * F.lit(n1 + n0) / (row * F.lit(column)))).otherwise(F.lit(0.0)) for x, row, column in cells]
    return F.lit(2.0) * (parts[0] + parts[1] + parts[2] + parts[3])


def gains(k: np.ndarray, m: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratios as in _gain, and 0 where a pattern isn't LEAST_RATIO times as frequent in toxic texts."""
    cells = [(k, k + m, n1), (m, k + m, n0), (n1 - k, n1 + n0 - k - m, n1), (n0 - m, n1 + n0 - k - m, n0)]
    with np.errstate(divide="ignore", invalid="ignore"):
        total = sum(np.where(x > 0, x * np.log(x * (n1 + n0) / (row * column)), 0.0) for x, row, column in cells)
    return np.where((k + 0.5) / (n1 + 1) > LEAST_RATIO * (m + 0.5) / (n0 + 1), 2 * total, 0.0)


def covering(names: list[str], doc: np.ndarray, entry: np.ndarray, toxic: np.ndarray) -> list[str]:
    """Patterns by weighted covering: the best one again and again, texts that hold it counting COVERED of what they did.

    So a word that came with others into some copies falls behind, and one that stands for itself in enough texts
    does not. Of a pattern and its beginnings or continuations, only the best one counts. ``doc`` and ``entry`` are the pairs of a text
    (a place in toxic) and a pattern in it. Ties go to whole words, then to longer ones.
    """
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=lambda i: (not names[i].endswith(" "), -len(names[i]), names[i]))] = np.arange(len(names))
    weight = np.ones(len(toxic))
    whole = np.array([x.endswith(" ") for x in names], bool)
    out: list[str] = []
    common: list[int] = []
    while len(doc):
        bad = toxic[doc]
        k, m = (np.bincount(entry[own], weights=weight[doc[own]], minlength=len(names)) for own in (bad, ~bad))
        g = np.round(gains(k, m, weight[toxic].sum(), weight[~toxic].sum()), 9)
        if not out:  # whole words in many toxic texts come first, by what they are on all texts
            common = [int(i) for i in np.lexsort((rank, -g)) if whole[i] and g[i] > LEAST_GAIN and k[i] >= COMMON * toxic.sum()]
        common = [i for i in common if k[i] > 0]  # others went with a word of the same beginning
        if common:
            best = common.pop(0)
        else:
            best = int(np.lexsort((rank, -g))[0])
            if g[best] <= LEAST_GAIN:
                break
        out.append(names[best])
        weight[doc[entry == best]] *= COVERED
        bare = names[best].rstrip()
        near = np.array([x.startswith(bare) or bare.startswith(x.rstrip()) for x in names])
        doc, entry = doc[~near[entry]], entry[~near[entry]]
    return out


def _entries(names: list[str]):
    """The patterns that each text has, as places in names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(names)
        for batch in batches_of(batches, 4 << 20):
            words = Words(as_bytes(batch.column(1)))
            _, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
            doc, entry = _presence(m.words(words.spelled(first).to_pylist()), place, words.doc)
            at = np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(at), pa.array(entry.astype(np.int32)))], names=["doc_id", "toxic", "entries"])

    return run


def _rows(patterns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(patterns)
        for batch in batches_of(batches):
            present, counts = m.texts(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in present], pa.binary()), pa.array([r.tobytes() for r in counts], pa.binary())], names=["doc_id", "toxic", "present", "counts"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows whose crc32(id as text) mod 5 is not 0, at most ``sample_rows`` of them.

    The rows of least hash of the id are used, which is a random sample (the only bound: every pattern in it is rated). Equal texts
    count once, as toxic if one of them is; so does a doc_id with several labels. Null ids and labels are left out, null texts are
    empty. Without labelled rows, or with one class only, the model is constant. Other columns are ignored.
    """
    bounded_arrow(docs.sparkSession)
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id"), 5) != 0)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    own = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    sample = written(own.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic").repartition(max(1, sample_rows // SAMPLE_PART), "doc_id"), "sample")
    sizes = {r.toxic: r.n for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_other:
        release(sample)
        return Model([], *(np.zeros(0),) * 3, constant=(n_toxic + 0.5) / (n_toxic + n_other + 1) if n_toxic else 0.0)
    mined = sample.mapInArrow(tidied(_mine), "pattern string, toxic bigint, other bigint").groupBy("pattern").agg(F.sum("toxic").cast("double").alias("k"), F.sum("other").cast("double").alias("m"))
    fixed = sorted({f"{w} " for w in LEXICON})
    k, m = F.col("k"), F.col("m")
    apart = (k + 0.5) / (n_toxic + 1) > LEAST_RATIO * (m + 0.5) / (n_other + 1)
    rated = mined.where(F.col("pattern").isin(fixed) | apart).withColumn("gain", _gain(k, m, float(n_toxic), float(n_other)))
    found = rated.where(F.col("pattern").isin(fixed) | (F.col("gain") > LEAST_GAIN)).select("pattern", "gain", (k * n_other < m * n_toxic).alias("against")).collect()
    names = sorted(r.pattern for r in found if r.gain > LEAST_GAIN and not r.against)
    held = sample.mapInArrow(tidied(_entries(names)), "doc_id bigint, toxic int, entries array<int>").toArrow().sort_by("doc_id")
    entries = held.column("entries").combine_chunks()
    of = np.repeat(np.arange(held.num_rows), np.diff(entries.offsets.to_numpy()))
    patterns = covering(names, of, entries.flatten().to_numpy().astype(np.int64), held.column("toxic").to_numpy() > 0)
    against = {r.pattern for r in found if r.against}  # an entry of the lexicon that this corpus uses otherwise
    patterns += sorted({p for p in fixed if p not in against} - set(patterns))
    got = sample.mapInArrow(tidied(_rows(patterns)), "doc_id bigint, toxic int, present binary, counts binary").toArrow().sort_by("doc_id")
    release(sample)
    present = np.frombuffer(b"".join(got.column("present").to_pylist()), bool).reshape(got.num_rows, len(patterns))
    counts = np.frombuffer(b"".join(got.column("counts").to_pylist()), float).reshape(got.num_rows, 4 + STYLES)
    q = label_model(votes(present, counts), got.column("toxic").to_numpy() > 0)
    x = features(present, counts)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    return Model(patterns, mean, scale, _linear((x - mean) / scale, q))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (crc32(id as text) mod 5 is 0), score (0 to 1) and predicted (1 from 0.5) of every whole text.

    A null text is empty and has a score as well; a null id is not held out; repeated rows give
    repeated results; other columns are ignored; an empty table gives no rows.
    """
    bounded_arrow(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            s = held.value.scores(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = id_text(docs, id_col, text_col).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))
    return rows.mapInArrow(tidied(run), "doc_id bigint, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the model does not predict to be toxic.

    Null and empty texts are judged as empty ones; repeated rows all stay or go; an empty table stays empty.
    """
    bounded_arrow(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = held.value.scores(as_bytes(batch.column(place).cast(pa.string()).fill_null("")))
            yield batch.filter(pa.array(s < 0.5))

    return docs.mapInArrow(tidied(run), docs.schema)
