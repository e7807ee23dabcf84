"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets form a class, represented by its smallest id. Representatives are banded
by MinHash. Candidates of a band meet at the smallest member of their bucket (a star, not all pairs);
after the components of those links are known, members of different components are compared further,
in tiles of bounded size, so every pair that a band proposes is either compared or already connected.

A candidate is compared by batches of its signature: with m of n equal values the similarity has a beta
posterior, and the pair is dropped as soon as the probability of reaching the threshold falls below
``miss``. Survivors are verified by the exact intersection and union of their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docforge.llm.common import as_bytes, batches_of, id_text, mixed, tidied, Words
from docforge.llm.components import components
from docforge.plans.tables import bounded_arrow, release, written

BANDS, ROWS = 40, 6
PERMUTATIONS = BANDS * ROWS
#: Signature values of a batch, and members of a star that are compared in one group.
BATCH = 48
STAR = 500


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20260101)
    return (rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least values of a set of 64-bit hashes under PERMUTATIONS maps of their upper halves."""
    a, b = _permutations()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (a * x[i : i + 2048] + b).min(1), out=out)
    return out


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    h, doc = Words(as_bytes(batch.column(1))).shingles(k)
    at = np.searchsorted(doc, np.arange(len(batch) + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(h[a:b])


def band_hashes(sigs: np.ndarray) -> np.ndarray:
    """A hash for each band of each signature (rows of PERMUTATIONS values)."""
    odd = np.uint64(0x9FB21C651E98DF25)
    acc = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sigs), BANDS)).copy()
    for r in range(ROWS):
        acc = mixed(acc * odd + sigs[:, r::ROWS].astype(np.uint64))
    return acc


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.uint64(0x9FB21C651E98DF25)
        for batch in batches_of(batches, 6 << 20):
            n = np.zeros(len(batch), np.int64)
            whole = np.zeros((len(batch), 2), np.uint64)
            sigs = np.zeros((len(batch), PERMUTATIONS), np.uint32)
            for i, own in enumerate(_sets(batch, k)):
                n[i] = len(own)
                if len(own):
                    whole[i] = mixed(own).sum(dtype=np.uint64), mixed(own ^ odd).sum(dtype=np.uint64)
                    sigs[i] = signature(own)
            acc = band_hashes(sigs)
            some = n > 0
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)), pa.array(acc[some].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(whole[:, 0].view(np.int64)), pa.array(whole[:, 1].view(np.int64)), bands], names=["doc_id", "n", "h1", "h2", "bands"])

    return run


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 6 << 20):
            sigs, sets = np.zeros((len(batch), PERMUTATIONS), np.uint32), []
            for i, own in enumerate(_sets(batch, k)):
                sigs[i] = signature(own)
                sets.append(own.astype("<u8").tobytes())
            cut = lambda m, kind: pa.array([r.tobytes() for r in m.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), cut(sigs, "<u2"), cut(band_hashes(sigs), "<u8"), pa.array(sets, pa.binary())], names=["doc_id", "sig", "bands", "shingles"])

    return run


@lru_cache(maxsize=8)
def least_equal(percent: int, miss: float) -> tuple[int, ...]:
    """For each whole batch: the fewest equal values with which P(similarity >= threshold) is still ``miss``.

    Beta(1, 1) prior; its upper tail after m of n equal values is a binomial sum.
    """
    t = percent / 100
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        tail, need = 0.0, 0
        for m in range(n + 1):  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                need = m
                break
        out.append(need)
    return tuple(out)


def _verifier(percent: int, miss: float):
    """Stars, each a leader's features before its members', to verified links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = least_equal(percent, miss)
        star, lead_sig, lead_set = None, None, None
        for batch in batches:
            a, b = [], []
            leaders, salts, members = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, (leader, salt, member) in enumerate(zip(leaders, salts, members, strict=True)):
                if member is None:
                    star = (leader, salt)
                    lead_sig = np.frombuffer(batch.column(3)[i].as_buffer(), "<u2").copy()
                    lead_set = np.frombuffer(batch.column(4)[i].as_buffer(), "<u8").copy()
                    continue
                if star != (leader, salt):
                    raise RuntimeError("a star came without its leader")
                equal = np.frombuffer(batch.column(3)[i].as_buffer(), "<u2") == lead_sig
                if any(equal[: BATCH * (j + 1)].sum() < m for j, m in enumerate(need)):
                    continue
                own = np.frombuffer(batch.column(4)[i].as_buffer(), "<u8")
                small, large = (own, lead_set) if len(own) < len(lead_set) else (lead_set, own)
                shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0
                if shared and 100 * shared >= percent * (len(own) + len(lead_set) - shared):
                    a.append(leader)
                    b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, features: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links among candidate pairs (leader, member). A leader of many members is dealt to several groups."""
    pairs = written(pairs, "pairs")
    groups = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("k")).select("leader", F.ceil(F.col("k") / STAR).cast("int").alias("salts"))
    heads = groups.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    members = pairs.join(groups, "leader").select("leader", F.pmod(F.hash("member"), F.col("salts")).alias("salt"), "member")
    features = features.drop("bands")
    rows = heads.join(features.withColumnRenamed("doc_id", "leader"), "leader").select("leader", "salt", F.lit(None).cast("long").alias("member"), "sig", "shingles")
    rows = rows.unionByName(members.join(features.withColumnRenamed("doc_id", "member"), "member").select("leader", "salt", "member", "sig", "shingles"))
    dealt = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("member").asc_nulls_first())
    out = written(dealt.mapInArrow(tidied(_verifier(percent, miss)), "a bigint, b bigint"), "links")
    release(pairs)
    return out


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y, by matrix products over blocks of shingles."""
    sizes = np.array([len(s) for s in [*x, *y]])
    values, place, count = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    some = count > 1
    column = np.cumsum(some) - 1
    keep = np.flatnonzero(some[place])
    row, col = np.repeat(np.arange(len(sizes)), sizes)[keep], column[place[keep]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    out = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, int(some.sum()), 2048):
        s, e = np.searchsorted(col, [a, a + 2048])
        block = np.zeros((len(sizes), 2048), np.float32)
        block[row[s:e], col[s:e] - a] = 1
        out += block[: len(x)] @ block[len(x) :].T
    return out.astype(np.int64)


def _compare_tile(rows: list[tuple], percent: int, miss: float) -> tuple[list[int], list[int]]:
    """Links between the minor and the other members of a tile that are in different components and share a band."""
    minor, other = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
    if not minor or not other:
        return [], []
    arrays = lambda part, i, kind: np.stack([np.frombuffer(r[i], kind) for r in part])
    n1, n2 = (np.array([r[2] for r in part]) for part in (minor, other))
    c1, c2 = (np.array([r[3] for r in part]) for part in (minor, other))
    open_ = (c1[:, None] != c2) & (100 * np.minimum(n1[:, None], n2) >= percent * np.maximum(n1[:, None], n2))
    b1, b2 = arrays(minor, 5, "<u8"), arrays(other, 5, "<u8")
    together = np.zeros(open_.shape, bool)
    for j in range(BANDS):
        together |= b1[:, j, None] == b2[:, j]
    open_ &= together
    s1, s2 = arrays(minor, 4, "<u2"), arrays(other, 4, "<u2")
    need = least_equal(percent, miss)
    for i in np.flatnonzero(open_.any(1)):
        k = np.flatnonzero(open_[i])
        equal = np.zeros(len(k), np.int64)
        for j, least in enumerate(need):  # batch after batch, for what is still open
            equal += (s2[k, BATCH * j : BATCH * (j + 1)] == s1[i, BATCH * j : BATCH * (j + 1)]).sum(1)
            open_[i, k[equal < least]] = False
            k, equal = k[equal >= least], equal[equal >= least]
    x, y = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    if not len(x):
        return [], []
    shared = shared_counts([np.frombuffer(minor[i][6], "<u8") for i in x], [np.frombuffer(other[j][6], "<u8") for j in y])
    linked = (100 * shared >= percent * (n1[x][:, None] + n2[y] - shared)) & open_[np.ix_(x, y)]
    i, j = np.nonzero(linked)
    return [minor[x[k]][1] for k in i], [other[y[k]][1] for k in j]


def _tiles(percent: int, miss: float):
    """Rows of tiles, each tile's together, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        out = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            plain = [batch.column(i).to_pylist() for i in range(3, 10)]
            for key, *row in zip(keys, *plain, strict=True):
                if key != tile:
                    if rows:
                        yield out(*_compare_tile(rows, percent, miss))
                    tile, rows = key, []
                rows.append(tuple(row))
        if rows:
            yield out(*_compare_tile(rows, percent, miss))

    return run


def _between(members: DataFrame, labels: DataFrame, features: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links between different components of documents whose bands connect them.

    In each such group, the members outside of the largest component (minor) are compared with all
    others in tiles of bounded size; a tile's rows are documents, not pairs.
    """
    groups = components(members.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")))
    own = groups.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "g").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = written(own.select("doc_id", "g", F.coalesce("component", "doc_id").alias("c")).join(members.select("doc_id", "n").distinct(), "doc_id"), "grouped")
    parts = own.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k"))
    split = parts.groupBy("g").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    split = split.select("g", F.col("top.c").alias("main"), F.ceil(F.col("m") / STAR).cast("int").alias("sy"), F.ceil((F.col("m") - F.col("top.k")) / STAR).cast("int").alias("sx"))
    mixed_groups = own.join(split, "g")
    spot = lambda of: F.pmod(F.hash("doc_id"), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    minor = mixed_groups.where("c <> main").select("g", spot("sx").alias("x"), each("sy").alias("y"), F.lit(0).alias("kind"), "doc_id", "n", "c")
    other = mixed_groups.select("g", each("sx").alias("x"), spot("sy").alias("y"), F.lit(1).alias("kind"), "doc_id", "n", "c")
    rows = minor.unionByName(other).join(features, "doc_id").select("g", "x", "y", "kind", "doc_id", "n", "c", "sig", "bands", "shingles")
    dealt = rows.repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", "kind")
    return written(dealt.mapInArrow(tidied(_tiles(percent, miss)), "a bigint, b bigint"), "between")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, miss: float = 1e-9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and split at ASCII white space. A text's set is its distinct runs of
    ``shingle`` words; with fewer words, the whole sequence as one; without words (or null), empty and
    linked with nothing. Texts are linked where 100 * intersection >= percent * union; component_id is
    the smallest doc_id reachable and kept is doc_id = component_id. One row per input row: rows that
    repeat a doc_id are judged each by its own text; a row with a null doc_id links with nothing, has a
    null component_id and is kept. Other columns are ignored; an empty table gives no rows.

    A pair at the threshold is missed by the bands with probability (1 - 0.8^6)^40 = 5e-6 and by the
    signature comparison with about ``miss``; verification is exact, on sets of 64-bit hashes.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    docs = id_text(docs, id_col, text_col)
    all_docs = written(docs.mapInArrow(tidied(_sketch(shingle)), "doc_id bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>"), "sketches")
    some = all_docs.where("n > 0 and doc_id is not null")
    classes = written(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    banded = reps.select("doc_id", "n", F.explode("bands").alias("band"))
    # combined before the bands meet, and joined back: a band that very many texts share is one row here and may be split there
    buckets = banded.groupBy("band").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", F.col("first.doc_id").alias("leader"), F.col("first.n").alias("leader_n"))
    members = written(banded.join(buckets, "band").select("band", "doc_id", "n", "leader", "leader_n"), "members")
    fits = lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)
    candidates = members.select("doc_id").distinct()
    features = written(docs.join(candidates.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(tidied(_features(shingle)), "doc_id bigint, sig binary, bands binary, shingles binary"), "features")
    stars = members.where("doc_id <> leader").where(fits(F.col("n"), F.col("leader_n"))).select("leader", F.col("doc_id").alias("member")).distinct()
    links = _verified(stars, features, percent, miss)
    labels = components(links)
    links2 = _between(members, labels, features, percent, miss)
    if links2.limit(1).count():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links2.select("a", "b")))
    release(members, features)
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.lit(1).alias("some"), F.coalesce("component", "rep").alias("component_id"))
    out = all_docs.select("doc_id", "n", "h1", "h2", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), 1).alias("some")).join(named, ["h1", "h2", "some"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, *, shingle: int = 5, percent: int = 80, miss: float = 1e-9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which each near-duplicate group keeps one.

    Rows that repeat both the id and the text of a kept document are copies, and one of them stays;
    rows without an id stay. Cases otherwise as in near_duplicates().
    """
    kept = near_duplicates(docs, shingle=shingle, percent=percent, miss=miss, id_col=id_col, text_col=text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    text, rank = "__keep_text", "__keep_rank"
    known = F.col(id_col).isNotNull()
    own = docs.where(known).join(kept.hint("shuffle_hash"), id_col, "left_semi").withColumn(text, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    first = own.withColumn(rank, F.row_number().over(Window.partitionBy(id_col, text).orderBy(id_col))).where(F.col(rank) == 1)
    return first.select(*docs.columns).unionByName(docs.where(~known))
