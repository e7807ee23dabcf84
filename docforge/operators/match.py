"""Entities and works against reference tables, with an explicit margin."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T

# Acceptance thresholds and (similarity, embedding, anchor) weights, with and without embeddings.
THRESHOLDS = {"person": 0.85, "place": 0.80, "journal": 0.90, "work": 0.90}
WEIGHTS = {"person": ((0.5, 0.3, 0.2), (0.7, 0.0, 0.3)), "place": ((0.6, 0.25, 0.15), (0.85, 0.0, 0.15)), "journal": ((0.7, 0.3, 0.0), (1.0, 0.0, 0.0))}
MARGIN = 0.05


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length of the plain forms; 0 if one is empty (X19 surrogate)."""
    x, y = T.plain(a), T.plain(b)
    return F.when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def entity_score(kind: str, similarity: Column, anchor: Column, embedding: Column | None = None) -> Column:
    """Weighted score of an entity match."""
    with_, without = WEIGHTS[kind]
    if embedding is None:
        return without[0] * similarity + without[2] * anchor
    return F.when(embedding.isNull(), without[0] * similarity + without[2] * anchor).otherwise(with_[0] * similarity + with_[1] * embedding + with_[2] * anchor)


def top_with_margin(scored: DataFrame, key: str, candidate: str, score: str, threshold: float, margin: float = MARGIN) -> DataFrame:
    """The best candidate of each key if it reaches the threshold and leads by the margin.

    Candidates count once, by their best score. key, candidate (null unless linked), score, decision.
    """
    once = scored.groupBy(key, candidate).agg(F.max(score).alias(score))
    order = Window.partitionBy(key).orderBy(F.desc(score), candidate)
    first = once.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead(score).over(order)).where("r = 1")
    decision = F.when(F.col(score) < threshold, "below_threshold").when(F.col("second").isNotNull() & (F.round(F.col(score) - F.col("second"), 9) < margin), "ambiguous_identity").otherwise("linked")
    return first.select(key, F.when(decision == "linked", F.col(candidate)).alias(candidate), score, decision.alias("decision"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def name_tokens(c: Column) -> Column:
    """A name as its sorted distinct lower-case tokens."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"[\s,.\-]+"), lambda t: t != "")))


def given_agrees(a: Column, b: Column) -> Column:
    """Given names do not contradict: one is missing, they are equal, or one is the other's initial."""
    x, y = F.split(T.plain(a), " ")[0], F.split(T.plain(b), " ")[0]
    return (x == "") | (y == "") | (x == y) | ((F.substring(x, 1, 1) == F.substring(y, 1, 1)) & (F.least(F.length(x), F.length(y)) == 1))


def same_names(a: Column, b: Column) -> Column:
    """Whether two arrays of names have equal token sets, place by place."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: name_tokens(x) == name_tokens(y)), lambda e: F.coalesce(e, F.lit(False)))


#: Bytes of a reference table that every task holds at most.
FEW_BYTES = 64 << 20


def against_few(rows: DataFrame, few: DataFrame, key: str, value: str, score: Callable[[Column, Column], Column], column: str) -> DataFrame:
    """Each row with its score against every entry of a reference table (V02): the row's columns, key, score.

    The table is a stated set, such as a centroid for each label. Up to FEW_BYTES it is sent to all tasks as one value
    (its size is counted first); a larger one is taken in blocks of that size, in passes over the rows.
    """
    sized = few.agg(F.coalesce(F.sum(F.size(value) * 8 + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(sized / FEW_BYTES))
    out = None
    for b in range(blocks):
        own = few.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).agg(F.collect_list(F.struct(key, value)).alias("__few"))
        part = rows.join(F.broadcast(own)).select(*rows.columns, F.explode(F.transform("__few", lambda f: F.struct(f[key].alias(key), score(F.col(column), f[value]).alias("score")))).alias("__f")).select(*rows.columns, "__f.*")
        out = part if out is None else out.unionByName(part)
    return out
