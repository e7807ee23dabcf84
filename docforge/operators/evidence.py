"""Quotations and evidence: containment, replay, gates, conflicts and review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T

# Zones that own a field, and zones of page furniture.
OWNING = {"title": ("title", "cover", "statement_of_responsibility"), "publisher": ("imprint", "copyright", "cip")}
FURNITURE = ("running_head", "contents")


def _anchors(words: Column, n: int) -> Column:
    """Hashes of all runs of n words."""
    last = F.size(words) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))))).otherwise(F.array().cast("array<bigint>"))


def contained(quotes: DataFrame, docs: DataFrame, *, n: int = 4) -> DataFrame:
    """Pairs (item_id, doc_id, quote, text) where the lower-case text of a quote occurs in a document's.

    A quote and a document meet at one run of n inner words of the quote (its ends may touch other text): the one
    that is in the fewest documents. Shorter quotes meet at an inner word, those of one or two words at three
    characters. Only ids and hashes are shuffled before a pair is known; then its texts are fetched and compared.
    """
    q = quotes.select("item_id", F.lower("text").alias("quote")).where("quote <> ''").withColumn("w", F.split("quote", r"\s+"))
    d = docs.select("doc_id", F.lower("text").alias("text")).withColumn("w", F.split("text", r"\s+"))
    inner = F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))
    found = None
    for runs, of_docs, cond in (
        (_anchors(inner, n), _anchors(F.col("w"), n), F.size("w") >= n + 2),
        (_anchors(inner, 1), _anchors(F.col("w"), 1), (F.size("w") >= 3) & (F.size("w") < n + 2)),
        (_grams(F.col("quote")), _grams(F.col("text")), F.size("w") < 3),
    ):
        wanted = q.where(cond).select("item_id", F.explode(runs).alias("anchor"))
        hits = d.select("doc_id", F.explode(of_docs).alias("anchor")).join(wanted.select("anchor").distinct(), "anchor", "left_semi")
        spread = hits.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
        rarest = wanted.join(spread, "anchor", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor")).alias("m")).where("m.n > 0").select("item_id", "m.anchor")
        part = hits.join(rarest, "anchor").select("item_id", "doc_id").distinct()
        found = part if found is None else found.unionByName(part)
    return found.join(q.select("item_id", "quote"), "item_id").join(d.select("doc_id", "text"), "doc_id").where(F.expr("contains(text, quote)")).select("item_id", "doc_id", "quote", "text")


def _grams(c: Column) -> Column:
    """Hashes of all runs of three characters; of the whole text where it is shorter."""
    last = F.greatest(F.length(c) - 2, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substring(c, i, F.lit(3)))))


def replayed(pairs: DataFrame, context: int = 45) -> DataFrame:
    """Occurrences of a quote in its documents, overlaps counted (E05): item_id, doc_id, n, first_pos, context."""
    literal = F.concat(F.lit("(?=\\Q"), F.replace("quote", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    p = pairs.withColumn("n", F.regexp_count("text", literal).cast("long")).withColumn("first_pos", F.instr("text", F.col("quote")).cast("long"))
    begin = F.greatest(F.lit(1), F.col("first_pos") - context)
    return p.select("item_id", "doc_id", "n", "first_pos", F.substring("text", begin, F.col("first_pos") + F.length("quote") + context - begin).alias("context"))


def replay_status(occurrences: DataFrame, quotes: DataFrame) -> DataFrame:
    """match for one occurrence, ambiguous for several, not_found for none: item_id, status, candidate_count."""
    n = occurrences.groupBy("item_id").agg(F.sum("n").alias("candidate_count"))
    count = F.coalesce("candidate_count", F.lit(0))
    return quotes.select("item_id").join(n, "item_id", "left").select("item_id", F.when(count == 0, "span_not_found").when(count == 1, "extraction-match").otherwise("ambiguous_span").alias("status"), count.cast("long").alias("candidate_count"))


def owns(field: Column, zone: Column) -> Column:
    """Whether a zone may supply a field at full confidence."""
    out = ~F.coalesce(zone.isin(*FURNITURE), F.lit(False))
    for name, zones in OWNING.items():
        out = F.when(field == name, F.coalesce(zone.isin(*zones), F.lit(False))).otherwise(out)
    return out


def confidence(reason: Column, field: Column, zone: Column) -> Column:
    """The ladder of match reason and zone."""
    return (
        F.when((reason == "degenerate_zone") | zone.isin(*FURNITURE), 0.60)
        .when(reason == "weak_marker", 0.50)
        .when(reason == "seed", 0.90)
        .when((reason == "exact") & owns(field, zone), 0.95)
        .when(reason == "exact", 0.80)
        .when(reason == "normalised", 0.90)
        .when(reason == "joined", 0.85)
        .cast("double")
    )


def review_queue(scored: DataFrame, drops: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Fields below the threshold and dropped fields (at 0), with their place by confidence and field.

    Columns: record_id, field, confidence (drops without it).
    """
    low = scored.where(F.col("confidence") < threshold).select("record_id", "field", "confidence")
    queue = low.unionByName(drops.select("record_id", "field", F.lit(0.0).alias("confidence")))
    return queue.withColumn("place", F.row_number().over(Window.partitionBy("record_id").orderBy("confidence", "field")).cast("long"))


def merged_without_conflict(changes: DataFrame) -> DataFrame:
    """New values apply only if no field of the record is in conflict.

    Columns: record_id, field, old, new, supported (whether the source supports the new value).
    """
    differs = F.col("new").isNotNull() & F.col("old").isNotNull() & (T.squeezed(F.lower("old")) != T.squeezed(F.lower("new")))
    conflict = differs & ~F.col("supported")
    void = F.max(conflict).over(Window.partitionBy("record_id"))
    value = F.when(~void & F.col("new").isNotNull() & F.col("supported"), F.col("new")).otherwise(F.col("old"))
    state = F.when(conflict, "conflicting").when(F.col("supported") & F.col("new").isNotNull(), "source-supported").when(F.col("old").isNull(), "missing").otherwise("unverified")
    return changes.select("record_id", "field", value.alias("value"), state.alias("state"), void.alias("void"))


def filled(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Empty fields take the first provider's value in order; decisions are kept.

    records: record_id, field, value. candidates: record_id, field, provider, priority, candidate.
    """
    best = candidates.where("candidate is not null").groupBy("record_id", "field").agg(F.min(F.struct("priority", "provider", "candidate")).alias("m"))
    own = records.join(best, ["record_id", "field"], "left")
    empty = F.coalesce(F.trim("value"), F.lit("")) == ""
    action = F.when(empty & F.col("m").isNotNull(), "filled").when(empty, "missing").when(F.col("m").isNull() | (F.lower("value") == F.lower("m.candidate")), "kept").otherwise("conflict")
    return own.select("record_id", "field", F.when(empty, F.col("m.candidate")).otherwise(F.col("value")).alias("value"), F.when(empty, F.col("m.provider")).alias("provider"), action.alias("action"))


def quotation_rows(blocks: DataFrame) -> DataFrame:
    """Portable spans (E06): span_id is a hash of the source and the locator; of equal ids the last stays.

    Columns: source_id, block_id, page, text, ord.
    """
    locator = F.concat_ws("|", F.col("source_id"), F.col("page"), F.col("block_id"), F.lit(0), F.length("text"))
    rows = blocks.withColumn("span_id", F.sha2(locator, 256))
    return rows.groupBy("span_id").agg(F.max_by(F.struct("source_id", "block_id", "page", "text"), "ord").alias("m")).select("span_id", "m.*", F.concat(F.lit("page "), F.col("m.page")).alias("label"))


def distinct_evidence(*parts: DataFrame) -> DataFrame:
    """Ordered union of evidence with exact duplicates of (quote, locator) removed (U04): columns ord, quote, locator."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("quote", "locator").agg(F.min("ord").alias("ord"))


def paired_anchors(anchors: DataFrame) -> DataFrame:
    """Two anchors of one page and quote, of which exactly one has a block id, become one.

    Columns: doc_id, page, quote, block_id, bbox.
    """
    own = Window.partitionBy("doc_id", "page", "quote")
    pair = (F.count(F.lit(1)).over(own) == 2) & (F.count("block_id").over(own) == 1)
    merged = anchors.withColumn("pair", pair).withColumn("b", F.max("block_id").over(own)).withColumn("x", F.max("bbox").over(own))
    one = F.col("pair") & F.col("block_id").isNotNull()
    return merged.where(~F.col("pair") | one).select("doc_id", "page", "quote", F.when(F.col("pair"), F.col("b")).otherwise(F.col("block_id")).alias("block_id"), F.when(F.col("pair"), F.col("x")).otherwise(F.col("bbox")).alias("bbox"))
