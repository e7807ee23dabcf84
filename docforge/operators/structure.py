"""Documents to lines, nodes, Merkle trees, sections, islands and page maps.

Order is always explicit: lines carry their number, sections their start line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T

MERKLE_LEVELS = 40


def lines(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, source, lang, line_no (from 0), line. A null text has no lines."""
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def nodes(lines_: DataFrame, page: Column | None = None) -> DataFrame:
    """Content-addressed text units, one per non-empty line (G01): doc_id, node_id, page, paragraph, sha256."""
    text = T.squeezed(F.col("line"))
    page = F.lit(1).cast("long") if page is None else page.cast("long")
    out = lines_.select("doc_id", page.alias("page"), (F.col("line_no") + 1).alias("paragraph"), text.alias("t")).where("t <> ''").withColumn("sha256", F.sha2("t", 256))
    name = F.concat(F.lit("doc"), F.col("doc_id"), F.lit(":p"), F.col("page"), F.lit(":para"), F.col("paragraph"), F.lit(":"), F.substring("sha256", 1, 8))
    return out.select("doc_id", name.alias("node_id"), "page", "paragraph", "sha256")


def _pairs(level: Column) -> Column:
    n = F.size(level)
    left = lambda k: F.get(level, 2 * k)
    return F.transform(F.sequence(F.lit(0), ((n + 1) / 2).cast("int") - 1), lambda k: F.sha2(F.concat(left(k), F.coalesce(F.get(level, 2 * k + 1), left(k))), 256))


def leaves(nodes_: DataFrame) -> DataFrame:
    """The leaf hashes of each document in the order of node ids."""
    return nodes_.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "sha256"))), lambda s: s.sha256).alias("leaves"))


def merkle_roots(nodes_: DataFrame) -> DataFrame:
    """Merkle root of each document's nodes (A11): pairs are hashed as joined hex; an odd last one pairs with itself."""
    root = F.aggregate(F.sequence(F.lit(1), F.lit(MERKLE_LEVELS)), F.col("leaves"), lambda level, _: F.when(F.size(level) > 1, _pairs(level)).otherwise(level))
    return leaves(nodes_).select("doc_id", F.size("leaves").cast("long").alias("leaf_count"), F.get(root, F.lit(0)).alias("root"))


def merkle_proofs(nodes_: DataFrame, leaf: Column) -> DataFrame:
    """Sibling path of one leaf per document (E17): doc_id, level, position, hash. ``leaf`` may use leaf_count."""
    levels = F.aggregate(
        F.sequence(F.lit(1), F.lit(MERKLE_LEVELS)),
        F.array(F.col("leaves")),
        lambda done, _: F.when(F.size(F.element_at(done, -1)) > 1, F.concat(done, F.array(_pairs(F.element_at(done, -1))))).otherwise(done),
    )
    own = leaves(nodes_).withColumn("leaf_count", F.size("leaves").cast("long"))
    own = own.select("doc_id", leaf.cast("long").alias("leaf"), F.posexplode(levels).alias("level", "hashes")).where(F.size("hashes") > 1)
    at = F.floor(F.col("leaf") / F.pow(F.lit(2), F.col("level"))).cast("int")
    sibling = at.bitwiseXOR(F.lit(1))
    inside = F.when(sibling < F.size("hashes"), sibling).otherwise(at)
    return own.select("doc_id", F.col("level").cast("long").alias("level"), F.when(inside > at, "right").otherwise("left").alias("position"), F.get("hashes", inside).alias("hash"))


def hierarchical_roots(lines_: DataFrame, lines_per_page: int = 10) -> DataFrame:
    """Line, page and document hashes, each of its joined children (A12): doc_id, n_pages, root."""
    hashed = lines_.select("doc_id", F.expr(f"line_no div {lines_per_page}").alias("page"), "line_no", F.sha2(T.squeezed(F.col("line")), 256).alias("h"))

    def joined(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct(order, value)))
        return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(own, lambda s: s[value]), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))

    pages = joined(hashed, ["doc_id", "page"], "line_no", "h").drop("n")
    return joined(pages, ["doc_id"], "page", "h").select("doc_id", F.col("n").alias("n_pages"), F.col("h").alias("root"))


def section_parents(headings: DataFrame, max_level: int = 6) -> DataFrame:
    """Parent of each heading: the nearest one before it with a smaller level.

    One running maximum per level, so no join: columns doc_id, line_no, level gain parent (null at the top).
    """
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("long")
    for level in range(max_level, 1, -1):
        parent = F.when(F.col("level") == level, F.max(F.when(F.col("level") < level, F.col("line_no"))).over(before)).otherwise(parent)
    return headings.select("*", parent.alias("parent"))


def section_spans(headings: DataFrame, ends: DataFrame) -> DataFrame:
    """Last line of each section: before the next heading of its level or above, or the document's end.

    ``ends`` has doc_id and last_line.
    """
    after = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    end = F.lit(None).cast("long")
    for level in range(6, 0, -1):
        end = F.when(F.col("level") == level, F.min(F.when(F.col("level") <= level, F.col("line_no"))).over(after)).otherwise(end)
    return headings.withColumn("next_start", end).join(ends, "doc_id").select("doc_id", "level", F.col("line_no").alias("start_line"), F.coalesce(F.col("next_start") - 1, "last_line").alias("end_line"))


def _covering(points: DataFrame, spans: DataFrame, max_level: int = 6) -> DataFrame:
    """Each point (doc_id, line_no) with its covering sections, as an array of (level, start_line, end_line).

    Sections of one level don't overlap, so the last one of each level that began is the only one that may cover a
    point: one running value per level, no join.
    """
    kind = lambda k: F.lit(k).alias("kind")
    none = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    begins = spans.select("doc_id", F.col("start_line").alias("line_no"), kind(0), F.col("level").cast("long").alias("level"), F.col("end_line").cast("long").alias("end_line"))
    both = begins.unionByName(points.select("doc_id", "line_no", kind(1), *none("level", "end_line")))
    so_far = Window.partitionBy("doc_id").orderBy("line_no", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == k, F.struct("level", F.col("line_no").alias("start_line"), "end_line")), True).over(so_far).alias(f"s{k}") for k in range(1, max_level + 1)]
    own = both.select("doc_id", "line_no", "kind", *last).where("kind = 1")
    return own.select("doc_id", "line_no", F.filter(F.array(*(f"s{k}" for k in range(1, max_level + 1))), lambda x: x.end_line >= F.col("line_no")).alias("covering")).where(F.size("covering") > 0)


def deepest_section(points: DataFrame, spans: DataFrame) -> DataFrame:
    """For each point (doc_id, line_no) the covering section of greatest level, latest start (J04). Sections of one level don't overlap."""
    deepest = F.array_max("covering")
    return _covering(points, spans).select("doc_id", "line_no", deepest.level.alias("level"), deepest.start_line.alias("start_line"), F.size("covering").cast("long").alias("n_covering"))


def first_claims(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Each item (doc_id, line_no) goes to the first span that covers it, by start and then end (J03). Spans of one level don't overlap."""
    first = F.array_min(F.transform("covering", lambda x: F.struct(x.start_line.alias("start_line"), x.end_line.alias("end_line"))))
    return _covering(items, spans).select("doc_id", "line_no", first.start_line.alias("start_line"), first.end_line.alias("end_line"))


def islands(points: DataFrame, key: str, value: str) -> DataFrame:
    """Runs of consecutive integers (W08): key, first, last, and the compressed list of each key as spec."""
    own = points.select(key, value).distinct()
    run = own.withColumn("run", F.col(value) - F.row_number().over(Window.partitionBy(key).orderBy(value))).groupBy(key, "run").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat("a", F.lit("-"), "b"))
    return run.groupBy(key).agg(F.count(F.lit(1)).alias("n_runs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", label.alias("s")))), lambda x: x.s), ",").alias("spec"))


def columns_of(boxes: DataFrame, key: str, x0: str, x1: str, gap: float) -> DataFrame:
    """Gaps and islands on the x axis (W07): a new column where a box starts more than ``gap`` right of all before."""
    order = Window.partitionBy(key).orderBy(x0, x1)
    reach = F.max(x1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flag = F.when(F.col(x0) - reach > gap, 1).otherwise(0)
    numbered = boxes.withColumn("cut", flag).withColumn("column_no", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "column_no").agg(F.count(F.lit(1)).alias("n"), F.min(x0).alias("x0"), F.max(x1).alias("x1"))


def offset_vote(candidates: DataFrame, key: str) -> DataFrame:
    """Modal difference of candidate and index (A04); ties go to the one seen first. Columns key, idx, candidate."""
    votes = candidates.withColumn("offset", F.col("candidate") - F.col("idx")).groupBy(key, "offset").agg(F.count(F.lit(1)).alias("votes"), F.min("idx").alias("first_idx"))
    return votes.groupBy(key).agg(F.max_by(F.struct("offset", "votes"), F.struct("votes", -F.col("first_idx"))).alias("m")).select(key, F.col("m.offset").alias("offset"), F.col("m.votes").alias("votes"))


def filled_numbers(pages: DataFrame, key: str) -> DataFrame:
    """Missing numbers by distance from the last known one, or the next (W11). Columns key, idx, number."""
    order = Window.partitionBy(key).orderBy("idx")
    base = F.col("number") - F.col("idx")
    last = F.last(base, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(base, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return pages.select(key, "idx", (F.col("idx") + F.coalesce(last, nxt)).alias("number"))


def ordinal_join(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The k-th row of a key on the left meets the k-th on the right (J01). Other columns get suffixes _l and _r."""
    ranked = lambda df, side: df.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long").alias("k"), *[F.col(o).alias(f"{o}_{side}") for o in order])
    return ranked(left, "l").join(ranked(right, "r"), [*keys, "k"])


def first_interval(points: DataFrame, intervals: DataFrame, key: str, day: str = "day") -> DataFrame:
    """The first interval (by start, id) that holds a point.

    Both sides are bucketed by whole days, so the join is an equi-join; intervals span the days they touch.
    Points: key, point_id, at. Intervals: key, interval_id, start, stop (seconds).
    """
    p = points.withColumn(day, F.floor(F.col("at") / 86400))
    i = intervals.withColumn(day, F.explode(F.sequence(F.floor(F.col("start") / 86400), F.floor(F.col("stop") / 86400))))
    hit = p.join(i, [key, day]).where("at between start and stop")
    return hit.groupBy(key, "point_id").agg(F.min(F.struct("start", "interval_id")).alias("m")).select(key, "point_id", F.col("m.interval_id").alias("interval_id"))


def within_budget(blocks: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """Blocks taken in order until the budget is spent, the last one cut (W10): key, order, taken."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.select(key, order, F.greatest(F.lit(0), F.least(size, F.lit(budget) - before)).cast("long").alias("taken")).where("taken > 0")


def title_runs(points: DataFrame, key: str, value: str, gap: int) -> DataFrame:
    """The front run of sampled values: the first island in which no step exceeds ``gap``."""
    order = Window.partitionBy(key).orderBy(value)
    step = F.when(F.col(value) - F.lag(value).over(order) > gap, 1).otherwise(0)
    numbered = points.withColumn("cut", step).withColumn("run", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("run = 0").groupBy(key).agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n"))


def folded_chunks(segments: DataFrame, key: str, order: str, at: str, length: float) -> DataFrame:
    """Chunks by a fold (W06): a segment opens a new one when it begins ``length`` or more after the chunk's start.

    A chunk's start is that of the segment that opened it, so this is no tumbling window. The fold runs over each
    key's ordered array: key, order, chunk_no, chunk_start.
    """
    own = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("at"), F.col(order).alias("id")))).alias("segs"))
    zero = F.struct(F.lit(None).cast("double").alias("start"), F.lit(-1).cast("long").alias("no"), F.array().cast("array<struct<id:bigint,chunk_no:bigint,chunk_start:double>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        opens = a.start.isNull() | (s.at - a.start >= length)
        start, no = F.when(opens, s.at).otherwise(a.start), F.when(opens, a.no + 1).otherwise(a.no)
        return F.struct(start.alias("start"), no.alias("no"), F.concat(a.out, F.array(F.struct(s.id.alias("id"), no.alias("chunk_no"), start.alias("chunk_start")))).alias("out"))

    return own.select(key, F.explode(F.aggregate("segs", zero, step, lambda a: a.out)).alias("c")).select(key, F.col("c.id").alias(order), "c.chunk_no", "c.chunk_start")
