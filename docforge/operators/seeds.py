"""Deterministic candidates of a record's fields, and the cascade that settles them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import catalog
from docforge.functions import text as T
from docforge.operators import zones

# Labels of an abstract and of keywords, words before a person, and fields that a front-matter rule may fill.
ABSTRACT, KEYWORDS = r"(?i)^\s*(?:abstract|summary|摘\s*要)\s*[:：]?", r"(?i)^\s*(?:key\s*words?|关键[词字])\s*[:：]?"
CREDITS = {"author": r"^(?:by|von|par|por)\s+(\p{Lu}[\p{L}\p{N}_.'’ -]{2,60})$", "translator": r"(?i)^(?:translated by|aus dem .* von|traduit par|traducido por)\s+(\p{L}[\p{L}\p{N}_.'’ -]{2,60})$", "editor": r"(?i)^(?:edited by|herausgegeben von|édité par|editado por)\s+(\p{L}[\p{L}\p{N}_.'’ -]{2,60})$"}
ISSN = r"(?i)ISSN\s*[:：]?\s*(\d{4}-\d{3}[\dX])"
ARTICLE_CODE = r"(\d{4}-\d{3}[\dX])\s*[（(](\d{4})[)）]\s*(\d{2})-(\d{4})-(\d{2})"


def candidates(blocks: DataFrame) -> DataFrame:
    """Field candidates of each document's blocks by rule: doc_id, field, value, rule (its place in the order), line_no.

    Columns: doc_id, line_no, line, zone (of label_zones). Titles come from title zones, credits from lines as a
    whole, years from imprint, copyright and title zones, publishers from imprint lines, and the catalogue's
    fields from its blocks. Running heads and contents give nothing.
    """
    t = T.stripped(F.col("line"))
    year = F.regexp_extract(t, r"(?:^|\D)((?:1[5-9]|20)\d{2})(?:\D|$)", 1)
    rules = [
        ("title", 1, F.when(F.col("zone") == "title", t)),
        *((field, 2, F.nullif(F.regexp_extract(t, p, 1), F.lit(""))) for field, p in CREDITS.items()),
        ("publisher", 3, F.when(F.col("zone") == "imprint", F.nullif(F.regexp_replace(F.regexp_extract(t, zones.IMPRINT, 1), r"[ .,]+$", ""), F.lit("")))),
        ("issued", 4, F.when(F.col("zone").isin("imprint", "copyright", "title"), F.nullif(year, F.lit("")))),
    ]
    one = lambda f, r, v: F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(r).cast("long").alias("rule"))
    catalogued = F.transform(F.when(F.col("zone") == "cip", catalog.cip(t)).otherwise(F.array().cast(catalog.CANDIDATES)), lambda c: F.struct(c.field.alias("field"), c.value.alias("value"), F.lit(0).cast("long").alias("rule")))
    every = F.concat(catalogued, F.array(*(one(*r) for r in rules)))
    return blocks.where(~F.col("zone").isin("running_head", "contents")).select("doc_id", "line_no", F.explode(F.filter(every, lambda c: c.value.isNotNull())).alias("c")).select("doc_id", "c.field", "c.value", "c.rule", "line_no")


def seeds(found: DataFrame) -> DataFrame:
    """The candidate of each field by rule order, then place: doc_id, field, value, rule, line_no."""
    order = Window.partitionBy("doc_id", "field").orderBy("rule", "line_no", "value")
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def settled(seeded: DataFrame, drafted: DataFrame) -> DataFrame:
    """Seeds against another layer's drafts (E14): a seed beats a draft, a draft fills what no seed does, and both are kept where they differ.

    Columns of both: doc_id, field, value. Result: doc_id, field, value, origin, other.
    """
    a, b = seeded.select("doc_id", "field", F.col("value").alias("seed")), drafted.select("doc_id", "field", F.col("value").alias("draft"))
    j = a.join(b, ["doc_id", "field"], "full")
    differs = F.col("seed").isNotNull() & F.col("draft").isNotNull() & (T.plain(F.col("seed")) != T.plain(F.col("draft")))
    return j.select("doc_id", "field", F.coalesce("seed", "draft").alias("value"), F.when(F.col("seed").isNotNull(), "seed").otherwise("draft").alias("origin"), F.when(differs, F.col("draft")).alias("other"))


def self_citations(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """The first run of up to three lines that is a reference to the page itself (J11): doc_id, line_no, n_lines, citation, title.

    lines: doc_id, line_no, line. titles: doc_id, page_title. Runs of up to 600 characters with a mark are read.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    w = lines.withColumn("a", T.stripped(F.col("line"))).withColumn("b", F.lead(T.stripped(F.col("line")), 1, "").over(order)).withColumn("c", F.lead(T.stripped(F.col("line")), 2, "").over(order))
    runs = F.array(F.struct(F.lit(1).alias("n"), F.col("a").alias("t")), F.struct(F.lit(2).alias("n"), F.trim(F.concat_ws(" ", "a", F.nullif("b", F.lit("")))).alias("t")), F.struct(F.lit(3).alias("n"), F.trim(F.concat_ws(" ", "a", F.nullif("b", F.lit("")), F.nullif("c", F.lit("")))).alias("t")))
    each = w.where("a <> ''").select("doc_id", "line_no", F.explode(F.filter(runs, lambda r: r.t.contains("[") & (F.length(r.t) <= 600))).alias("r"))
    read = each.select("doc_id", "line_no", F.col("r.n").cast("long").alias("n_lines"), F.col("r.t").alias("citation"), catalog.reference(F.col("r.t")).alias("x")).where("x is not null")
    own = read.join(titles.select("doc_id", "page_title"), "doc_id").where(catalog.titles_match(F.col("x.title"), F.col("page_title")))
    return own.groupBy("doc_id").agg(F.min(F.struct("line_no", "n_lines", "citation", F.col("x.title").alias("title"))).alias("m")).select("doc_id", "m.*")


def pattern_fields(items: DataFrame) -> DataFrame:
    """Fields of a first page by pattern (X15): doc_id, title, author, keywords, issn, year, issue, first_page, last_page.

    Columns: doc_id, ord, page, level, text. The first text of level 1 on page 0 is the title, the next text
    there the authors, unless a label begins it. A journal's article code gives number, year, issue and pages.
    """
    own = items.where(T.stripped(F.col("text")) != "")
    on = F.when((F.col("page") == 0) & (F.col("level") == 1), F.col("ord"))
    w = own.withColumn("title_at", F.min(on).over(Window.partitionBy("doc_id")))
    after = F.min(F.when((F.col("page") == 0) & (F.col("ord") > F.col("title_at")), F.col("ord"))).over(Window.partitionBy("doc_id"))
    w = w.withColumn("author_at", after)
    first = lambda value, when: F.min_by(value, F.when(when, F.col("ord")))
    t = F.col("text")
    fields = w.groupBy("doc_id").agg(
        first(t, F.col("ord") == F.col("title_at")).alias("title"),
        first(t, (F.col("ord") == F.col("author_at")) & ~t.rlike(ABSTRACT) & ~t.rlike(KEYWORDS) & ~t.rlike(r"(?i)^(?:doi\s*:\s*)?10\.\d{4,9}/")).alias("author"),
        first(T.stripped(F.regexp_replace(t, KEYWORDS, "")), t.rlike(KEYWORDS)).alias("keywords"),
        first(F.regexp_extract(t, ISSN, 1), t.rlike(ISSN)).alias("issn"),
        first(F.regexp_extract(t, ARTICLE_CODE, 0), t.rlike(ARTICLE_CODE)).alias("code"),
    )
    g = lambda i: F.nullif(F.regexp_extract("code", ARTICLE_CODE, i), F.lit(""))
    begin = g(4).try_cast("long")
    return fields.select("doc_id", "title", "author", "keywords", F.coalesce("issn", g(1)).alias("issn"), g(2).try_cast("long").alias("year"), g(3).try_cast("long").alias("issue"), begin.alias("first_page"), (begin + g(5).try_cast("long") - 1).alias("last_page"))


def between_known(pages: DataFrame, key: str) -> DataFrame:
    """For each missing page the range to search: from the last known one (0) to the next known one (-1, which is empty).

    Columns: key, idx, page. Result: key, idx, low, high.
    """
    order = Window.partitionBy(key).orderBy("idx")
    low = F.coalesce(F.last("page", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    high = F.coalesce(F.first("page", True).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(-1))
    return pages.select(key, "idx", "page", low.cast("long").alias("low"), high.cast("long").alias("high")).where("page is null").drop("page")


def title_appears(title: Column, text: Column) -> tuple[Column, Column]:
    """Whether a title occurs in a page's text, and whether the text begins with it, but for case and white space."""
    t, x = T.compact(title), T.compact(text)
    return (t != "") & (F.instr(x, t) > 0), (t != "") & (F.instr(x, t) == 1)


def sequence_scores(pages: DataFrame, key: str) -> DataFrame:
    """How well printed numbers follow page indexes (A21): n pairs and their mean, 100 for the same step, 50 within one, else -50; 20 more if all lie in 1..1000.

    Columns: key, idx, number (one per page). Sequences of fewer than two pages score 0.
    """
    order = Window.partitionBy(key).orderBy("idx")
    want, got = F.col("idx") - F.lag("idx").over(order), F.col("number") - F.lag("number").over(order)
    gain = F.when((got == want) & (got > 0), 100).when(F.abs(got - want) <= 1, 50).when(got.isNotNull(), -50)
    s = pages.withColumn("gain", gain).groupBy(key).agg(F.count("gain").alias("n_pairs"), F.avg("gain").alias("mean"), (F.min("number").between(1, 1000) & F.max("number").between(1, 1000)).alias("plain"))
    return s.select(key, "n_pairs", F.when(F.col("n_pairs") == 0, 0.0).otherwise(F.col("mean") + F.when(F.col("plain"), 20).otherwise(0)).cast("double").alias("score"))


def best_sequences(found: DataFrame, key: str) -> DataFrame:
    """Of all readings of a page's number, the sequence that scores best (A21): key, idx, number.

    Columns: key, idx, number (several per page). A sequence with the same step throughout is one offset of number
    and index, so offsets are scored, not combinations: the one with the longest run wins, then the higher score,
    the smaller offset; pages that it does not read take no number.
    """
    own = found.select(key, "idx", "number").distinct().withColumn("offset", F.col("number") - F.col("idx"))
    scored = sequence_scores(own.withColumn("of", F.struct(key, "offset")), "of").select("of.*", "n_pairs", "score")
    best = scored.groupBy(key).agg(F.max_by("offset", F.struct("n_pairs", "score", -F.col("offset"))).alias("offset"))
    return own.join(best, [key, "offset"]).select(key, "idx", "number")


def position_pattern(bands: DataFrame, key: str) -> DataFrame:
    """Where page numbers stand (H07): center, constant, alternating (by parity), or mixed. Columns: key, idx, x (0 to 1)."""
    spot = F.when(F.col("x") < 0.33, "left").when(F.col("x") > 0.67, "right").otherwise("center")
    p = bands.withColumn("spot", spot).withColumn("odd", F.col("idx") % 2)
    kinds = lambda parity: F.countDistinct(F.when(F.col("odd") == parity, F.col("spot")))
    g = p.groupBy(key).agg(F.countDistinct("spot").alias("all"), kinds(0).alias("even"), kinds(1).alias("uneven"), F.min("spot").alias("one"))
    return g.select(key, F.when((F.col("all") == 1) & (F.col("one") == "center"), "center").when(F.col("all") == 1, "constant").when((F.col("all") == 2) & (F.col("even") == 1) & (F.col("uneven") == 1), "alternating").otherwise("mixed").alias("pattern"))
