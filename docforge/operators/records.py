"""Legality, profiles and states of bibliographic records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fields that each kind of record is evaluated on, besides type, title, author and issued.
PROFILE = {
    "article-journal": ("container-title", "volume", "issue", "page", "DOI"),
    "webpage": ("container-title", "publisher", "URL", "accessed"),
    "book": ("editor", "translator", "edition", "publisher", "ISBN"),
    "chapter": ("editor", "translator", "edition", "publisher", "ISBN", "container-title", "page"),
    "interview": ("medium", "dimensions", "publisher", "container-title", "URL", "interviewer", "host"),
}
COMMON = ("type", "title", "author", "issued")
PAGE_SPEC = r"^\s*(?:\d+(?:\s*-\s*\d+)?|-\d+)(?:\s*,\s*(?:\d+(?:\s*-\s*\d+)?|-\d+))*\s*$"
# Languages and the codes of a text recogniser.
OCR_CODES = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa", "zh": "chi_sim", "ja": "jpn"}


def is_date(y: Column, m: Column, d: Column) -> Column:
    """Whether year, month and day (the last two may be null) are a real date."""
    days = F.day(F.last_day(F.make_date(y, F.greatest(F.lit(1), F.least(F.coalesce(m, F.lit(1)), F.lit(12))), F.lit(1))))
    return y.between(1, 9999) & F.coalesce(m, F.lit(1)).between(1, 12) & F.coalesce(d, F.lit(1)).between(1, days)


def is_locator(kind: Column, start: Column, end: Column, page: Column, section: Column) -> Column:
    """Whether a locator of a family is legal."""
    return F.when(kind == "media", (start >= 0) & (start < end)).when(kind == "page", page >= 0).when(kind == "section", section >= 1).otherwise(F.lit(False))


def profile(spark: SparkSession) -> DataFrame:
    """The dimension (type, field)."""
    return spark.createDataFrame([(t, f) for t, fields in PROFILE.items() for f in (*COMMON, *fields)], "type string, field string")


def evaluated_fields(records: DataFrame) -> DataFrame:
    """Records (record_id, type) with the fields of their kind (F10, U01); the dimension has a few dozen rows."""
    return records.join(F.broadcast(profile(records.sparkSession)), "type")


def looks_like_filename(title: Column, path: Column) -> Column:
    """Title equals the file's name or stem, or is a hexadecimal name."""
    base = F.lower(F.regexp_extract(path, r"([^/?#]+)/?(?:[?#].*)?$", 1))
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    t = F.lower(F.trim(title))
    return (t == base) | (t == stem) | t.rlike(r"^[0-9a-f]{32,64}\.pdf$")


# Words that begin a fragment of a sentence.
FRAGMENT = r"^(?:the|and|with|for|of|in|on|der|die|das|le|la|les|el|los) "


def kept_authors(names: Column) -> Column:
    """Names without over-long ones and sentence fragments."""
    return F.filter(names, lambda n: (F.length(n) <= 80) & (F.trim(n) != "") & ~F.lower(n).rlike(FRAGMENT))


def western_name(c: Column) -> tuple[Column, Column]:
    """Family and given name: ``family, given``, or the last token is the family."""
    comma = c.rlike(r"^[^\s,]+\s*,\s*[^\s,]+$")
    family = F.when(comma, F.trim(F.split(c, ",")[0])).otherwise(F.regexp_extract(F.trim(c), r"(\S+)$", 1))
    given = F.when(comma, F.trim(F.split(c, ",")[1])).otherwise(F.trim(F.regexp_replace(F.trim(c), r"\s*\S+$", "")))
    return family, given


def completeness(states: DataFrame) -> DataFrame:
    """Complete where title, author and issued are supported (E07): record_id, n_supported, complete."""
    has = lambda f: F.max(F.when((F.col("field") == f) & (F.col("state") == "source-supported"), 1).otherwise(0)) == 1
    return states.groupBy("record_id").agg(F.count_if(F.col("state") == "source-supported").alias("n_supported"), (has("title") & has("author") & has("issued")).alias("complete"))


def best_overlap(items: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """The image that covers over half of an item on its page, most first; else the page's first image.

    items: keys, item_id, x0, x1. images: keys, image_id, i0, i1. The join is by page.
    """
    share = F.greatest(F.lit(0.0), F.least("x1", "i1") - F.greatest("x0", "i0")) / (F.col("x1") - F.col("x0"))
    j = items.join(images, keys).withColumn("share", share)
    best = j.groupBy(*keys, "item_id").agg(F.max(F.struct("share", -F.col("image_id"))).alias("m"), F.min("image_id").alias("first"))
    return best.select(*keys, "item_id", F.when(F.col("m.share") > 0.5, -F.col("m.col2")).otherwise(F.col("first")).alias("image_id"))


def chunk_size(pages: Column) -> Column:
    """Pages of a recognition chunk by document length; 0 is no chunking."""
    return F.when(pages <= 100, 0).when(pages <= 250, 50).when(pages <= 500, 40).when(pages <= 1000, 25).otherwise(20)


def chunks(docs: DataFrame) -> DataFrame:
    """Start and end of each chunk (S04): doc_id, start_page, end_page (from 0). Columns doc_id, n_pages."""
    step = F.when(chunk_size(F.col("n_pages")) == 0, F.greatest(F.col("n_pages"), F.lit(1))).otherwise(chunk_size(F.col("n_pages")))
    return docs.select("doc_id", "n_pages", step.alias("step")).select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_pages") - 1, F.lit(0)), F.col("step"))).alias("start_page"), "n_pages", "step").select("doc_id", F.col("start_page").cast("long").alias("start_page"), (F.least(F.col("start_page") + F.col("step"), "n_pages") - 1).cast("long").alias("end_page"))


def carried_sections(items: DataFrame, key: str, order: str, heading: Column) -> DataFrame:
    """Each item with the last heading at or before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("section", F.last(heading, True).over(w))


def preorder(headings: DataFrame) -> DataFrame:
    """Four-digit numbers in document order, and whether a heading is a leaf (G06). Columns doc_id, line_no, parent."""
    inner = headings.where("parent is not null").select("doc_id", F.col("parent").alias("line_no"), F.lit(True).alias("inner")).distinct()
    number = F.lpad((F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).cast("string"), 4, "0")
    return headings.withColumn("number", number).join(inner, ["doc_id", "line_no"], "left").select("doc_id", "line_no", "number", F.coalesce(~F.col("inner"), F.lit(True)).alias("leaf"))
