"""Page furniture: repeated lines, margins, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T


def repeated_lines(lines: DataFrame, least: int = 3) -> DataFrame:
    """Keys of short lines on ``least`` documents at least (A01): key, n_docs, n_lines, first_doc."""
    keyed = lines.select("doc_id", T.repeat_key(F.col("line")).alias("key")).where("key <> ''")
    per_doc = keyed.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n"))  # combined before the keys meet
    return per_doc.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_lines"), F.min("doc_id").alias("first_doc")).where(F.col("n_docs") >= least)


def margin_lines(lines: DataFrame, window: int = 4) -> DataFrame:
    """Keys that repeat among the first and last lines of a collection's documents (A02): source, key, n_pages, first_page."""
    some = lines.where(T.stripped(F.col("line")) != "")
    up, down = Window.partitionBy("doc_id").orderBy("line_no"), Window.partitionBy("doc_id").orderBy(F.desc("line_no"))
    edge = some.withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down)).where(f"a <= {window} or b <= {window}")
    keyed = edge.select("source", "doc_id", "line", T.margin_key(F.col("line")).alias("key"))
    fits = (F.col("key") != "") & ~T.is_page_number(F.col("line")) & (F.length(T.stripped(F.col("line"))) <= 80) & (F.length("key") <= 60) & (T.word_count(F.col("key")) <= 8)
    seen = keyed.where(fits).select("source", "key", "doc_id").distinct()
    pages = lines.select("source", "doc_id").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    counted = seen.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n_pages"), F.min("doc_id").alias("first_page"))
    least = F.least(F.lit(5), F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.15)))
    return counted.join(pages, "source").where(F.col("n_pages") >= least).select("source", "key", "n_pages", "first_page")


def strip_margins(lines: DataFrame, margins: DataFrame) -> DataFrame:
    """Lines between the first and the last one that is no margin (W01): doc_id, n_kept, text.

    Blank lines, page numbers and repeated keys go from both edges, a key not on its first page; where
    nothing would be left, all stays.
    """
    keyed = lines.withColumn("key", T.margin_key(F.col("line"))).join(margins.select("source", "key", "first_page"), ["source", "key"], "left")
    strip = (T.stripped(F.col("line")) == "") | T.is_page_number(F.col("line")) | F.coalesce(F.col("doc_id") > F.col("first_page"), F.lit(False))
    own = Window.partitionBy("doc_id")
    kept = F.when(~strip, F.col("line_no"))
    marked = keyed.withColumn("lo", F.min(kept).over(own)).withColumn("hi", F.max(kept).over(own)).where("lo is null or line_no between lo and hi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s.line), "\n")
    return marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"), T.stripped(text).alias("text"))


def without_signatures(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Lines whose first 200 characters, squeezed, are not in ``known``."""
    signature = lambda df: df.withColumn("signature", F.substring(T.squeezed(F.col("line")), 1, 200))
    return signature(lines).join(signature(known).select("signature").distinct(), "signature", "left_anti")
