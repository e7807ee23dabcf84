"""Readers and sinks on Spark's own formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docforge.functions.text import bound


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files, and each unreadable line under corrupt, which is null for the others (S15): a cut line never fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("r")).select("r.*")


def manifest(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """Rows with a whole digest, the first of each, with their place by digest (S18): digest, order, place."""
    first = rows.where(F.col(digest).rlike("^[0-9a-f]{64}$")).groupBy(digest).agg(F.min(order).alias(order))
    # places without one task for all rows: counted within leading bytes, after those of smaller ones
    byte = first.withColumn("__b", F.substring(digest, 1, 2))
    before = byte.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(digest)) + F.col("before")
    return byte.join(F.broadcast(before.select("__b", "before")), "__b").select(digest, order, place.cast("long").alias("place"))


def sources(spark: SparkSession, path: str) -> DataFrame:
    """Files as sources with their digest (S18): input_ref, bytes, sha256."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("input_ref"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tei_fields(text: Column) -> Column:
    """Title, author, publisher, date and identifier of a TEI document as a struct."""
    x = F.regexp_replace(text, r'\sxmlns(:\w+)?="[^"]*"', "")
    paths = {"title": "//titleStmt/title", "author": "//sourceDesc//author//surname", "publisher": "//publicationStmt/publisher", "issued": "//publicationStmt/date", "idno": "//idno"}
    # one evaluation, as each parses the document: between the values stands a sign that XML can't hold
    all_ = bound(F.xpath_string(x, F.lit("concat(" + ", '\x01', ".join(paths.values()) + ")")), lambda v: F.split(v, "\x01"))
    get = lambda v: bound(F.trim(v), lambda w: F.when(w != "", w))
    return bound(all_, lambda v: F.struct(*(get(F.get(v, F.lit(i))).alias(n) for i, n in enumerate(paths))))


def tei_headers(spark: SparkSession, path: str) -> DataFrame:
    """The fields of TEI files (S16): file, title, author, publisher, issued, idno."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), tei_fields(F.col("value")).alias("x")).select("file", "x.*")


def write_records(records: DataFrame, path: str, key: str) -> None:
    """Replace the artifacts of the records that are given and leave the others (K02): partitions by key, dynamically."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append-only log of JSON lines."""
    rows.write.mode("append").json(path)


def projected(artifacts: DataFrame, mode: str) -> DataFrame:
    """Artifact columns by output mode (K03): full, csl_evidence or csl_only."""
    drops = {"full": (), "csl_evidence": ("document", "merkle", "page_tree"), "csl_only": ("document", "merkle", "page_tree", "blocks", "layout")}
    return artifacts.drop(*drops[mode])
