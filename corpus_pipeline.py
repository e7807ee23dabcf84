"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

In every stage a null text counts as an empty one, rows that repeat each other are judged alike, an empty table
stays empty, and all columns of documents are kept (but for the last stage's result); a row without a doc_id stays unless its text is toxic or contains a
benchmark item. What else a stage does with such rows is stated there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docforge.llm import bpe, decontaminate, near_dup, substring_dedup, toxicity
from docforge.plans.tables import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; empty ones are judged as any other. Without labels of both classes none or all go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (shingles of five words, similarity of 0.8 or more): the smallest doc_id, once. Texts without words are in no group."""
    return near_dup.deduplicated(docs, shingle=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that also start in a document of smaller doc_id are cut out; no character is split, and null texts become empty."""
    return substring_dedup.without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go: at least 80 % of its five-word shingles. Empty items are contained in nothing."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and its decoded bytes' digest; an empty text has no tokens."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxic), ("near_dup", near), ("substring_dedup", substrings), ("decontaminate", benchmark), ("bpe", tokens)]

#: The stages are a trained classifier, iterations and a tokenizer: SQL can't express them (tests: brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: one row per document that is left, as bpe.encode() gives it with its ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
