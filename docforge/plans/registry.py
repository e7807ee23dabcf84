"""Registered queries: a callable over (spark, sf_dir), the operators that it shows, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    operators: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}
#: Abbreviations of the SQL texts.
SHORT = {
    "$LINES": "lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(operators: str, sql: str | None = None) -> Callable[[Callable[[Callable[[str], DataFrame]], DataFrame]], Run]:
    """Register a function of a table reader under its own name."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Run:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: table(spark, sf_dir, name))

        text = sql
        for k, v in SHORT.items():
            text = text.replace(k, v) if text else None
        QUERIES[f.__name__] = Query(run, tuple(operators.split()), text)
        return run

    return register
