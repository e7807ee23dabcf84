"""Extensions: table functions registered by name, with input checks (V01), and pluggable extractors."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TableFunction = Callable[[DataFrame], DataFrame]
_REGISTRY: dict[str, tuple[TableFunction, tuple[str, ...]]] = {}


class Extractor(Protocol):
    """Fields of a record from its blocks; the default finds nothing."""

    def extract(self, blocks: DataFrame) -> DataFrame: ...


class NoExtractor:
    def extract(self, blocks: DataFrame) -> DataFrame:
        return blocks.select(F.col("doc_id").alias("record_id"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")).where("false")


def register(name: str, function: TableFunction, output: tuple[str, ...]) -> None:
    """Make a table function available under a name; its result must have exactly these columns."""
    if name in _REGISTRY:
        raise ValueError(f"{name} is registered already")
    _REGISTRY[name] = (function, output)


def apply(name: str, table: DataFrame) -> DataFrame:
    """Run a registered function; a result with other columns is refused."""
    function, output = _REGISTRY[name]
    out = function(table)
    if tuple(out.columns) != output:
        raise ValueError(f"{name} returned {out.columns}, not {list(output)}")
    return out


def names() -> list[str]:
    return sorted(_REGISTRY)
