"""Change detection over a stream of snapshots, with the last digest of each key as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docforge.plans.tables import new_path, ship_package

SCHEMA = "url string, version bigint, hash string, state string"


def _step(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["version", "hash"])  # hash: snapshots of one version come in any order
    out = []
    for version, digest in zip(rows["version"], rows["hash"], strict=True):
        out.append((key[0], version, digest, "ingested" if last is None else "unchanged" if last == digest else "updated"))
        last = digest
    state.update((last,))
    yield pd.DataFrame(out, columns=["url", "version", "hash", "state"])


def detect(snapshots: DataFrame) -> DataFrame:
    """A stream (url, version, hash) to (url, version, hash, state); the state store keeps each url's last hash."""
    ship_package(snapshots.sparkSession)
    return snapshots.groupBy("url").applyInPandasWithState(_step, SCHEMA, "hash string", "append", GroupStateTimeout.NoTimeout)


def detect_available(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Run detect() over all files that a folder holds now, and return what it wrote."""
    out, marks = new_path(spark, "changes"), new_path(spark, "stream-checkpoint")
    stream = spark.readStream.schema(schema).parquet(folder)
    detect(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SCHEMA).parquet(out)
