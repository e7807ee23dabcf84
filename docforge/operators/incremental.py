"""Changes between snapshots, expiring caches and resumable batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(new: DataFrame, stored: DataFrame, key: str = "url", digest: str = "hash") -> DataFrame:
    """Each new row against the stored digest (Z01, J13): ingested, updated or unchanged."""
    old = stored.select(key, F.col(digest).alias("stored"))
    state = F.when(F.col("stored").isNull(), "ingested").when(F.col("stored") == F.col(digest), "unchanged").otherwise("updated")
    return new.select(key, digest).join(old, key, "left").select(key, digest, state.alias("state"))


def usable(cache: DataFrame, now: Column, positive: int = 7 * 86400, negative: int = 3600) -> DataFrame:
    """Cached responses that have not expired (Z02): a week for found, an hour for not found; errors are never stored.

    Columns: key, status, stored_at (seconds).
    """
    expires = F.col("stored_at") + F.when(F.col("status") == "ok", positive).otherwise(negative)
    return cache.where("status <> 'error'").withColumn("expires_at", expires.cast("long")).where(F.col("expires_at") > now)
