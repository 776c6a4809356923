"""Batch sinks and the JSON answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_impressions(lists: DataFrame, path: str, shown_at: str, run: str = "0") -> None:
    """Add (userId, items) lists shown at ``shown_at`` by ``run`` to the impression store.

    The key names time, run and user, so a user may get several lists a day.
    A run that is repeated replaces its own part and adds nothing twice.
    """
    lists.select(
        F.concat_ws(":", F.lit(shown_at), F.lit(run), F.col("userId").cast("string")).alias("impressionId"),
        F.col("userId").cast("bigint").alias("userId"),
        F.col("items").cast("array<int>").alias("items"),
    ).write.mode("overwrite").parquet(f"{path}/shown={shown_at}/run={run}")


def read_impressions(spark: SparkSession, path: str) -> DataFrame:
    """(impressionId, userId, items) of all runs in the store."""
    return spark.read.parquet(path).select("impressionId", "userId", "items")


def to_payload(lists: DataFrame, field: str | None = None, items: str = "items") -> DataFrame:
    """Add ``payload``: ``{"<field>":[...]}``, or the bare array without a field.

    A null list stays visible as ``null``.
    """
    if field is None:
        return lists.withColumn("payload", F.coalesce(F.to_json(items), F.lit("null")))
    body = F.coalesce(F.to_json(items), F.lit("null"))
    return lists.withColumn("payload", F.concat(F.lit(f'{{"{field}":'), body, F.lit("}")))
