"""Access log to scored user-item events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versetide.functions.parsing import (
    ITEM_METHODS,
    SEARCH_PREFIX,
    item_of,
    label_of,
    method_name,
    rating_of,
)


def drop_search(log: DataFrame) -> DataFrame:
    """Remove rows whose url begins with the search prefix (and null urls)."""
    return log.where(~F.col("url").startswith(SEARCH_PREFIX))


def keep_item_events(log: DataFrame, methods=ITEM_METHODS) -> DataFrame:
    """Keep rows of the named methods; unnamed ones go with the others."""
    return log.where(F.col("method").isin(*methods))


def clean_log(log: DataFrame, methods=ITEM_METHODS) -> DataFrame:
    """(userId, method, parameter) of the events on items."""
    named = drop_search(log).select("userId", "parameter", method_name(F.col("method")).alias("method"))
    return keep_item_events(named, methods)


def _with_item(cleaned: DataFrame) -> DataFrame:
    return cleaned.withColumn("itemId", item_of(F.col("method"), F.col("parameter")))


def score_events(cleaned: DataFrame) -> DataFrame:
    """(userId, itemId, rating) of each event, all methods in one pass."""
    return _with_item(cleaned).select(
        F.col("userId").try_cast("bigint").alias("userId"),
        "itemId",
        rating_of(F.col("method"), F.col("parameter"), F.col("itemId")).alias("rating"),
    )


def engagement_ratings(scored: DataFrame) -> DataFrame:
    """(userId, itemId, rating, label): ratings summed per user and item."""
    return (
        scored.groupBy("userId", "itemId")
        .agg(F.sum("rating").alias("rating"))
        .withColumn("label", label_of(F.col("rating")))
    )


def parse_report(cleaned: DataFrame) -> DataFrame:
    """Per method: events, and how many gave no item or no rating."""
    rating = rating_of(F.col("method"), F.col("parameter"), F.col("itemId"))
    return _with_item(cleaned).groupBy("method").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("itemId").isNull()).alias("no_item"),
        F.count_if(rating.isNull()).alias("no_rating"),
    )
