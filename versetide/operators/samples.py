"""Label balance and negatives drawn from the shown lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versetide.operators.ranking import sample_rows

LIST_LENGTH = 10  # fixed value: items in one shown list


def label_balance(log: DataFrame) -> DataFrame:
    """Rows per label."""
    return log.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def negatives_from(impressions: DataFrame) -> DataFrame:
    """Shown lists as user-log rows of rating 0 and label 0."""
    return impressions.select(
        F.col("userId").cast("bigint").alias("userId"),
        F.explode(F.col("items").cast("array<int>")).alias("itemId"),
        F.lit(0).cast("bigint").alias("rating"),
        F.lit(0).alias("label"),
    )


def lists_wanted(log: DataFrame, pos_per_neg: int = 1, length: int = LIST_LENGTH) -> int:
    """How many shown lists bring the log to ``pos_per_neg`` positives per negative."""
    row = log.agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    ).first()
    return max(0, (row["pos"] // pos_per_neg - row["neg"]) // length)


def add_negatives(
    log: DataFrame, impressions: DataFrame, pos_per_neg: int = 1, length: int = LIST_LENGTH, seed=0
) -> DataFrame:
    """User log plus sampled shown items that the user did not act on.

    The log is read three times: pass a written table.
    """
    wanted = lists_wanted(log, pos_per_neg, length)
    shown = negatives_from(sample_rows(impressions, "impressionId", wanted, seed)).distinct()
    unseen = shown.join(log.select("userId", "itemId"), ["userId", "itemId"], "left_anti")
    return log.unionByName(unseen.select(*log.columns))
