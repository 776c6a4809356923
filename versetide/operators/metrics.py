"""Measures of scored rows, exact and without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versetide.session import settle

LEAST = 1e-15  # fixed value: probabilities are kept this far from 0 and 1


def log_loss(score: Column, label: Column) -> Column:
    """The loss of one row."""
    safe = F.greatest(F.lit(LEAST), F.least(F.lit(1 - LEAST), score))
    return -F.when(label > 0, F.log(safe)).otherwise(F.log(1 - safe))


def ranker_metrics(scored: DataFrame, *by: str) -> DataFrame:
    """(by..., n, positives, auc, logloss) of (by..., label, score) rows.

    Rows with equal scores are counted first, inside the tasks. The counts are
    dealt to ranges of scores; a score's rank is the count of the ranges below it,
    a short table, and of the lower scores of its own range. Ties count half. The area
    is null where all rows have one label. Rows without score or label are left out.
    """
    rows = scored.where("score IS NOT NULL AND label IS NOT NULL")
    positive = (F.col("label") > 0).cast("bigint")
    counts = rows.groupBy(*by, "score").agg(
        F.sum(positive).alias("p"), F.sum(1 - positive).alias("q"),
        F.sum(log_loss(F.col("score"), F.col("label"))).alias("loss"),
    )
    ranged = settle(counts.repartitionByRange(*by, "score").withColumn("part", F.spark_partition_id()), "score-ranges")
    parts = ranged.groupBy(*by, "part").agg(F.sum("q").alias("q"))  # a row for each range
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, "part", F.coalesce(F.sum("q").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy(*by, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("lower", F.coalesce(F.sum("q").over(inside), F.lit(0))).join(F.broadcast(offsets), [*by, "part"])
    wins = F.col("p") * (2 * (F.col("below") + F.col("lower")) + F.col("q"))  # halves
    sums = placed.groupBy(*by).agg(
        F.sum(F.col("p") + F.col("q")).alias("n"), F.sum("p").alias("positives"), F.sum("q").alias("_q"),
        F.sum(wins).alias("_wins"), F.sum("loss").alias("_loss"),
    )
    pairs = 2.0 * F.col("positives") * F.col("_q")
    area = F.when(pairs > 0, F.col("_wins") / F.when(pairs > 0, pairs))
    return sums.where("n > 0").select(*by, "n", "positives", area.alias("auc"), (F.col("_loss") / F.col("n")).alias("logloss"))
