"""Top-k, repeatable sampling and dense positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versetide.functions.parsing import digest

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
BUCKET_DIGITS = 3  # a hash order is cut into 16**3 buckets


def top_k(df: DataFrame, part: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each part.

    The ``rank <= k`` filter is pushed below the shuffle as a group limit, so a
    part of any size sends at most ``k`` rows per input partition; the session's
    threshold for that is raised to ``k`` where it is lower.
    """
    conf = df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT, "1000")) < k:
        conf.set(GROUP_LIMIT, k)
    window = W.partitionBy(*part).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def to_lists(ranked: DataFrame, key: str, value: str, rank: str = "rank", name: str = "items") -> DataFrame:
    """One row per key with its values in rank order; use after a ``top_k``."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(value))))
    return ranked.groupBy(key).agg(pairs.alias("_pairs")).select(
        key, F.col("_pairs").getField(value).alias(name)
    )


def sample_per_group(df: DataFrame, part: list[str], key: str, k: int, seed) -> DataFrame:
    """Up to ``k`` rows of each part, drawn without replacement by hash order."""
    drawn = df.withColumn("_digest", digest(seed, *part, key))
    return top_k(drawn, part, [F.col("_digest"), F.col(key)], k, "_draw").drop("_digest", "_draw")


def sample_rows(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    """The ``n`` rows that come first in hash order of a unique key.

    Counting rows per hash prefix finds the bucket in which the n-th row lies;
    one more prefix level is opened while that bucket is large. Only the counts
    of one level and the boundary row reach the driver, then one filter keeps
    the sample, so nothing is sorted globally.
    """
    if n <= 0:
        return df.limit(0)
    keyed = df.select(F.col(key).alias("_key"), digest(seed, key).alias("_digest"))
    prefix, wanted = "", n
    while True:
        width = len(prefix) + BUCKET_DIGITS
        counts = sorted(
            keyed.where(F.col("_digest").startswith(prefix))
            .groupBy(F.substring("_digest", 1, width).alias("p"))
            .count()
            .collect()
        )
        found = None
        for row in counts:
            if wanted <= row["count"]:
                found = row
                break
            wanted -= row["count"]
        if found is None:
            return df
        prefix = found["p"]
        if found["count"] <= 100_000 or len(prefix) >= 30:
            break
    nth = (
        keyed.where(F.col("_digest").startswith(prefix))
        .orderBy("_digest", "_key")
        .offset(wanted - 1)
        .first()
    )
    here = digest(seed, key)
    edge = F.lit(nth["_digest"])
    return df.where((here < edge) | ((here == edge) & (F.col(key) <= F.lit(nth["_key"]))))


def dense_positions(df: DataFrame, part: list[str], order: str, tie: str) -> DataFrame:
    """Add ``pos`` (from 0) and ``n`` (size) of each row in its part.

    ``order`` is a digest column. Rows are numbered inside (part, digest prefix)
    and shifted by the sizes of the earlier prefixes, so a part that holds most
    of the data is still spread over 16**3 groups.
    """
    keys = part + ["_bucket"]
    keyed = df.withColumn("_bucket", F.substring(order, 1, BUCKET_DIGITS))
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    whole = W.partitionBy(*part)
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        *keys,
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(whole).alias("n"),
    )
    local = F.row_number().over(W.partitionBy(*keys).orderBy(order, tie)) - 1
    return (
        keyed.withColumn("_local", local)
        .join(starts, keys)
        .withColumn("pos", F.col("_start") + F.col("_local"))
        .drop("_bucket", "_local", "_start")
    )
