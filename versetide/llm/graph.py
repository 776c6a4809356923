"""Connected components of a table of links, without a collect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versetide.session import settle




def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every node of ``links``; ``root`` is the smallest node reachable.

    Alternates large and small stars: a node's larger neighbours, then its
    smaller ones, are tied to the least of them all, until nothing changes. A
    round keeps at most one row for each edge. A node with many links is split
    by the join, as its minimum is made beforehand.
    """
    edges = settle(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(),
        "links",
    )
    nodes = edges
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        changed = after.exceptAll(edges).take(1) or edges.exceptAll(after).take(1)
        edges = after
        if not changed:
            break
    roots = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return roots.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
