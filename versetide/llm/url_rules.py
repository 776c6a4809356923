"""URL rules: a range join of reversed-host keys against nested rule intervals.

A rule is a host and a path prefix. Written with its labels reversed and a dot
after each, a host is a prefix of all its subdomains, so it covers one interval
of the sorted keys; a path prefix covers one interval of the paths below its
host. Such intervals nest or are disjoint. A sorted sweep over interval ends and
points therefore keeps a stack, and the stack at a point is all that covers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versetide.session import settle

#: Rows of a sweep for each of its partitions.
SWEEP_ROWS = 100_000
OPEN, POINT, CLOSE = 1, 0, -1


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(
        F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``a.b.c`` as the bytes of ``c.b.a.``, so that a domain precedes its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary")


def sweep(points: DataFrame, intervals: DataFrame, partitions: int | None = None) -> DataFrame:
    """All intervals around each point, with their depth in the stack.

    ``points`` has distinct binary keys ``key``, ``intervals`` distinct ``key``
    (a prefix, covering every key that begins with it) and ``node``. Returns
    ``key, depth, node``, one row for each interval around a point; points
    outside all intervals have none.

    Ends and points are dealt by key range, so neither a common host nor a broad
    rule meets in one task. Within a partition the running sum of openings and
    closings is the stack's height, and the last opening at height d is slot d.
    What a partition starts with comes from two small tables, one row for each
    partition and one for each partition and height.
    """
    ends = intervals.select(
        F.explode(F.array(
            F.struct(F.col("key").alias("key"), F.lit(OPEN).alias("kind"), F.col("node").alias("node")),
            F.struct(F.concat("key", F.lit(bytearray(b"\xff"))).alias("key"), F.lit(CLOSE).alias("kind"),
                     F.lit(None).cast(intervals.schema["node"].dataType).alias("node")),
        )).alias("end")
    ).select("end.*")
    rows = ends.unionByName(points.select("key", F.lit(POINT).alias("kind")), allowMissingColumns=True)
    # an interval opens before a point of the same key; kinds sort 1, 0, -1
    rows = rows.withColumn("turn", -F.col("kind"))
    count = partitions or max(1, -(-rows.count() // SWEEP_ROWS))
    dealt = settle(
        rows.repartitionByRange(count, "key", "turn").withColumn("part", F.spark_partition_id()), "sweep"
    )
    here = Window.partitionBy("part").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heights = dealt.groupBy("part").agg(F.sum("kind").alias("change")).select(
        "part", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("base")
    )
    stacked = dealt.join(F.broadcast(heights), "part").withColumn(  # a row for each partition
        "height", F.col("base") + F.sum("kind").over(here)
    )
    # the opening that fills a slot, by partition and slot, carried to later partitions
    last = stacked.where(F.col("kind") == OPEN).groupBy("part", "height").agg(
        F.max(F.struct("key", "node")).alias("top")
    )
    deepest = last.agg(F.max("height")).first()[0] or 1
    slots = heights.select("part", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(deepest).cast("long"))).alias("height"))
    carried = slots.join(last, ["part", "height"], "left").select(
        "part", "height",
        F.last("top", ignorenulls=True).over(
            Window.partitionBy("height").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ).alias("carried"),
    )
    marks = stacked.select(
        "part", "key", "kind", "turn", "node",
        F.explode(
            F.when(F.col("kind") == OPEN, F.array("height"))
            .when((F.col("kind") == POINT) & (F.col("height") > 0), F.sequence(F.lit(1).cast("long"), "height"))
        ).alias("depth"),
    )
    slot = Window.partitionBy("part", "depth").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    opened = marks.withColumn(
        "own", F.last(F.when(F.col("kind") == OPEN, F.struct("key", "node")), ignorenulls=True).over(slot)
    ).where(F.col("kind") == POINT)
    return opened.join(
        F.broadcast(carried.withColumnRenamed("height", "depth")), ["part", "depth"], "left"
    ).select("key", "depth", F.coalesce("own", "carried")["node"].alias("node"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each row.

    ``rules`` has ``verdict, host, path``. A rule fits its host and all
    subdomains when the path of the URL starts with its own; the longest one
    (host, then path) decides. Of two rules with equal host and path the one
    that allows wins, a null path is empty, a rule without host fits nothing.
    Null URLs and URLs without ``://`` have empty host and path, no rule and the
    default verdict. Columns of ``pages`` named host, path, rule or verdict are
    replaced. Every row of ``pages`` comes back, repeated ones as often.

    Two sweeps: over the distinct hosts, for the hosts with rules that enclose
    each, then over the distinct paths below each of these, for the longest
    path. Both sides of the last join are dealt by URL key, the repeated side
    being the one that Spark can split.
    """
    host, path = split_url(F.col(url))
    parted = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    kept = settle(
        rules.where(F.coalesce("host", F.lit("")) != "")
        .groupBy(F.lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
        .agg(F.min("verdict").alias("verdict")),
        "url-rules",
    )
    places = settle(parted.select("host", "path").where(F.col("host") != "").distinct(), "url-places")

    hosts = places.select(host_key(F.col("host")).alias("key"), "host").distinct()
    nodes = kept.select(host_key(F.col("rule_host")).alias("key"), F.col("rule_host").alias("node")).distinct()
    around = sweep(hosts, nodes).join(hosts, "key").select("host", "depth", F.col("node").alias("rule_host"))

    def below(node: str, rest: str) -> Column:
        return F.concat(F.col(node).cast("binary"), F.lit(bytearray(b"\x00")), F.col(rest).cast("binary"))

    sites = settle(places.join(around, "host").withColumn("key", below("rule_host", "path")), "url-sites")
    paths = kept.select(below("rule_host", "rule_path").alias("key"), F.struct("rule_path", "verdict").alias("node"))
    inner = sweep(sites.select("key").distinct(), paths).groupBy("key").agg(
        F.max_by("node", "depth").alias("fit")
    )
    judged = sites.join(inner, "key").groupBy("host", "path").agg(
        F.max_by(F.struct("rule_host", "fit"), "depth").alias("best")
    ).select(
        "host", "path", F.concat("best.rule_host", F.when(F.col("best.fit.rule_path") == "", "/")
                                 .otherwise(F.col("best.fit.rule_path"))).alias("rule"),
        F.col("best.fit.verdict").alias("verdict"),
    )
    return parted.join(judged, ["host", "path"], "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit(default))
    )


#: The rules of the query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table; a literal, so that no Python runs to read it."""
    row = [F.struct(*(F.lit(v).alias(n) for n, v in zip(("verdict", "host", "path"), r, strict=True))) for r in rules]
    return spark.range(1).select(F.explode(F.array(*row)).alias("r")).select("r.*")


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), places AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host) DESC, length(r.rule_path) DESC) AS n
  FROM places p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""
