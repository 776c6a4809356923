"""The driver's tables in the roles of the poem site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = ("EraECONOMY", "small", "ring")  # stand-ins for the default tags


class Tables:
    """Roles over one directory of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def access_log(self) -> DataFrame:
        """``events`` as access log; values decide the odd rows."""
        e, value = F.col("event_type"), F.col("value")
        k = F.get_json_object("props", "$.k")
        name = (
            F.when(e == "view", "showPoetryDetails").when(e == "click", "toPoemDetails")
            .when(e == "purchase", "collectPoem").when(e == "error", "evaluatePoem")
            .otherwise("collectAuthor")
        )
        flag = F.when(value < 20, "0").when(value < 25, "00").otherwise("1")
        parameter = (
            F.when(value < 0.6, "bad")
            .when(e == "view", F.concat(F.lit("id="), k, F.lit("&from=list")))
            .when(e == "click", F.concat(F.lit("poemId="), k))
            .when(e == "purchase", F.concat(F.lit("poemId="), k, F.lit("&collection="), flag))
            .when(e == "error", F.concat(F.lit("like="), flag, F.lit("&poemId="), k))
        )
        return self.table("events").select(
            F.col("event_id").alias("logId"),
            F.col("user_id").cast("string").alias("userId"),
            F.col("ts").cast("timestamp").alias("visitTime"),
            F.when((e == "signup") & (value < 35), "search?kw=a").when(value < 250, "/poem").alias("url"),
            F.when((value >= 200) & (value < 205), F.lit("[log]login"))
            .otherwise(F.concat(F.lit("[log]svc[fn]"), name)).alias("method"),
            parameter.alias("parameter"),
        )

    def items(self) -> DataFrame:
        """``part`` as item attributes."""
        brand = F.split("p_brand", "#")[1].cast("int")
        return self.table("part").select(
            F.col("p_partkey").cast("int").alias("poemId"), (brand + 200000).alias("poemAuthorId"),
            F.col("p_size").cast("double").alias("poemStar"), F.concat(F.lit("Era"), F.col("p_type")).alias("poemDynasty"),
            F.replace("p_name", F.lit(" "), F.lit(",")).alias("poemTagNames"),
        )

    def users(self) -> DataFrame:
        """``customer`` as user info."""
        return self.table("customer").select(
            F.col("c_custkey").alias("userId"), F.col("c_mktsegment").alias("userSex")
        )

    def _lines(self) -> DataFrame:
        return self.table("orders").join(self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))

    def favourites(self) -> DataFrame:
        """Authors (brands) a user has bought in bulk."""
        bulk = self._lines().where("l_quantity >= 45").join(
            self.table("part"), F.col("l_partkey") == F.col("p_partkey")
        )
        return bulk.select(
            F.col("o_custkey").alias("userId"), F.split("p_brand", "#")[1].cast("bigint").alias("authorId")
        ).distinct()

    def impressions(self) -> DataFrame:
        """Each order as a list shown to its customer."""
        return self._lines().groupBy(F.col("o_orderkey").alias("impressionId"), F.col("o_custkey").alias("userId")).agg(
            F.sort_array(F.collect_set(F.col("l_partkey").cast("int"))).alias("items")
        )

    def purchases(self) -> DataFrame:
        """Bought quantities as ratings: (userId, itemId, rating)."""
        return self._lines().groupBy(F.col("o_custkey").alias("userId"), F.col("l_partkey").alias("itemId")).agg(
            (F.avg("l_quantity") / 10).alias("rating")
        )

    def actions(self) -> DataFrame:
        """``events`` as activity: (userId, eventId, ts, itemId); signups name no item."""
        return self.table("events").select(
            F.col("user_id").alias("userId"), F.col("event_id").alias("eventId"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.when(F.col("event_type") != "signup", F.get_json_object("props", "$.k").cast("int")).alias("itemId"),
        )

    def vectors(self) -> DataFrame:
        """``embeddings`` as item vectors."""
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))

    def documents(self) -> DataFrame:
        """``documents`` as poem texts."""
        return self.table("documents").select(F.col("doc_id").alias("docId"), "text")

    def header_texts(self) -> DataFrame:
        """``events`` as header texts, with absent fields and spaces."""
        return self.table("events").select(
            F.col("event_id").alias("eventId"),
            F.concat(
                F.lit("{userId="), F.col("user_id"),
                F.when(F.col("event_type") == "signup", F.lit("")).otherwise(
                    F.concat(F.lit(", itemId="), F.get_json_object("props", "$.k"))),
                F.when(F.col("event_type") == "view", F.lit(", name=a b ")).otherwise(F.lit("")),
                F.when(F.col("event_type") == "error", F.lit(", age=, click=0")).otherwise(F.lit("")),
                F.when(F.col("event_type") == "click", F.lit(", click=0, click=1")).otherwise(F.lit("")),
                F.lit("}"),
            ).alias("headers"),
        )

    def envelopes(self) -> DataFrame:
        """``events`` as JSON arrays of two events; the second names no user."""
        first = F.struct(
            F.create_map(
                F.lit("userId"), F.col("user_id").cast("string"), F.lit("click"), F.col("event_type")
            ).alias("headers"),
            F.lit("filed1, filed2, filed3").alias("body"),
        )
        second = F.struct(
            F.create_map(
                F.lit("itemId"), F.get_json_object("props", "$.k"), F.lit("age"), F.lit("3")
            ).alias("headers"),
            F.col("props").alias("body"),
        )
        return self.table("events").select(
            F.col("event_id").alias("eventId"), F.to_json(F.array(first, second)).alias("value")
        )

    def log_lines(self) -> DataFrame:
        """``events`` as log lines: signups give test lines, views name the marker inside."""
        head = F.when(F.col("event_type") == "signup", "filed1, ").otherwise("")
        inside = F.when(F.col("event_type") == "view", "filed1").otherwise(F.col("event_type"))
        return self.table("events").select(
            F.concat(head, F.col("event_id"), F.lit(","), F.col("user_id"), F.lit(","), inside).alias("value")
        )
