"""A key that a third of all rows hold is split by the adaptive planner."""

import pytest
from pyspark.sql import functions as F

from versetide.operators.features import flag_favourite_author
from versetide.operators.recall import draw_tag_items
from versetide.session import settle

SETTINGS = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def split(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)

    def final_plan(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    yield final_plan
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_user_with_a_third_of_the_log(spark, split):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("userId"),
        F.when(F.col("id") % 3 == 0, 200001).otherwise(F.col("id") % 50 + 200001).alias("poemAuthorId"), "id",
    )
    favourites = spark.range(3000).select(F.col("id").alias("userId"), F.lit(1).cast("long").alias("authorId"))
    got = flag_favourite_author(settle(rows, "skewed"), favourites)
    assert "skew=true" in split(got)
    assert got.count() == 60_000 and got.where("userId = 7 AND collectAuthor = 1").count() == 20_000


def test_a_tag_that_everybody_asks_for(spark, split):
    tags = spark.range(30_000).select(F.col("id").alias("userId"), F.lit("common").alias("tag"))
    index = spark.range(5).select(
        F.lit("common").alias("tag"), F.col("id").alias("pos"), F.col("id").alias("itemId"), F.lit(5).cast("long").alias("n")
    )
    other = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("tag"), F.lit(0).cast("long").alias("pos"), "id", F.lit(1).cast("long").alias("n"))
    index = settle(index.unionByName(other.withColumnRenamed("id", "itemId")), "index")
    got = draw_tag_items(settle(tags, "tags"), index, 5, 1)
    assert "skew=true" in split(got)
    assert got.count() == 150_000
