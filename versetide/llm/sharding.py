"""Sharding by a two-pass external shuffle.

Pass one scatters the rows into buckets by a seeded hash; the number of buckets
follows from the bytes, so that one fits in a task's memory. Pass two draws a
random permutation inside each bucket with Spark's ``shuffle`` of an array, which
is a Fisher-Yates shuffle, and the buckets are laid end to end. The shards are
equal cuts of that sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versetide.session import broadcast_if_small, scratch_path, settle

#: Bytes of text and number of rows that a bucket should hold.
BUCKET_BYTES = 16 << 20
BUCKET_ROWS = 100_000
#: Rows of one key that may share a bucket.
HOT_ROWS = 1000
ROW_BYTES = 8


def sizes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed part for the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def scattered(rows: DataFrame, key: str, buckets: int, seed: int) -> DataFrame:
    """``rows`` as structs with the bucket that the seeded hash of ``key`` gives.

    The rows of a key, or without one, that are more than ``HOT_ROWS`` are dealt by
    their content instead, and equal ones by a number. Which of them gets which
    number is open and makes no difference, so the same rows in any order and
    partitioning come to the same buckets.
    """
    named = rows.select(F.col(key).alias("_key"), F.struct("*").alias("row"))
    bucket = F.pmod("place", F.lit(buckets)).cast("int")
    hot = settle(named.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).select(F.col("_key").alias("_hot")), "hot-keys")
    by_key = F.xxhash64(F.lit(seed), F.col("_key").cast("string"))
    if not hot.take(1):
        return named.withColumn("place", by_key).withColumn("bucket", bucket)
    few, same = broadcast_if_small(hot, 64), F.col("_key").eqNullSafe(F.col("_hot"))
    plain = named.join(few, same, "left_anti").withColumn("place", by_key)
    many = settle(
        named.join(few, same, "left_semi").withColumns({"_content": F.xxhash64(F.lit(seed), "row"), "_part": F.spark_partition_id()}), "hot-rows"
    )
    group = ["_content", "_part"]
    before = Window.partitionBy("_content").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = many.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy(*group).orderBy(F.lit(0)))  # inside what one task has written
    dealt = many.withColumn("_number", number).join(starts, group).withColumn(
        "place", F.xxhash64(F.lit(seed), "_content", F.col("_start") + F.col("_number"))
    )
    return plain.unionByName(dealt.select("_key", "row", "place")).withColumn("bucket", bucket)


def write_shards(
    rows: DataFrame, path: str, shards: int, key: str, text: str = "text", seed: int = 0
) -> DataFrame:
    """Write ``rows`` below ``path`` as folders ``shard=N`` and return them as a table.

    Law ``rows``: the counts of any two shards differ by one at most. Columns
    ``shard`` and ``slot`` (gapless from 0, the order within the shard) are added
    and replace columns of these names. Null texts have no bytes, repeated rows
    are each dealt, a text longer than a bucket makes its bucket larger, and no
    rows give an empty table.

    The rows move once. Where a bucket begins in the sequence is known before,
    from a count of the keys alone: a table with one row for each bucket. A task
    draws for its buckets in order, and the array of a bucket is put in order before
    it is shuffled with the seed. So a task that runs again writes the same rows, and
    the same rows in any order and partitioning get the same shards and slots.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    size = rows.agg(F.sum(sizes(F.col(text))).alias("bytes"), F.count("*").alias("n")).first()
    total = size["n"]
    buckets = max(1, -(-(size["bytes"] or 0) // BUCKET_BYTES), -(-total // BUCKET_ROWS))
    dealt = scattered(rows, key, buckets, seed)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(
        dealt.groupBy("bucket").agg(F.count("*").alias("n"))
        .select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")),
        "starts",
    )
    drawn = (
        dealt.select("bucket", F.struct("_key", "row").alias("item")).repartition(buckets, "bucket")
        .groupBy("bucket").agg(F.collect_list("item").alias("items")).sortWithinPartitions("bucket")
        .select("bucket", F.shuffle(F.sort_array("items"), seed=seed).alias("items"))
        .join(broadcast_if_small(starts, 16), "bucket")
        .select("start", F.posexplode("items").alias("slot_in_bucket", "item"))
        .select("item.row.*", (F.col("start") + F.col("slot_in_bucket")).alias("_place"))
    )
    # shard s begins at the first place p with p * shards div total = s
    cut = drawn.withColumn("shard", F.expr(f"cast((_place * {shards}L) div {max(1, total)}L as int)")).withColumn(
        "slot", F.expr(f"_place - (shard * {total}L + {shards - 1}L) div {shards}L")
    ).drop("_place")
    cut.write.partitionBy("shard").parquet(path)
    return spark.read.schema(cut.schema).parquet(path) if total else spark.createDataFrame([], cut.schema)


def op2_shard(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards; reads the digest back from the shards' files."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    written = write_shards(documents, scratch_path(spark, "shards"), 24, "doc_id", seed=42)
    return written.select(
        "doc_id", sizes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
