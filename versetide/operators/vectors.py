"""Sparse vectors as tables: places and values without a list of all columns."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from versetide.session import scratch_path, settle


def vector_table(df: DataFrame, places: str, values: str, size: int, output: str, name: str) -> DataFrame:
    """``df`` written with the sparse vector ``output`` of ``size`` places.

    ``places`` is a rising array of ints and ``values`` one of doubles. A vector is
    stored as its kind, size, places and values; written in that form and read as
    a vector, it needs no function per row. The table has a part for every core.
    """
    stored = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.col(places).cast("array<int>").alias("indices"), F.col(values).cast("array<double>").alias("values"),
    )
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    rest = df.drop(output)
    rest.withColumn(output, stored).write.parquet(path)
    table = spark.read.schema(StructType([*rest.schema.fields, StructField(output, VectorUDT())])).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else settle(table.repartition(cores), name)
