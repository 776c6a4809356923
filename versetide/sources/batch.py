"""Batch sources. Every connection option comes from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TEST_MARKER = "filed1"  # fixed value: first word of a test line (spelling included)


def jdbc_options(options: dict, partition: dict | None = None) -> dict:
    """Options of a JDBC read.

    ``partition`` has ``column``, ``lower``, ``upper`` and ``parts``; without it
    one task reads the table, so give it for anything large.
    """
    merged = dict(options)
    if partition:
        merged.update(
            partitionColumn=partition["column"], lowerBound=str(partition["lower"]),
            upperBound=str(partition["upper"]), numPartitions=str(partition["parts"]),
        )
    return merged


def read_jdbc(spark: SparkSession, options: dict, partition: dict | None = None) -> DataFrame:
    """Scan a database table in parallel ranges of its partition column."""
    return spark.read.format("jdbc").options(**jdbc_options(options, partition)).load()


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Scan a catalog table."""
    return spark.table(name)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Scan CSV with a header; all columns are text unless a schema is given."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.schema(schema).csv(path) if schema is not None else reader.csv(path)


def read_log_lines(
    spark: SparkSession, path: str, schema: StructType | str | None = None, marker: str = TEST_MARKER
) -> DataFrame:
    """Lines of every file in a log directory without the test lines.

    With a schema the lines are parsed as CSV rows, else given as ``value``.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith(marker))
    if schema is None:
        return lines
    ddl = schema if isinstance(schema, str) else schema.simpleString()[len("struct<"):-1].replace(":", " ")
    return lines.select(F.from_csv("value", ddl).alias("row")).select("row.*")
