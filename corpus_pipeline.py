"""A corpus pipeline: each stage is one corpus operator, and its decisions take effect.

Every stage reads the documents that its predecessor kept, as Parquet, and writes
its own. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.llm import bpe, decontaminate, jaccard_join, language, secrets
from versetide.session import broadcast_if_small, scratch_path, settle, ship


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; ``lang`` becomes the language that was found."""
    found = language.identify(docs, declared=F.col("lang"), host=F.col("source")).where("kept")
    return found.withColumn("lang", F.col("language")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Near copies share 80 hundredths of their runs of five words, directly or over others.
    Documents without shingles or without an id are in no group and stay. Rows
    that share an id stay or go together.
    """
    groups = settle(jaccard_join.jaccard_components(docs, least=80, width=5).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    gone = broadcast_if_small(groups.withColumnRenamed("doc_id", "_gone"), 16)
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.with_leaks(docs, benchmark).where(decontaminate.leaks_nothing()).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and ``n_chars`` counted anew."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document in the byte-level vocabulary."""
    encoded = bpe.encode(docs, bpe.vocabulary(), keep=("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", keep_known_language),
    ("near_copies", keep_one_of_each_group),
    ("decontamination", drop_test_items),
    ("secrets", redact_secrets),
    ("encoding", encode_texts),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
