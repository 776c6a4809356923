"""Exact duplicates by a stream with keyed state on disk.

The stream reads new files, names every text by the SHA-256 of its bytes with
A-Z lower-cased, and keeps one state row for each name, without expiry: how many
rows had it, the stable identifier (the largest id) and the content locator (file
and row) of the row that stays. Each task first adds up its own rows of a name,
so a text on a third of all rows is one row for each task. The state lies in
RocksDB stores with snapshots in ``store``; a stream that is started again, or a
task that is lost, goes on from there.

A name that was met before is a hit, and a digest proves nothing: ``resolve``
compares the full bytes of all hits. They are grouped by name and bytes, which
again starts inside each task, and the group that holds the located row is the
retained content. Other bytes below the same name are texts of their own, with
rows that stay of their own.

Null texts count as empty, and all empty texts are equal. A null id is smaller than
any other; of rows with the same id the last by file and row stays, so exactly
one row of each group is ``kept``. No rows give no rows. Columns other than id and
text are ignored, whatever they are called. Files must not change once read.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from versetide.llm import arrays as A
from versetide.session import broadcast_if_small, scratch_path, settle

#: Bytes of new files that one micro-batch takes on; one file is the least.
BATCH_BYTES = 64 << 30
#: Bytes of the digest that name a text in the state.
NAME_BYTES = 32
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a store may hold little: no megabytes of log are reserved for each
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Of a row of the state when it is sent to the tasks: name, count, id and the path of a file.
STATE_ROW = 256


def _namer(with_text: bool):
    """Adds ``_sha`` and, if wanted, the lower-cased text; every other column stays."""

    def name(batches):
        for batch in batches:
            for part in A.slices(batch, "_text"):
                texts = pc.ascii_lower(pc.fill_null(part.column("_text"), ""))
                data, bounds = A.raw(texts)
                view = memoryview(data)
                shas = [hashlib.sha256(view[bounds[i] : bounds[i + 1]]).digest() for i in range(len(texts))]
                kept = [part.column(c) for c in ("_id", "_file", "_row")]
                names = ["_id", "_file", "_row", "_sha"]
                if with_text:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(shas, pa.binary()), texts], [*names, "_text"])
                else:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(shas, pa.binary())], names)

    return name


def named(documents: DataFrame, key: str = "doc_id", text: str = "text", name_bytes: int = NAME_BYTES, with_text: bool = False) -> DataFrame:
    """``_id, _file, _row, _sha, _name`` of each row of a table or stream of files."""
    rows = documents.select(
        F.col(key).alias("_id"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"),
        F.col(text).alias("_text"),
    )
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _file string, _row bigint, _sha binary" + (", _text string" if with_text else "")
    return rows.mapInArrow(_namer(with_text), schema).withColumn("_name", F.substring("_sha", 1, name_bytes))


@contextmanager
def _state_on_disk(spark: SparkSession):
    """The settings hold for queries that start inside; each takes a copy of them."""
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def ingest(
    spark: SparkSession, path: str, store: str, key: str = "doc_id", text: str = "text",
    name_bytes: int = NAME_BYTES, batch_bytes: int = BATCH_BYTES,
) -> StreamingQuery:
    """Start the stream over the files of ``path`` that ``store`` has not met; it ends when they are read."""
    # a source of files takes a folder or a pattern; as a pattern, one file will do
    stream = (
        spark.readStream.schema(spark.read.parquet(path).schema)
        .option("maxBytesPerTrigger", str(batch_bytes)).parquet(f"{path[:-1]}[{path[-1]}]")
    )
    rows = named(stream, key, text, name_bytes)
    state = rows.groupBy("_name").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_id", "_file", "_row")).alias("keep"))
    with _state_on_disk(spark):
        return (
            state.writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", store).trigger(availableNow=True).start()
        )


def retained(spark: SparkSession, store: str) -> DataFrame:
    """``_name, n, keep`` of every name, as the state holds it: ``keep`` is (_id, _file, _row)."""
    state = spark.read.format("statestore").load(store)
    return state.select(F.col("key._name").alias("_name"), F.col("value.count").alias("n"), F.col("value.max").alias("keep"))


def resolve(documents: DataFrame, state: DataFrame, key: str = "doc_id", text: str = "text", name_bytes: int = NAME_BYTES) -> DataFrame:
    """One row for each row of ``documents``, which are the files that were ingested.

    ``key, keep_id, group_size, kept, text_sha256, file, row``: the id that stays,
    the rows with equal text, whether it is this row, the digest and the place of
    the content.
    """
    hits = settle(state.where("n > 1").select("_name", "n", "keep"), "hits")
    few = broadcast_if_small(hits, STATE_ROW)
    located = (F.col("_file") == F.col("keep._file")) & (F.col("_row") == F.col("keep._row"))
    contents = (
        named(documents, key, text, name_bytes, with_text=True).join(few, "_name")
        .groupBy("_name", "_text").agg(F.max(located).alias("_retained"))
    )
    # names below which there are bytes other than the retained ones
    mixed = settle(contents.where("NOT _retained").select("_name").distinct(), "mixed-names")
    plain, apart = named(documents, key, text, name_bytes), None
    if mixed.take(1):
        odd = broadcast_if_small(mixed, STATE_ROW)
        rows = settle(named(documents, key, text, name_bytes, with_text=True).join(odd, "_name", "left_semi"), "mixed-rows")
        group = rows.groupBy("_name", "_text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_id", "_file", "_row")).alias("keep"))
        apart = rows.join(settle(group, "mixed-groups"), ["_name", "_text"]).drop("_text")
        plain = plain.join(odd, "_name", "left_anti")
    out = plain.join(few, "_name", "left")
    if apart is not None:
        out = out.unionByName(apart)
    return out.select(
        F.col("_id").alias(key), F.when(F.col("n").isNull(), F.col("_id")).otherwise(F.col("keep._id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(located, F.lit(True)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"), F.col("_file").alias("file"), F.col("_row").alias("row"),
    )


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one that stays in its place."""
    path, store = f"{folder}/documents.parquet", scratch_path(spark, "dedup-state")
    ingest(spark, path, store).awaitTermination()
    found = resolve(spark.read.parquet(path), retained(spark, store))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH named AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC) = 1 AS kept, sha256(body) AS text_sha256
FROM named WINDOW same AS (PARTITION BY body)
"""
