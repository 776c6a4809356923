"""Streaming sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from versetide.operators.ranking import to_lists
from versetide.operators.recall import RECENT_ENTRIES, activity_entries, last_actions

BATCH = "1 second"  # fixed value: length of a micro-batch
FILES_PER_BATCH = 5  # fixed value: how many click files are taken together
PRINTED = 10


def read_event_stream(
    spark: SparkSession, path: str, schema, format: str = "json", files_per_batch: int | None = FILES_PER_BATCH
) -> DataFrame:
    """Stream of the files that arrive in ``path``."""
    reader = spark.readStream.format(format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _trigger(writer, once: bool):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=BATCH)


def print_stream(stream: DataFrame, rows: int = PRINTED, once: bool = False) -> StreamingQuery:
    """Print the first rows of each micro-batch."""
    return _trigger(stream.writeStream.format("console").option("numRows", rows), once).start()


def append_events(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the stream to a log table of parquet files."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return _trigger(writer, once).start()


def roll_files(spark: SparkSession, path: str, out: str, rows_per_file: int) -> None:
    """Rewrite a log table of many small files into larger ones."""
    spark.read.parquet(path).write.option("maxRecordsPerFile", rows_per_file).parquet(out)


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint, over all its restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()["value"])["id"]


def recent_activity_stream(
    events: DataFrame, path: str, checkpoint: str, n: int = RECENT_ENTRIES, once: bool = False
) -> StreamingQuery:
    """Keep each user's last ``n`` actions of (userId, eventId, ts, ...).

    Every micro-batch writes its own top ``n`` per user to the folder of its run
    and number; a batch that is run again overwrites its folder, and a stream
    with a new checkpoint is a run of its own. A user with most of the traffic
    sends at most ``n`` rows per input partition through the shuffle, and no
    state is held per key between batches.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if "run" not in known:
            known["run"] = _run_of(spark, checkpoint)
        last_actions(batch, n).drop("rank").write.mode("overwrite").parquet(f"{path}/run={known['run']}/batch={number}")

    known: dict[str, str] = {}
    writer = events.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, once).start()


def stored_actions(spark: SparkSession, *paths: str, n: int = RECENT_ENTRIES) -> DataFrame:
    """The last ``n`` actions of each user in all batches below ``paths``, with ``rank``.

    An event that several runs have read counts once.
    """
    found = None
    for path in paths:
        rows = spark.read.parquet(path).drop("run", "batch")
        found = rows if found is None else found.unionByName(rows)
    return last_actions(found.dropDuplicates(["userId", "eventId"]), n)


def read_recent(spark: SparkSession, *paths: str, items: DataFrame | None = None, n: int = RECENT_ENTRIES) -> DataFrame:
    """(userId, recent): newest first, from the batches and compacted folders.

    Entries come with the events, or else from the item attributes.
    """
    actions = stored_actions(spark, *paths, n=n)
    if items is not None:
        actions = activity_entries(actions, items)
    return to_lists(actions, "userId", "entry", name="recent")


def compact_recent(spark: SparkSession, *paths: str, out: str, n: int = RECENT_ENTRIES) -> None:
    """Write the last ``n`` actions of each user below ``paths`` to one folder.

    Batches that were there when it began are then no longer needed beside ``out``.
    """
    stored_actions(spark, *paths, n=n).drop("rank").write.parquet(out)
