"""Session helpers: the shared folder and tables written to cut a plan."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it then gets a
    temporary folder, made once per process.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="versetide-")
    return _local_folder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Functions that run inside tasks are pickled by module name, so a worker that
    was not started in this folder has to get the modules as a file.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="versetide-code-"), "versetide.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def use_checkpoints(spark: SparkSession) -> None:
    """Give iterative ML fits a reliable place to cut their lineage."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


BROADCAST_LIMIT = 256 << 20  # bytes
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Mark ``df`` for broadcast when its counted rows fit the limit.

    Beyond the limit it is returned as it is, for a shuffled join. Pass a
    written table: counting one reads the file footers only.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends here, so a lost executor costs a re-read and not a re-run,
    and the next plan sees true sizes when it picks join strategies. A join with
    a written table also shuffles it directly, which is what lets the adaptive
    planner split a hot key on the other side. What was shuffled for it is freed
    once it is written, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def emptied(table: DataFrame) -> None:
    """Free the disk of a settled table, or of a selection of it, that nothing reads any more: its folder is written anew, empty."""
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for folder in folders:
        table.sparkSession.range(0).write.mode("overwrite").parquet(folder)


def spread(df: DataFrame, name: str) -> DataFrame:
    """Settle rows that an iterative fit will read many times.

    A table too small to give every core a partition is written once more in
    as many parts as there are cores; a large one is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    table = settle(df, name)
    if table.rdd.getNumPartitions() >= cores:
        return table
    return settle(table.repartition(cores), name)
