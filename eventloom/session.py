"""Sending the package to executors that don't have it."""

from __future__ import annotations

import functools
import shutil
import tempfile
import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written table up to which a join may send it everywhere.
FEW = 20_000

#: Rows that a task gets of a table dealt by its keys.
SHARE = 500_000

_SENT: set[str] = set()
_SENDING = threading.Lock()  # several queries may start at once


def ship(spark: SparkSession) -> None:
    """Sends this package once an application, as ``--py-files`` would."""
    context = spark.sparkContext
    with _SENDING:
        if context.applicationId not in _SENT:
            root = Path(__file__).resolve().parent
            archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{root.name}", "zip", root.parent, root.name)
            context.addPyFile(archive)
            _SENT.add(context.applicationId)


def shipped(query):
    """A query that sends the package first."""

    @functools.wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder; without one a temporary one, for local sessions alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df in the shared folder and reads it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sided(rows: DataFrame, n: int) -> DataFrame:
    """rows, n in number, for one side of a join: sent everywhere where they are few, else merged. The size of their files, by which Spark would judge, says too little."""
    return F.broadcast(rows) if n <= FEW else rows.hint("merge")


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows, about n in number, dealt to tasks by keys, so many that a task's share doesn't grow with the input."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // SHARE))
    return rows.repartition(tasks, *keys)
