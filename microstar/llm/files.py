"""Files that tasks write and read in shared storage."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared(uri: str):
    """File system and path of a URI (or plain path) in shared storage."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri(
        uri.replace("file:", "file://", 1) if uri.startswith("file:/") else f"file://{uri}")


def attempt_path(folder: str, suffix: str) -> tuple[int, str]:
    """This task's partition, and a file name that no other attempt uses.

    A task that is run again writes another file; only the paths that a
    finished attempt returned to Spark count.
    """
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    attempt = task.taskAttemptId() if task else 0
    stage = task.stageId() if task else 0
    return part, f"{folder}/part-{part:06d}-{stage}-{attempt}{suffix}"


def one_a_task(paths: DataFrame) -> DataFrame:
    """A list of files (a row each) dealt out so that each is read by a task of its own.

    The number is explicit: adaptive execution would merge partitions that
    look tiny, as they hold only names.
    """
    place = F.row_number().over(Window.orderBy(*paths.columns)) - 1  # one row a file
    return paths.withColumn("place", place).repartitionById(max(1, paths.count()), F.col("place")).drop("place")
