"""Files that tasks write and read in the shared scratch folder, through Arrow's file systems.

A task writes under a name of its own (the partition and a random part), so that a task which runs twice, after an
executor is lost or by speculation, never touches the file of the other run. What a task returns names its file; only
files named by tasks that counted are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def make_folder(uri: str) -> None:
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)


def open_write(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path, compression=None)


def open_read(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def own_name(folder: str, kind: str) -> str:
    from pyspark import TaskContext

    at = TaskContext.get()
    return f"{folder}/{kind}-{at.partitionId() if at else 0:06d}-{uuid.uuid4().hex[:10]}"


def each_file(spark: SparkSession, listed: list[tuple], schema: str, read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """Run ``read`` over the rows of a list of files, one task for each file. The list has a row a file, not a row a record."""
    n = max(1, len(listed))
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(listed)], f"file_no int, {schema}")
    return rows.repartitionById(n, F.col("file_no")).drop("file_no").mapInArrow(read, out)
