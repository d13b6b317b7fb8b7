"""Sums of numpy blocks over all rows of a frame, and rows settled on the shared folder for passes that come again."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in spark.checkpoint.dir, which all executors reach. Only a local session without that setting has a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str = "rows") -> DataFrame:
    """df written to the shared folder and read back, so that passes read it and an executor's loss costs a read."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column of equal lengths, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def tree_sum(df: DataFrame, block: Callable[[pa.RecordBatch], np.ndarray], parts: int) -> np.ndarray:
    """The sum over all Arrow batches of ``block``, arrays of one shape that does not grow with the rows.

    A partition adds up its own; the square root of ``parts`` tasks add up those of as many partitions each; the driver adds
    the rest, in order. ``parts`` is about the number of partitions of df. None of an empty frame.
    """
    root = max(1, math.isqrt(parts))

    def add(batches):
        total, part = None, 0
        for batch in batches:
            if batch.num_rows:
                part, b = batch.column("_part")[0].as_py(), block(batch)
                total = b if total is None else total + b
        if total is not None:
            yield _row(part, total)

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        total = sum(np.frombuffer(r["total"]) for r in rows)
        return pa.Table.from_batches([_row(rows[0]["part"] % root, total, rows[0]["shape"])])

    schema = "part long, total binary, shape array<int>"
    own = df.withColumn("_part", F.spark_partition_id().cast("long")).mapInArrow(add, schema)
    rows = own.groupBy(F.col("part") % root).applyInArrow(merge, schema).collect()
    total = None
    for r in sorted(rows, key=lambda r: r.part):
        b = np.frombuffer(r.total).reshape(r["shape"])
        total = b if total is None else total + b
    return total


def _row(part: int, total: np.ndarray, shape=None) -> pa.RecordBatch:
    shape = list(total.shape) if shape is None else shape
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary()), pa.array([shape], pa.list_(pa.int32()))], names=["part", "total", "shape"])


def partitions(df: DataFrame) -> int:
    """How many partitions of df have rows; no column is read."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()
