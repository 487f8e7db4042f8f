"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch_path, ship


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet`` by any path that Spark can read."""
    return ship(spark).read.parquet(os.path.join(folder, f"{name}.parquet"))


def text_of(name: str = "text") -> Column:
    """The text column with NULL read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch whose texts hold about ``max_bytes``; one long text may exceed it."""
    column = batch.column(batch.schema.get_field_index(text))
    start = held = 0
    for row, value in enumerate(column):
        size = len(value.as_buffer()) if value.is_valid else 0
        if row > start and held + size > max_bytes:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, which is removed at the end; nothing lazy may outlive it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table in whatever file system the shared folder is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
