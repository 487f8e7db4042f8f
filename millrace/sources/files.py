"""Files in and out: CSV, JSON, Parquet, landed pages and drop folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import col, nan_to_null
from millrace.session import materialize
from millrace.sources.nested import flatten

ENCODINGS = ("UTF-8", "ISO-8859-1", "windows-1252")
# fixed values: keys that wrap a list of records, in this order
WRAPPER_KEYS = ("data", "items", "records", "rows", "results")


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line does not decode; the scan stops at the first such line."""
    lines = spark.read.text(path)
    broken = lines.where(~F.is_valid_utf8("value")).limit(1).count()
    return ENCODINGS[1] if broken else ENCODINGS[0]


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    encoding: str | None = None,
    header: bool = True,
) -> DataFrame:
    """CSV with a header; give a schema for large inputs, else types are inferred in one more pass."""
    reader = spark.read.option("header", header).option("encoding", encoding or sniff_encoding(spark, path))
    reader = reader.option("escape", '"').option("multiLine", False)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*[col(c) for c in columns]) if columns else df)


def unwrap(df: DataFrame) -> DataFrame:
    """Records inside a wrapper object: one row per element of the first wrapper key that is a list."""
    for key in WRAPPER_KEYS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            if isinstance(df.schema[key].dataType.elementType, T.StructType):
                return df.select(F.inline(col(key)))
            return df.select(F.explode(col(key)).alias(key))
    return df


def read_json(
    spark: SparkSession, path: str, lines: bool = True, schema: T.StructType | str | None = None
) -> DataFrame:
    """JSON lines, a JSON array or an object with a wrapper key; nested objects become dotted columns."""
    reader = spark.read.option("multiLine", not lines)
    reader = reader.schema(schema) if schema is not None else reader
    return flatten(unwrap(reader.json(path)))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Name, size and modification time of the files of a folder, without reading their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path",
                        F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_latest(spark: SparkSession, folder: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The newest CSV of a drop folder."""
    newest = list_files(spark, folder).agg(F.max_by("path", F.struct("modified", "path"))).first()[0]
    if newest is None:
        raise ValueError(f"no CSV file in {folder}")
    return read_csv(spark, newest, schema)


def concat_pages(pages: DataFrame, page: str, size: int) -> DataFrame:
    """Rows of consecutive pages up to and including the first page shorter than ``size``.

    A page that is absent ends the run like an empty one. Only two numbers reach the driver.
    """
    sizes = materialize(pages.groupBy(col(page)).agg(F.count(F.lit(1)).alias("_n")))  # a row per page, counted once
    short = sizes.agg(F.min(F.when(F.col("_n") < size, col(page)))).first()[0]
    nexts = sizes.select((col(page) + 1).alias("_next"))
    last = nexts.join(sizes, F.col("_next") == col(page), "left_anti").agg(F.min("_next")).first()[0]
    ends = [e for e in (short, None if last is None else last - 1) if e is not None]
    return pages.where(col(page) <= min(ends)) if ends else pages


def read_pages(spark: SparkSession, folder: str, size: int, schema: T.StructType | str | None = None) -> DataFrame:
    """Landed pages of JSON records as one table.

    The number of a page stands in its path (``…page=N/…``) or, where a file holds many pages, as ``page`` in each record.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return concat_pages(reader.json(folder), "page", size)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
