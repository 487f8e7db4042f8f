"""Structured Streaming versions of ingestion, quality checks, alerts, trends and de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.columns import col, micros
from millrace.operators.alerts import BASELINE_SCHEMA, DEFAULT_RULES, baseline, evaluate
from millrace.plans.cleaning import Rule, clean_rules
from millrace.plans.quality import Check, gate_fails, settle_checked, verdict_table


def watch_files(
    spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "csv", per_batch: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """New files of a folder as a stream; a schema is required so that batches agree."""
    reader = spark.readStream.schema(schema).format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    if is_file:
        return watch_files(spark, folder, schema, "parquet", pattern=name)
    return watch_files(spark, path, schema, "parquet")


def webhook_events(spark: SparkSession, folder: str, schema: T.StructType | str, source: str) -> DataFrame:
    """Landed JSON payloads, one per line, tagged with where they came from."""
    lines = spark.readStream.text(folder)
    record = schema if isinstance(schema, str) else schema.simpleString()
    parsed = lines.select(F.from_json("value", record).alias("event")).where("event IS NOT NULL")
    return parsed.select("event.*", F.lit(source).alias("_source"))


def event_time(stream: DataFrame, name: str) -> DataFrame:
    """Watermarks need an instant: the wall-clock time is taken as UTC whatever the session zone."""
    return stream.withColumn(name, F.timestamp_micros(micros(stream, name)))


def utc_day(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / 86_400_000_000).cast("int"))


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool,
           mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


def ingest(
    stream: DataFrame, rules: Sequence[Rule], sink: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Clean every batch and store it under its batch number, so a repeated batch replaces itself."""

    def handle(batch: DataFrame, number: int) -> None:
        clean_rules(batch, rules).df.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return _start(stream, handle, checkpoint, once)


def on_new_files(
    stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Call back with every batch of new rows."""
    return _start(stream, callback, checkpoint, once)


def alert_stream(
    stream: DataFrame, base: DataFrame, metrics: Sequence[str], sink: str, checkpoint: str,
    rules: Sequence[dict[str, Any]] = DEFAULT_RULES, once: bool = True,
) -> StreamingQuery:
    """Compare every batch with a stored baseline and append the alerts it raises.

    The baseline (a row for each metric) is read once, when the stream starts.
    """
    rows = base.collect()

    def handle(batch: DataFrame, number: int) -> None:
        fixed = batch.sparkSession.createDataFrame(rows, BASELINE_SCHEMA)
        evaluate(fixed, baseline(batch, metrics), rules).coalesce(1).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return _start(stream, handle, checkpoint, once)


class GateFailed(RuntimeError):
    pass


def quality_stream(
    stream: DataFrame, checks: Sequence[Check], sink: str, verdicts: str, checkpoint: str, stop: bool = True,
    once: bool = True,
) -> StreamingQuery:
    """Check every batch, store the verdicts, pass the rows on, and stop on an error when asked to.

    A batch is computed once, into a checkpoint: its row-level checks are metrics observed meanwhile. Rows of a
    batch that stops the stream never reach the sink.
    """

    def handle(batch: DataFrame, number: int) -> None:
        held, found = settle_checked(batch, checks)
        verdict_table(held, found).coalesce(1).write.mode("overwrite").parquet(f"{verdicts}/batch={number}")
        if gate_fails(found) and stop:
            raise GateFailed(f"batch {number}: {[v.detail for v in found if not v.passed]}")
        held.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return _start(stream, handle, checkpoint, once)


def daily_trend(
    stream: DataFrame, time: str, metric: str, sink: str, checkpoint: str, lateness: str = "1 day",
    mode: str = "append", once: bool = True,
) -> StreamingQuery:
    """Daily sums of a metric. A day is stored, once, when the watermark has passed it, and its state goes;
    with ``update`` the days that a batch changes are stored with it (see ``latest_days``), so that open ones
    count too; with ``complete`` all days are stored anew with every batch."""
    timed = event_time(stream, time).withWatermark(time, lateness)
    daily = timed.groupBy(F.window(col(time), "1 day")).agg(F.sum(col(metric)).alias("value"), F.count(F.lit(1)).alias("n"))
    shown = daily.select(utc_day(F.col("window.start")).alias("day"), "value", "n")

    def handle(batch: DataFrame, number: int) -> None:
        target = sink if mode == "complete" else f"{sink}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    return _start(shown, handle, checkpoint, once, mode)


def dedupe_stream(
    stream: DataFrame, keys: Sequence[str], time: str, sink: str, checkpoint: str, lateness: str = "1 day",
    once: bool = True,
) -> StreamingQuery:
    """First row per key; keys are forgotten once the watermark has passed them."""
    timed = event_time(stream, time).withWatermark(time, lateness)
    unique = timed.dropDuplicatesWithinWatermark(list(keys))

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return _start(unique, handle, checkpoint, once)


def latest_days(spark: SparkSession, sink: str) -> DataFrame:
    """Every day of a daily trend in ``update`` mode as the last batch that changed it has stored it."""
    newest = F.max_by(F.struct("value", "n"), "batch")
    return spark.read.parquet(sink).groupBy("day").agg(newest.alias("row")).select("day", "row.value", "row.n")


def read_batches(spark: SparkSession, sink: str) -> DataFrame:
    """All batches a stream has stored."""
    return spark.read.parquet(sink).drop("batch")
