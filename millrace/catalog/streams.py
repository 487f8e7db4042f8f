"""Streaming jobs over the given tables, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.operators.alerts import baseline
from millrace.session import scratch_path
from millrace.sources.files import write_csv
from millrace.streaming import jobs


def _places(t, *names):
    return [scratch_path(t.spark, n) for n in names]


@query("st_file_ingest", "SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment, COALESCE(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END, 0) AS c_acctbal FROM customer")
def st_file_ingest(t):
    drop, sink, mark = _places(t, "drop", "sink", "mark")
    for start in (0, 1):
        part = t.customer.where(F.col("c_custkey") % 2 == start)
        write_csv(part.selectExpr("c_custkey", "c_mktsegment", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal"),
                  drop, "append")
    stream = jobs.watch_files(t.spark, drop, "c_custkey bigint, c_mktsegment string, c_acctbal double", per_batch=1)
    jobs.ingest(stream, [{"action_type": "text", "column": "c_mktsegment", "text_case": "uppercase"},
                         {"action_type": "impute", "column": "c_acctbal", "impute_method": "zero"}], sink, mark)
    return jobs.read_batches(t.spark, sink)


@query("src_watch", "SELECT COUNT(*) AS n_rows, 3::BIGINT AS n_files FROM supplier")
def src_watch(t):
    drop, seen, mark = _places(t, "drop", "seen", "mark")
    for start in (0, 1, 2):
        write_csv(t.supplier.where(F.col("s_suppkey") % 3 == start).select("s_suppkey", "s_name").coalesce(1), drop, "append")
    stream = jobs.watch_files(t.spark, drop, "s_suppkey bigint, s_name string").withColumn("file", F.input_file_name())
    jobs.on_new_files(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{seen}/batch={n}"), mark)
    return jobs.read_batches(t.spark, seen).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("file").alias("n_files"))


@query("st_webhook_events", "SELECT event_id, event_type, value, 'shop' AS _source FROM events")
def st_webhook_events(t):
    drop, sink, mark = _places(t, "hooks", "sink", "mark")
    t.events.select("event_id", "event_type", "value").write.json(drop)
    stream = jobs.webhook_events(t.spark, drop, "struct<event_id:bigint,event_type:string,value:double>", "shop")
    jobs.on_new_files(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{sink}/batch={n}"), mark)
    return jobs.read_batches(t.spark, sink)


@query("st_alerts", """
    WITH b AS (SELECT AVG(value) m FROM events), c AS (SELECT AVG(value * 2) m FROM events)
    SELECT 'metric_spike' AS rule, 'value' AS metric, ROUND((c.m - b.m) / b.m * 100, 1) AS pct_change FROM b, c""")
def st_alerts(t):
    drop, sink, mark = _places(t, "drop", "alerts", "mark")
    base = baseline(t.events, ["value"])
    t.events.withColumn("value", F.col("value") * 2).write.parquet(drop)
    jobs.alert_stream(jobs.parquet_stream(t.spark, drop), base, ["value"], sink, mark)
    return jobs.read_batches(t.spark, sink).select("rule", "metric", F.round("pct_change", 1).alias("pct_change"))


@query("st_quality", """
    SELECT 'not_null' AS type, TRUE AS passed, COUNT(*) FILTER (value IS NULL) AS failing FROM events UNION ALL SELECT 'range', FALSE, COUNT(*) FILTER (value > 100) FROM events""")
def st_quality(t):
    sink, verdicts, mark = _places(t, "sink", "verdicts", "mark")
    jobs.quality_stream(jobs.parquet_stream(t.spark, t.path("events")), [
        {"type": "not_null", "column": "value"}, {"type": "range", "column": "value", "max": 100, "severity": "warn"}],
        sink, verdicts, mark)
    return jobs.read_batches(t.spark, verdicts).select("type", "passed", "failing")


@query("st_daily_trend", "SELECT CAST(ts AS DATE) AS day, ROUND(SUM(value), 2) AS value, COUNT(*) AS n FROM events GROUP BY 1")
def st_daily_trend(t):
    sink, mark = _places(t, "daily", "mark")
    jobs.daily_trend(jobs.parquet_stream(t.spark, t.path("events")), "ts", "value", sink, mark, mode="update")
    return jobs.latest_days(t.spark, sink).withColumn("value", F.round("value", 2))


@query("st_daily_trend_complete", "SELECT CAST(ts AS DATE) AS day, ROUND(SUM(value), 2) AS value, COUNT(*) AS n FROM events GROUP BY 1")
def st_daily_trend_complete(t):
    sink, mark = _places(t, "daily", "mark")
    jobs.daily_trend(jobs.parquet_stream(t.spark, t.path("events")), "ts", "value", sink, mark, mode="complete")
    return t.spark.read.parquet(sink).withColumn("value", F.round("value", 2))


@query("st_dedupe", "SELECT event_id, user_id FROM events")
def st_dedupe(t):
    drop, sink, mark = _places(t, "drop", "unique", "mark")
    t.events.unionByName(t.events.where("event_id % 3 = 0")).write.parquet(drop)
    jobs.dedupe_stream(jobs.parquet_stream(t.spark, drop), ["event_id"], "ts", sink, mark)
    return jobs.read_batches(t.spark, sink).select("event_id", "user_id")
