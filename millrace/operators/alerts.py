"""Baselines of metrics and rules that compare a later table with them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.columns import as_double, present
from millrace.sources.storage import SharedFolder

# fixed values: names, thresholds and severities of the default rules. ``measure`` says what is compared and
# ``sign`` on which side of the threshold the rule fires.
DEFAULT_RULES = (
    {"name": "metric_drop", "threshold": -0.20, "severity": "warning", "measure": "mean", "sign": -1,
     "label": "Mean fell", "message": "The mean of {metric} is {pct}% lower than in the baseline."},
    {"name": "metric_spike", "threshold": 0.50, "severity": "info", "measure": "mean", "sign": 1,
     "label": "Mean rose", "message": "The mean of {metric} is {pct}% higher than in the baseline."},
    {"name": "critical_drop", "threshold": -0.40, "severity": "critical", "measure": "mean", "sign": -1,
     "label": "Mean collapsed", "message": "The mean of {metric} lost {pct}% against the baseline; look at it now."},
    {"name": "missing_values", "threshold": 0.05, "severity": "warning", "measure": "missing", "sign": 1,
     "label": "Gaps", "message": "{pct}% of the rows have no value in {metric}."},
    {"name": "row_count_drop", "threshold": -0.30, "severity": "warning", "measure": "rows", "sign": -1,
     "label": "Fewer rows", "message": "The {metric} is {pct}% below the baseline."},
)
SEVERITIES = ("critical", "warning", "info")
RULE_SCHEMA = "rule string, label string, severity string, message string, measure string, threshold double, sign int"
BASELINE_SCHEMA = "position int, metric string, row_count long, mean double, std double, missing double"
ALERT_SCHEMA = "rule string, label string, severity string, metric string, pct_change double, message string"


def baseline(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per metric (mean, deviation, missing share, table rows) from one aggregate."""
    names = present(df, metrics)
    picks = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        v = as_double(df, name)
        picks += [F.avg(v).alias(f"a{i}"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"s{i}"),
                  F.avg(v.isNull().cast("double")).alias(f"m{i}")]
    lines = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("metric"), F.col("n").alias("row_count"),
                 F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"m{i}").alias("missing"))
        for i, n in enumerate(names)
    ] or [F.struct(F.lit(0).alias("position"), F.lit("").alias("metric"), F.col("n").alias("row_count"),
                   F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"),
                   F.lit(None).cast("double").alias("missing"))]
    return df.agg(*picks).select(F.inline(F.array(*lines)))


def save_baseline(df: DataFrame, metrics: Sequence[str], path: str) -> DataFrame:
    """Store a baseline as a small table in shared storage."""
    baseline(df, metrics).coalesce(1).write.mode("overwrite").parquet(path)
    return load_baseline(df.sparkSession, path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASELINE_SCHEMA).parquet(path)


def _readings(base: DataFrame, now: DataFrame) -> DataFrame:
    """(measure, metric, position, value): what can be compared between a baseline and the current numbers."""
    old = base.select("metric", F.col("mean").alias("was"))
    both = now.join(old, "metric", "left").where("metric <> ''")
    moved = F.try_divide(F.col("mean") - F.col("was"), F.abs("was"))
    kinds = F.array(F.struct(F.lit("mean").alias("measure"), moved.alias("value")),
                    F.struct(F.lit("missing").alias("measure"), F.col("missing").alias("value")))
    each = both.select("metric", "position", F.inline(kinds)).select("measure", "metric", "position", "value")
    # one row on either side
    sizes = now.agg(F.max("row_count").alias("n")).join(F.broadcast(base.agg(F.max("row_count").alias("n0"))))
    shrunk = sizes.select(F.lit("rows").alias("measure"), F.lit("row count").alias("metric"), F.lit(0).alias("position"),
                          (F.try_divide(F.col("n"), F.col("n0")) - 1).alias("value"))
    return each.unionByName(shrunk).where("value IS NOT NULL")


def evaluate(base: DataFrame, now: DataFrame, rules: Sequence[dict[str, Any]] = DEFAULT_RULES) -> DataFrame:
    """Alerts, critical ones first, as one lazy table.

    Every rule is joined to the readings of its measure and fires on those beyond its threshold. It reports
    one of them: the first metric with gaps, otherwise the one that moved furthest.
    """
    known = {r["name"]: r for r in DEFAULT_RULES}
    table = now.sparkSession.createDataFrame(
        [(r["name"], r.get("label", r["name"]), r["severity"], r.get("message", "{metric}: {pct}%"),
          r.get("measure", known.get(r["name"], {}).get("measure", "mean")), float(r["threshold"]),
          int(r.get("sign", known.get(r["name"], {}).get("sign", -1)))) for r in rules], RULE_SCHEMA)
    beyond = F.col("sign") * (F.col("value") - F.col("threshold"))
    fired = _readings(base, now).join(F.broadcast(table), "measure").where(beyond > 0)
    order = F.when(F.col("measure") == "missing", F.col("position")).otherwise(-beyond)
    percent = F.abs("value") * 100
    shown = F.struct("label", "severity", "message", "metric",
                     F.when(F.col("measure") == "rows", percent).otherwise(F.round(percent, 1)).alias("pct_change"))
    picked = fired.groupBy("rule").agg(F.min_by(shown, F.struct(order, "metric")).alias("hit")).select("rule", "hit.*")
    pct = F.round("pct_change", 1).cast("string")
    text = F.replace(F.replace("message", F.lit("{metric}"), F.col("metric")), F.lit("{pct}"), pct)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return picked.withColumn("message", text).orderBy(F.when(rank > 0, rank).otherwise(9), "rule").select(
        "rule", "label", "severity", "metric", "pct_change", "message")


def check(
    df: DataFrame, metrics: Sequence[str], path: str, rules: Sequence[dict[str, Any]] = DEFAULT_RULES
) -> DataFrame:
    """Compare a table with the stored baseline.

    No baseline yet, or one of columns the table no longer has, means a new baseline and no alert.
    """
    spark = df.sparkSession
    stored = load_baseline(spark, path) if SharedFolder(spark, path).exists("_SUCCESS") else None
    if stored is not None and not {r[0] for r in stored.select("metric").collect()} <= {*df.columns, ""}:
        stored = None
    if stored is None:
        save_baseline(df, metrics, path)
        return spark.createDataFrame([], ALERT_SCHEMA)
    return evaluate(stored, baseline(df, metrics), rules)
