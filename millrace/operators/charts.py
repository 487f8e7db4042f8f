"""Aggregates behind charts. Every function returns (label, value…) rows, never more than a chart shows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.columns import as_double, col, numeric_names, resolve_column, rounded
from millrace.functions.dates import period_start
from millrace.operators.profile import correlation_long, id_like
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.shape import sample_rows, top_n_with_other
from millrace.operators.stats import column_stats, modes, null_counts

_MEASURES = {"sum": F.sum, "mean": F.avg, "count": F.count}


def _groups(df: DataFrame, x: str, y: str | None, how: str) -> DataFrame:
    """(label, value) per group of x; rows count when there is no y."""
    kept = df.where(col(x).isNotNull())
    if y is None or how == "count":
        value = F.count(F.lit(1)).cast("double")
    else:
        kept = kept.where(as_double(df, y).isNotNull())
        value = _MEASURES[how](as_double(df, y))
    return kept.groupBy(col(x).cast("string").alias("label")).agg(value.alias("value"))


def _best(groups: DataFrame, n: int) -> DataFrame:
    """The n largest groups, ties by label, values to 2 decimals."""
    top = groups.orderBy(F.desc("value"), "label").limit(n)
    return top.select("label", F.round("value", 2).alias("value"))


def bar(df: DataFrame, x: str, y: str | None = None, how: str = "count", order: Sequence[str] = ()) -> DataFrame:
    """Groups by falling value, at most 500; ``none`` gives the first 500 raw rows of an order."""
    if how != "none":
        return _best(_groups(df, x, y, how), 500)
    if not order:
        raise ValueError("raw points need an order column")
    kept = df.dropna(subset=[x, y] if y else [x]).orderBy(*[col(o) for o in order]).limit(500)
    value = F.coalesce(as_double(df, y), F.lit(0.0)) if y else F.lit(1.0)
    return kept.select(col(x).cast("string").alias("label"), value.alias("value"))


def pie(df: DataFrame, x: str, y: str | None = None, how: str = "count", n: int = 10) -> DataFrame:
    return top_n_with_other(df, x, y, how, n)


def _edges(df: DataFrame, name: str) -> tuple[float, float] | None:
    low, high = df.agg(F.min(as_double(df, name)), F.max(as_double(df, name))).first()
    if low is None:
        return None
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def _all_bins(df: DataFrame, counted: DataFrame, bins: int, low: float, width: float) -> DataFrame:
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    joined = every.join(F.broadcast(counted), "bin", "left")
    return joined.select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("bin_low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_high"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, name: str, bins: int = 15) -> DataFrame:
    """Equal-width bins, each closed on the left, the last one on both sides; empty bins included."""
    span = _edges(df, name)
    if span is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_low double, bin_high double, n long")
    low, high = span
    width = (high - low) / bins
    v = as_double(df, name)
    bin_ = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counted = df.where(v.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _all_bins(df, counted, bins, low, width)


def cut(df: DataFrame, name: str, bins: int = 4) -> DataFrame:
    """Equal-width ranges, each closed on the right, the first one on both sides."""
    span = _edges(df, name)
    if span is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_low double, bin_high double, n long")
    low, high = span
    width = (high - low) / bins
    v = as_double(df, name)
    bin_ = F.greatest(F.ceil((v - low) / (high - low) * bins) - 1, F.lit(0)).cast("int")
    counted = df.where(v.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _all_bins(df, counted, bins, low, width)


def box(df: DataFrame, name: str) -> DataFrame:
    """Quartiles and the extreme values inside the 1.5 IQR fences."""
    v = as_double(df, name)
    q1, middle, q3 = exact_quantiles(df, {name: [0.25, 0.5, 0.75]})[name]
    if q1 is None:
        return df.sparkSession.createDataFrame([], "min double, q1 double, median double, q3 double, max double")
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return df.agg(F.min(F.when(v >= low, v)).alias("min"), F.lit(q1).alias("q1"), F.lit(middle).alias("median"),
                  F.lit(q3).alias("q3"), F.max(F.when(v <= high, v)).alias("max"))


def scatter(df: DataFrame, x: str, y: str, key: Sequence[str], n: int = 500, seed: int = 42) -> DataFrame:
    """At most n sampled points, the same on every run, sorted by x."""
    points = df.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(key)], as_double(df, x).alias("x"),
                       as_double(df, y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return sample_rows(points, [f"_k{i}" for i in range(len(key))], n, seed).select("x", "y").orderBy("x", "y")


def radar(df: DataFrame, x: str, y: str | None = None, how: str = "count", n: int = 8) -> DataFrame:
    return _best(_groups(df, x, y, how), n)


def heatmap(df: DataFrame, limit: int = 10) -> DataFrame:
    return correlation_long(df, numeric_names(df)[:limit])


def waterfall(df: DataFrame, x: str, y: str | None = None, n: int = 8) -> DataFrame:
    """The first n groups in key order plus their net total."""
    groups = _groups(df, x, y, "sum" if y else "count").orderBy("label").limit(n)
    shown = groups.select("label", F.round("value", 2).alias("value"))
    total = shown.agg(F.round(F.sum("value"), 2).alias("value")).select(F.lit("Net Total").alias("label"), "value")
    return shown.unionByName(total)


def funnel(df: DataFrame, x: str, y: str | None = None, how: str = "count", n: int = 6) -> DataFrame:
    """The n largest groups with their share of the largest in percent."""
    top = _best(_groups(df, x, y, "sum" if y and how == "sum" else "count"), n)
    # n rows in one window
    first = F.first("value").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("value"), "label"))
    base = F.when(first > 0, first).otherwise(F.lit(1.0))
    return top.withColumn("pct", F.round(F.col("value") / base * 100, 1))


def combo(df: DataFrame, x: str, y: str | None = None, n: int = 10) -> DataFrame:
    """Row counts as bars and the mean of y as a line for the n largest groups."""
    kept = df.where(col(x).isNotNull())
    bars = F.count(F.lit(1)).cast("double").alias("bars")
    mean = F.coalesce(F.avg(as_double(df, y)), F.lit(0.0)) if y else F.count(F.lit(1)) * 1.05
    groups = kept.groupBy(col(x).cast("string").alias("label")).agg(bars, F.round(mean, 2).alias("lines"))
    return groups.orderBy(F.desc("bars"), "label").limit(n)


def month_trend(df: DataFrame, date: str, metric: str, count: bool = False, n: int = 24) -> DataFrame:
    """Monthly sums (or counts of an identifier), the last n months in order."""
    value = F.count(col(metric)).cast("double") if count else F.sum(as_double(df, metric))
    kept = df.where(col(date).isNotNull() & col(metric).isNotNull())
    months = kept.groupBy(period_start(col(date), "M").alias("month")).agg(F.round(value, 2).alias("value"))
    return months.orderBy(F.desc("month")).limit(n).orderBy("month")


def answer_chart(df: DataFrame, x: str, y: str | None = None, n: int | None = None) -> DataFrame:
    """Chart of an answer: mean of y by x, or counts of x."""
    groups = _groups(df, x, y, "mean" if y else "count")
    ranked = groups.orderBy(F.desc("value"), "label")
    return ranked.limit(int(n)) if n else ranked


def default_charts(df: DataFrame, dimension: str, metric: str, second: str | None = None) -> DataFrame:
    """The automatic set: metric sums, means (counts for an identifier) and a second dimension."""
    by_id = id_like(df, metric)
    parts = [
        _best(_groups(df, dimension, metric, "sum"), 15).withColumn("chart", F.lit("bar")),
        _best(_groups(df.where(col(metric).isNotNull()), dimension, metric, "count" if by_id else "mean"), 10)
        .withColumn("chart", F.lit("top_cat")),
    ]
    if second:
        parts.append(_best(_groups(df, second, metric, "mean"), 8).withColumn("chart", F.lit("cat2")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("chart", "label", "value")


def completeness_band(score: float) -> str:
    for limit, word in ((95, "Excellent"), (85, "Good"), (70, "Fair")):
        if score >= limit:
            return word
    return "Needs Attention"


def kpi_stats(df: DataFrame, dimension: str | None = None, metric: str | None = None) -> DataFrame:
    """Cards of a dashboard: rows, metric total and mean, distinct values and mode, completeness."""
    rows, gaps = null_counts(df, df.columns)
    cards: list[tuple[str, str, float, str]] = [("rows", "Total Records", float(rows), f"{len(df.columns)} Columns")]
    if metric in df.columns:
        s = column_stats(df, [metric])[metric]
        if s.known:
            cards.append(("sum", f"Total {metric}", rounded(s.total, 2), f"Avg: {s.mean:.4f}"))
    if dimension in df.columns:
        found = modes(df, [dimension])[dimension]
        if found:
            n = df.agg(F.count_distinct(col(dimension))).first()[0]
            cards.append(("distinct", f"Unique {dimension}", float(n), f"Top: {found[0]}"))
    cells = rows * len(df.columns)
    score = 100.0 - (sum(gaps.values()) / cells * 100 if cells else 0.0)
    cards.append(("completeness", "Data Completeness", rounded(score, 1), completeness_band(score)))
    return df.sparkSession.createDataFrame(cards, "type string, label string, value double, sub string")


def id_stats(df: DataFrame) -> DataFrame | None:
    """Range and distinct count of the first identifier-like numeric column."""
    for name in numeric_names(df):
        if id_like(df, name):
            return df.agg(F.lit(name).alias("col"), F.min(as_double(df, name)).alias("min"),
                          F.max(as_double(df, name)).alias("max"), F.count_distinct(col(name)).alias("total"))
    return None


def chart(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """A chart from its saved configuration; column names are matched without case."""
    x = resolve_column(spec.get("x_col"), df.columns)
    y = resolve_column(spec.get("y_col"), df.columns)
    kind, how = spec.get("chart_type", "bar"), spec.get("agg_type", "count")
    if kind == "heatmap":
        return heatmap(df)
    if x is None:
        raise ValueError(f"chart column {spec.get('x_col')!r} not found")
    if kind == "scatter":
        return scatter(df, x, y, spec["key"])
    if kind == "histogram":
        return histogram(df, x)
    if kind == "boxplot":
        return box(df, x)
    if kind in ("radar", "polarArea"):
        return radar(df, x, y, how if y else "count")
    if kind == "waterfall":
        return waterfall(df, x, y)
    if kind == "funnel":
        return funnel(df, x, y, how)
    if kind == "combo":
        return combo(df, x, y)
    if kind in ("pie", "doughnut") and how != "none":
        return pie(df, x, y, how if y else "count", int(spec.get("top_n", 10)))
    return bar(df, x, y, how if y or how == "none" else "count", spec.get("order", ()))
