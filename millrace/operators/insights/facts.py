"""Statistics that several findings need, each computed once per run."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.columns import as_double, col, is_numeric
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.stats import ColumnStats, column_stats, null_counts
from millrace.session import materialize

PROBS = (0.10, 0.25, 0.50, 0.75, 0.90)


@dataclass
class Insight:
    type: str
    title: str
    description: str
    importance: float
    metric: str = ""
    chart: str | None = None
    labels: list[str] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    meta: dict[str, float] = field(default_factory=dict)
    note: dict[str, str] = field(default_factory=dict)


def clamp(value: float, low: float = 0.0, high: float = 1.0) -> float:
    return max(low, min(high, value))


class Facts:
    """Lazy shared passes over one table and its column roles."""

    def __init__(self, df: DataFrame, schema: dict[str, Any]):
        self.df = df
        self.schema = schema
        self.metrics = [m for m in schema.get("metrics", []) if m in df.columns and is_numeric(df, m)]
        self.dimensions = [d for d in schema.get("dimensions", []) if d in df.columns]
        self.date = schema.get("date") if schema.get("date") in df.columns else None

    def warm(self) -> None:
        """Compute what several findings share before they run side by side."""
        self.nulls
        if self.metrics:
            self.stats, self.quantiles
        if self.dimensions:
            self.levels, self.level_counts

    @cached_property
    def nulls(self) -> tuple[int, dict[str, int]]:
        return null_counts(self.df, self.df.columns)

    @property
    def rows(self) -> int:
        return self.nulls[0]

    @cached_property
    def stats(self) -> dict[str, ColumnStats]:
        return column_stats(self.df, self.metrics, shape=True)

    @cached_property
    def quantiles(self) -> dict[str, dict[float, float]]:
        found = exact_quantiles(self.df, {m: PROBS for m in self.metrics}, self.rows)
        return {m: dict(zip(PROBS, q)) for m, q in found.items()}

    def fences(self, metric: str) -> tuple[float, float]:
        q1, q3 = self.quantiles[metric][0.25], self.quantiles[metric][0.75]
        return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)

    @cached_property
    def outlier_counts(self) -> dict[str, int]:
        """Rows outside the 1.5 IQR fences per metric; under "" the rows outside any of them."""
        usable = [m for m in self.metrics if self.stats[m].known >= 10]
        if not usable:
            return {"": 0}
        tests = {}
        for metric in usable:
            low, high = self.fences(metric)
            v = as_double(self.df, metric)
            tests[metric] = F.coalesce((v < low) | (v > high), F.lit(False))
        any_ = F.lit(False)
        for test in tests.values():
            any_ = any_ | test
        row = self.df.agg(F.count_if(any_), *[F.count_if(t) for t in tests.values()]).first()
        return {"": row[0]} | {m: row[i + 1] for i, m in enumerate(tests)}

    @cached_property
    def levels(self) -> DataFrame:
        """(dimension, label, n, total, mean) of the first metric for every value of every dimension: one pass,
        kept as a table of one row per value."""
        v = as_double(self.df, self.metrics[0]) if self.metrics else F.lit(None).cast("double")
        cells = F.array(*[F.struct(F.lit(d).alias("dimension"), col(d).cast("string").alias("label")) for d in self.dimensions])
        long = self.df.select(v.alias("v"), F.inline(cells)).where("label IS NOT NULL")
        return materialize(long.groupBy("dimension", "label").agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"), F.avg("v").alias("mean")))

    @cached_property
    def level_counts(self) -> dict[str, int]:
        """Number of values of each dimension."""
        return {r["dimension"]: r["count"] for r in self.levels.groupBy("dimension").count().collect()}

    def group(self, dimension: str, metric: str) -> DataFrame:
        """(label, total, mean) of one metric per value of a dimension."""
        if dimension in self.dimensions and metric == self.metrics[0]:
            return self.levels.where(F.col("dimension") == dimension).select("label", "total", "mean")
        v = as_double(self.df, metric)
        kept = self.df.where(col(dimension).isNotNull())
        return kept.groupBy(col(dimension).cast("string").alias("label")).agg(
            F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.avg(v).alias("mean"))
