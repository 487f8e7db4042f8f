"""One-pass statistics of many columns, shared by cleaning, profiles, insights and alerts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import as_double, col, missing, type_of
from millrace.operators.quantiles import exact_quantiles


@dataclass
class ColumnStats:
    rows: int
    known: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None
    total: float | None
    skew: float | None
    kurtosis: float | None

    @property
    def nulls(self) -> int:
        return self.rows - self.known

    @property
    def null_share(self) -> float:
        return self.nulls / self.rows if self.rows else 0.0


def sample_skew(g1: float | None, n: int) -> float | None:
    """Sample skewness from the population one."""
    if g1 is None or n < 3 or math.isnan(g1):
        return None
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def sample_kurtosis(g2: float | None, n: int) -> float | None:
    """Sample excess kurtosis from the population one."""
    if g2 is None or n < 4 or math.isnan(g2):
        return None
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both are known; NULL (not an error) when one is constant."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def null_counts(df: DataFrame, names: Sequence[str]) -> tuple[int, dict[str, int]]:
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(missing(df, n)).alias(f"m{i}") for i, n in enumerate(names)],
    ).first()
    return row["n"], {n: row[f"m{i}"] for i, n in enumerate(names)}


def column_stats(df: DataFrame, names: Sequence[str], shape: bool = False) -> dict[str, ColumnStats]:
    """Moments of several numeric columns in one aggregate job."""
    if not names:
        return {}
    picks = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        v = as_double(df, name)
        picks += [F.count(v).alias(f"k{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                  F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"), F.sum(v).alias(f"t{i}")]
        if shape:
            picks += [F.skewness(v).alias(f"w{i}"), F.kurtosis(v).alias(f"u{i}")]
    row = df.agg(*picks).first()
    out = {}
    for i, name in enumerate(names):
        known = row[f"k{i}"]
        out[name] = ColumnStats(
            row["n"], known, row[f"a{i}"], row[f"s{i}"], row[f"l{i}"], row[f"h{i}"], row[f"t{i}"],
            sample_skew(row[f"w{i}"], known) if shape else None,
            sample_kurtosis(row[f"u{i}"], known) if shape else None,
        )
    return out


def column_quantiles(
    df: DataFrame, wanted: dict[str, Sequence[float]], rows: int | None = None
) -> dict[str, list[float | None]]:
    return exact_quantiles(df, wanted, rows)


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), (T.NumericType, T.BooleanType))


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[object, int] | None]:
    """Most frequent value of each column with its count; ties go to the smallest value.

    Values are counted per (column, value), so no column's values are held in one place.
    """
    if not names:
        return {}
    parts = []
    for name in names:
        number = col(name).cast("double") if _is_number(df, name) else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(name).alias("name"), number.alias("d"), col(name).cast("string").alias("s")))
    long = df.select(F.inline(F.array(*parts))).where("s IS NOT NULL AND NOT coalesce(isnan(d), false)")
    counted = long.groupBy("name", "d", "s").agg((-F.count(F.lit(1))).alias("n"))
    best = counted.groupBy("name").agg(F.min(F.struct("n", "d", "s")).alias("b")).collect()
    found = {r["name"]: (r["b"]["s"], -r["b"]["n"]) for r in best}
    return {n: found.get(n) for n in names}


def _typed_value(df: DataFrame, name: str) -> Column:
    """A cell as a struct (l, d, s) with one member set: whole numbers and times as longs, other numbers as doubles."""
    kind, value = type_of(df, name), col(name)
    whole = real = text = None
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        whole = value.cast("long")
    elif isinstance(kind, T.DateType):
        whole = F.unix_date(value).cast("long")
    elif isinstance(kind, T.TimestampType):
        whole = F.unix_micros(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        real = value.cast("double")
    else:
        text = value.cast("string")
    members = (whole, "long", "l"), (real, "double", "d"), (text, "string", "s")
    return F.struct(*[(F.lit(None).cast(t) if v is None else v).alias(n) for v, t, n in members])


def distinct_counts(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """Exact distinct counts of all columns in one job over (column, value) pairs; numbers move as numbers."""
    if not names:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("c"), _typed_value(df, n).alias("v")) for i, n in enumerate(names)])
    long = df.select(F.inline(cells)).select("c", "v.l", "v.d", "v.s").where("l IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL")
    found = {names[r["c"]]: r["count"] for r in long.distinct().groupBy("c").count().collect()}
    return {n: found.get(n, 0) for n in names}


def distinct_near(df: DataFrame, names: Sequence[str], rows: int, limits: Sequence[float]) -> dict[str, int]:
    """Distinct counts good enough to compare with limits.

    A sketch counts every column in one pass without a shuffle; only columns whose estimate lies
    close to a limit, or is small, are counted exactly.
    """
    if not names:
        return {}
    row = df.agg(*[F.approx_count_distinct(col(n), 0.02).alias(f"d{i}") for i, n in enumerate(names)]).first()
    rough = {n: min(row[i], rows) for i, n in enumerate(names)}
    unsure = [n for n, d in rough.items() if d <= 1000 or any(abs(d - x) <= 0.12 * max(d, x) for x in limits)]
    return rough | distinct_counts(df, unsure)
