"""Outlier rules: fences from column statistics, then clip, drop, fill or empty the cells."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import as_double, col, is_numeric
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.stats import column_stats


class Fence(NamedTuple):
    """Values outside [low, high] are outliers; clipping pulls them to [clip_low, clip_high]."""

    low: float
    high: float
    clip_low: float
    clip_high: float


def iqr_fences(df: DataFrame, names: Sequence[str], factor: float = 1.5) -> dict[str, Fence]:
    out = {}
    for name, (q1, q3) in exact_quantiles(df, {n: [0.25, 0.75] for n in names}).items():
        if q1 is None:
            continue
        reach = factor * (q3 - q1)
        out[name] = Fence(q1 - reach, q3 + reach, q1 - reach, q3 + reach)
    return out


def percentile_fences(df: DataFrame, names: Sequence[str], low: float, high: float) -> dict[str, Fence]:
    found = exact_quantiles(df, {n: [low, high] for n in names})
    return {n: Fence(a, b, a, b) for n, (a, b) in found.items() if a is not None}


def _score_fences(df: DataFrame, centers: dict[str, tuple[float, float]], limit: float) -> dict[str, Fence]:
    """|x − center| / scale > limit, clipped at the 1st and 99th percentile."""
    edges = exact_quantiles(df, {n: [0.01, 0.99] for n in centers})
    return {
        n: Fence(center - limit * scale, center + limit * scale, *edges[n])
        for n, (center, scale) in centers.items()
    }


def zscore_fences(df: DataFrame, names: Sequence[str], limit: float = 3.0) -> dict[str, Fence]:
    stats = column_stats(df, names)
    return _score_fences(df, {n: (s.mean, s.std) for n, s in stats.items() if s.std}, limit)


def mad_fences(df: DataFrame, names: Sequence[str], limit: float = 3.0) -> dict[str, Fence]:
    """Median and 1.4826 × median absolute deviation; the standard deviation where that is 0."""
    middles = {n: q[0] for n, q in exact_quantiles(df, {n: [0.5] for n in names}).items() if q[0] is not None}
    apart = df.select(*[F.abs(as_double(df, n) - m).alias(n) for n, m in middles.items()])
    spreads = exact_quantiles(apart, {n: [0.5] for n in middles})
    flat = [n for n in middles if not spreads[n][0]]
    stats = column_stats(df, flat)
    centers = {}
    for name, middle in middles.items():
        scale = stats[name].std if name in flat else spreads[name][0] * 1.4826
        if scale:
            centers[name] = (middle, scale)
    return _score_fences(df, centers, limit)


def fences(df: DataFrame, names: Sequence[str], method: str = "iqr", **options: Any) -> dict[str, Fence]:
    names = [n for n in names if is_numeric(df, n)]
    limit = float(options.get("zscore_threshold", 3.0))
    if method == "iqr":
        return iqr_fences(df, names, float(options.get("multiplier_k", 1.5)))
    if method == "mad" or (method == "zscore" and options.get("zscore_method") == "mad"):
        return mad_fences(df, names, limit)
    if method == "zscore":
        return zscore_fences(df, names, limit)
    if method in ("percentile", "clip"):
        return percentile_fences(
            df, names, float(options.get("lower_percentile", 0.01)), float(options.get("upper_percentile", 0.99))
        )
    raise ValueError(f"unknown outlier method {method!r}")


def outside(df: DataFrame, name: str, fence: Fence) -> Column:
    v = as_double(df, name)
    return F.coalesce((v < fence.low) | (v > fence.high), F.lit(False))


def count_outside(df: DataFrame, found: dict[str, Fence]) -> dict[str, int]:
    if not found:
        return {}
    row = df.agg(*[F.count_if(outside(df, n, f)).alias(f"o{i}") for i, (n, f) in enumerate(found.items())]).first()
    return {n: row[i] for i, n in enumerate(found)}


def treat(df: DataFrame, found: dict[str, Fence], action: str = "clip") -> DataFrame:
    """Apply one action to every fenced column; a column without outliers keeps its type."""
    if action == "drop_rows":
        for name, fence in found.items():
            df = df.where(~outside(df, name, fence))
        return df
    changes: dict[str, Column] = {}
    middles = exact_quantiles(df, {n: [0.5] for n in found}) if action == "fill_median" else {}
    for name, fence in found.items():
        v = as_double(df, name)
        if action == "clip":
            held = F.least(F.greatest(v, F.lit(fence.clip_low)), F.lit(fence.clip_high))
            changes[name] = F.when(v.isNotNull(), held)
        elif action == "fill_median":
            changes[name] = F.when(outside(df, name, fence), F.lit(middles[name][0])).otherwise(v)
        elif action == "nullify":
            changes[name] = F.when(~outside(df, name, fence), col(name))
        else:
            raise ValueError(f"unknown outlier action {action!r}")
    return df.withColumns(changes) if changes else df


def treat_flagged(df: DataFrame, names: Sequence[str], flag: Column, action: str) -> DataFrame:
    """The same actions for rows flagged by a multivariate method."""
    if action == "drop_rows":
        return df.where(~flag)
    if action == "nullify":
        return df.withColumns({n: F.when(~flag, col(n)) for n in names})
    edges = exact_quantiles(df, {n: [0.01, 0.99] for n in names})
    return df.withColumns({
        n: F.when(flag & col(n).isNotNull(), F.least(F.greatest(as_double(df, n), F.lit(edges[n][0])),
                                                     F.lit(edges[n][1]))).otherwise(as_double(df, n))
        for n in names
    })
