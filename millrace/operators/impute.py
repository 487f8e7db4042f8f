"""Imputation rules that fill a gap from column statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import (
    as_double, col, is_fractional, is_numeric, is_time, missing, numeric_names, require, type_of,
)
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.stats import column_stats, modes, null_counts


@dataclass
class Cleaned:
    """A cleaned table plus one log row per action."""

    df: DataFrame
    log: list[dict[str, Any]] = field(default_factory=list)
    rows: int | None = None


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL."""
    return F.when(~F.isnan(col(name)), col(name)) if is_fractional(df, name) else col(name)


def fill_constants(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Fill gaps with one value per column; a fractional fill turns an integer column into double."""
    changes = {}
    for name, value in values.items():
        base = known(df, name)
        if isinstance(value, float) and is_numeric(df, name) and not value.is_integer():
            base = base.cast("double")
        elif is_numeric(df, name) and isinstance(value, str):
            base = base.cast("string")
        elif not is_numeric(df, name) and not is_time(df, name) and not isinstance(value, bool):
            value = str(value)
        kind = type_of(df, name) if is_numeric(df, name) and isinstance(value, (int, float)) else None
        literal = F.lit(value)
        if kind is not None and (not isinstance(value, float) or value.is_integer()):
            literal = literal.cast(kind)
        elif is_time(df, name):
            literal = literal.cast(type_of(df, name))
        changes[name] = F.coalesce(base, literal)
    return df.withColumns(changes) if changes else df


def flag_gaps(df: DataFrame, names: Sequence[str], suffix: str = "_imputed") -> DataFrame:
    """Boolean columns that remember which cells were missing."""
    return df.withColumns({f"{n}{suffix}": missing(df, n) for n in names})


def trimmed_mean(df: DataFrame, name: str, share: float) -> float | None:
    """Mean without the lowest and highest share of values, exact under ties."""
    view = df.select(as_double(df, name).alias("v")).where("v IS NOT NULL")
    n = view.count()
    cut = int(share * n)
    if n == 0 or n - 2 * cut <= 0:
        return None
    if n == 1:
        return view.agg(F.avg("v")).first()[0]
    low, high = exact_quantiles(view, {"v": [cut / (n - 1), (n - 1 - cut) / (n - 1)]}, n)["v"]
    if low == high:
        return low
    v = F.col("v")
    row = view.agg(
        F.sum(F.when((v > low) & (v < high), v)).alias("s"),
        F.count_if(v <= low).alias("below"),
        F.count_if(v >= high).alias("above"),
    ).first()
    total = (row["s"] or 0.0) + low * (row["below"] - cut) + high * (row["above"] - cut)
    return total / (n - 2 * cut)


def _typed_mode(df: DataFrame, name: str, text: str | None) -> Any:
    if text is None:
        return "Unknown"
    if is_numeric(df, name):
        value = float(text)
        return value if is_fractional(df, name) else int(value)
    return text


def fill_value(df: DataFrame, names: Sequence[str], method: str, **options: Any) -> dict[str, Any]:
    """The value each column is filled with under a method; columns it cannot serve are left out."""
    if method in ("mean", "median"):
        names = [n for n in names if is_numeric(df, n)]
        share = float(options.get("trim_percent") or 0.0)
        if method == "mean" and 0.0 < share < 0.5:
            return {n: v for n in names if (v := trimmed_mean(df, n, share)) is not None}
        if method == "mean":
            return {n: s.mean for n, s in column_stats(df, names).items() if s.mean is not None}
        found = exact_quantiles(df, {n: [0.5] for n in names})
        return {n: q[0] for n, q in found.items() if q[0] is not None}
    if method == "mode":
        return {n: _typed_mode(df, n, m[0] if m else None) for n, m in modes(df, names).items()}
    if method == "zero":
        return {n: 0 for n in names}
    if method == "constant":
        value = options.get("fill_value")
        return {n: "N/A" if value is None or str(value).strip() == "" else value for n in names}
    raise ValueError(f"unknown imputation method {method!r}")


def impute(df: DataFrame, names: Sequence[str], method: str = "median", **options: Any) -> DataFrame:
    require(df, names)
    return fill_constants(df, fill_value(df, names, method, **options))


def drop_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    for name in names:
        df = df.where(~missing(df, name))
    return df


def impute_auto(df: DataFrame, flag: bool = False) -> Cleaned:
    """Drop columns with more than 60 % gaps; fill the rest by mode, median or mean.

    Numbers take the median when they are skewed (or fewer than three are known), else the mean.
    """
    rows, gaps = null_counts(df, df.columns)
    gappy = {n: g for n, g in gaps.items() if g}
    log = []

    def entry(name: str, action: str, kind: str) -> None:
        log.append({"column": name, "missing": gaps[name], "pct_missing": round(gaps[name] / rows * 100, 1),
                    "action": action, "type": kind})

    dropped = [n for n, g in gappy.items() if g / rows * 100 > 60]
    for name in dropped:
        entry(name, "Dropped (>60% missing)", "drop")
    df = df.drop(*[col(n) for n in dropped])
    rest = [n for n in gappy if n not in dropped]
    numbers = [n for n in numeric_names(df) if n in rest]
    stats = column_stats(df, numbers, shape=True)
    skewed = [n for n in numbers if stats[n].known < 3 or abs(stats[n].skew or 0.0) > 1]
    middles = exact_quantiles(df, {n: [0.5] for n in skewed}, rows)
    common = modes(df, [n for n in rest if n not in numbers and not is_time(df, n)])
    values: dict[str, Any] = {}
    for name in rest:
        if name in numbers:
            value, word = (middles[name][0], "median") if name in middles else (stats[name].mean, "mean")
            if value is None:
                continue
            label = f"{word} ({value:.4g})"
        elif name in common:
            value = _typed_mode(df, name, common[name][0] if common[name] else None)
            label = f"mode ('{value}')"
        else:
            continue
        values[name] = value
        entry(name, f"Filled with {label}", "fill")
    flagged = flag_gaps(df, list(values)) if flag else df
    return Cleaned(fill_constants(flagged, values), log, rows)
