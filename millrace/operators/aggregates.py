"""Grouped aggregates, duplicate removal and contingency tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import as_double, col, cols, numeric_names, quoted, require
from millrace.operators.quantiles import grouped_quantiles
from millrace.operators.shape import AGGREGATES

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def _ordered_pick(name: str, order: Sequence[str], first: bool) -> Column:
    """First or last known value of an explicit order, as a plain aggregate."""
    key = F.struct(*cols(order), col(name))
    held = F.when(col(name).isNotNull(), F.struct(key.alias("k"), col(name).alias("v")))
    return (F.min(held) if first else F.max(held))["v"]


def group_aggregate(
    df: DataFrame,
    group: Sequence[str],
    measures: dict[str, str] | None = None,
    order: Sequence[str] = (),
    drop_null_keys: bool = True,
) -> DataFrame:
    """One function per column, output keeps the column name; no measures means sum of numbers."""
    if not group:
        raise ValueError("grouping columns are required")
    require(df, group)
    wanted = {n: str(f).lower() for n, f in (measures or {}).items() if n in df.columns}
    if not wanted:
        wanted = {n: "sum" for n in numeric_names(df) if n not in group}
    data = df.dropna(subset=list(group)) if drop_null_keys else df
    plain, medians = [], []
    for name, word in wanted.items():
        if word == "median":
            medians.append(name)
        elif word in ("first", "last"):
            if not order:
                raise ValueError(f"{word} needs an order column")
            plain.append(_ordered_pick(name, order, word == "first").alias(name))
        elif word == "sum":
            plain.append(F.coalesce(F.sum(col(name)), F.lit(0)).alias(name))
        elif word in AGGREGATES:
            plain.append(AGGREGATES[word](col(name)).alias(name))
        else:
            raise ValueError(f"unknown aggregate {word!r}")
    out = data.groupBy(*cols(group)).agg(*plain) if plain else data.select(*cols(group)).distinct()
    for name in medians:
        table = grouped_quantiles(data, group, as_double(data, name), [0.5], [name])
        out = _match(out, table, group)
    return out.select(*cols(group), *cols(wanted))


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.toDF(*[f"_k{keys.index(n)}" if n in keys else n for n in right.columns])
    on = [left[quoted(k)].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)]
    return left.join(renamed, on).drop(*[f"_k{i}" for i in range(len(keys))])


def aggregate_metrics(df: DataFrame, group: Sequence[str], metrics: Sequence[dict[str, Any]]) -> DataFrame:
    """Metric list ``{agg, col, alias}``; global when there is no grouping column."""
    picks, medians = [], []
    for item in metrics:
        word, name = str(item["agg"]).lower(), item["col"]
        alias = item.get("alias", f"{item['agg']}_{name}")
        if word == "median":
            medians.append((name, alias))
            continue
        if not _IDENTIFIER.match(word):
            raise ValueError(f"bad aggregate name {item['agg']!r}")
        argument = "*" if name == "*" else quoted(name)
        picks.append(F.expr(f"{word}({argument})").alias(alias))
    out = df.groupBy(*cols(group)).agg(*picks) if picks else df.select(*cols(group)).distinct()
    for name, alias in medians:
        table = grouped_quantiles(df, group, as_double(df, name), [0.5], [alias])
        if group:
            out = _match(out, table, list(group))
        else:
            out = out.crossJoin(F.broadcast(table)) if picks else table
    names = [item.get("alias", f"{item['agg']}_{item['col']}") for item in metrics]
    return out.select(*cols(group), *cols(names))


def drop_duplicates(df: DataFrame, subset: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Distinct rows, or the first row per key of an explicit order (default: all other columns).

    The pick is a minimum over structs, so a hot key is combined map-side instead of being
    sorted in one window task.
    """
    if not subset:
        return df.distinct()
    require(df, [*subset, *order])
    rest = [n for n in df.columns if n not in subset]
    if not rest:
        return df.distinct()
    ranked = [*order, *[n for n in rest if n not in order]]
    picked = df.groupBy(*cols(subset)).agg(F.min(F.struct(*cols(ranked))).alias("_row"))
    return picked.select(
        *[col(n) if n in subset else F.col("_row")[n].alias(n) for n in df.columns]
    )


def value_counts(df: DataFrame, name: str, drop_null: bool = True) -> DataFrame:
    kept = df.where(col(name).isNotNull()) if drop_null else df
    return kept.groupBy(col(name)).agg(F.count(F.lit(1)).alias("count"))


def crosstab(df: DataFrame, left: str, right: str) -> DataFrame:
    """Contingency table in long form; missing values are left out."""
    return (
        df.dropna(subset=[left, right])
        .groupBy(col(left), col(right))
        .agg(F.count(F.lit(1)).alias("n"))
    )
