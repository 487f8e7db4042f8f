"""Polynomial interpolation of gaps from the nearest known points.

A gap between known values takes the value of the polynomial of the given order through the order+1
nearest known rows. Those points are carried to the gap as arrays of bounded length, so no series is
collected anywhere, nor are gaps joined with points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.columns import as_double, cols, is_numeric, require
from millrace.operators.ordered import BLOCK, Ordered


def _lagrange(points: Column, at: Column) -> Column:
    """Value at ``at`` of the polynomial through an array of (pos, val)."""

    def term(p: Column) -> Column:
        factors = F.transform(
            F.filter(points, lambda q: q["pos"] != p["pos"]),
            lambda q: (at - q["pos"]) / (p["pos"] - q["pos"]),
        )
        return p["val"] * F.aggregate(factors, F.lit(1.0), lambda a, x: a * x)

    return F.aggregate(F.transform(points, term), F.lit(0.0), lambda a, x: a + x)


def interpolate_curve(
    df: DataFrame, names: Sequence[str], order: Sequence[str], partition: Sequence[str] = (), degree: int = 2
) -> DataFrame:
    """Fill inner gaps by a local polynomial; the edges take the nearest known value."""
    require(df, names)
    if not 1 <= degree <= 5:
        raise ValueError("the polynomial order must be 1 to 5")
    bad = [n for n in names if not is_numeric(df, n)]
    if bad:
        raise ValueError(f"interpolation needs numeric columns: {bad}")
    each = math.ceil((degree + 1) / 2)
    out = df
    for name in names:
        run = Ordered(out, order, partition)
        run.number("_pos")
        run.df = run.df.withColumn("_v", as_double(out, name))
        _points_beside(run, each)
        closest = F.slice(
            F.array_sort(F.transform(F.concat("_left", "_right"), lambda p: F.struct(
                F.abs(p["pos"] - F.col("_pos")).alias("far"), p["pos"].alias("pos"), p["val"].alias("val")))),
            1, degree + 1)
        gap = F.when(F.size("_left") == 0, F.get("_right", F.lit(0))["val"]).when(
            F.size("_right") == 0, F.get(F.reverse("_left"), F.lit(0))["val"]).otherwise(
            _lagrange(closest, F.col("_pos").cast("double")))
        out = run.df.withColumn(name, F.when(F.col("_v").isNotNull(), F.col("_v")).otherwise(gap)).select(*cols(df.columns))
    return out


def _points_beside(run: Ordered, each: int) -> None:
    """Arrays ``_left`` and ``_right``: the up to ``each`` known points (pos, val) before and after each gap, by position.

    Known rows hold themselves and their known neighbours, and every gap takes what the nearest known row on a side holds. All
    windows are those of the numbering, sorted in other ways, so rows move for it once.
    """
    keys = cols([*run.partition, BLOCK] if run.blocked else run.partition) or [F.lit(0)]
    has = F.col("_v").isNotNull()
    point = F.struct(F.col("_pos").alias("pos"), F.col("_v").alias("val"))
    known = Window.partitionBy(*keys, has).orderBy("_pos")
    past = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*keys).orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def held(shift) -> Column:
        near = [point, *[shift(point, k).over(known) for k in range(1, each)]]
        return F.when(has, F.filter(F.array(*near), lambda p: p.isNotNull()))

    def nearest(parts: Column) -> Column:
        return F.slice(parts, 1, each)

    # nearest first: own block, then the blocks beside it
    run.df = run.df.withColumns({"_tail": held(F.lag), "_head": held(F.lead)})
    run.with_carry({"_tails": F.max_by("_tail", F.when(has, F.col("_pos")))},
                   lambda n, w: nearest(F.flatten(F.reverse(F.collect_list(n).over(w)))))
    run.with_carry({"_heads": F.min_by("_head", F.when(has, F.col("_pos")))},
                   lambda n, w: nearest(F.flatten(F.reverse(F.collect_list(n).over(w)))), False)
    empty = F.filter(F.array(point), lambda p: F.lit(False))
    for name, own, window, beyond in (("_left", "_tail", past, "_tails"), ("_right", "_head", later, "_heads")):
        parts = [F.coalesce(F.last(own, ignorenulls=True).over(window), empty)]
        parts += [F.coalesce(F.col(beyond), empty)] if run.blocked else []
        run.df = run.df.withColumn(name, nearest(F.concat(*parts)))
    run.df = run.df.withColumn("_left", F.reverse("_left"))
