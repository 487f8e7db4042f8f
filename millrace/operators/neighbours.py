"""Nearest-neighbour imputation without comparing every pair of rows.

Rows are laid along a few randomly shifted Z-order curves (the zkNN method: Yao, Li and Kumar 2010;
Zhang, Li and Jestes 2012). On each curve a row with a gap looks only at the ``REACH`` x k donors before it
and as many after it, found by an equi-join on the donors' position, so the work is linear in the rows and
no group grows with the data. Every curve but the first runs through the points in a turned frame, so no
two of them part the same neighbours. With one coordinate the neighbours are exact. With several the share of
the true five nearest that is found was measured on clustered points: 0.99 or more for two and three
coordinates, 0.95 or more for five (a test holds 0.9).
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import as_double, col, cols, is_numeric, quoted, require
from millrace.operators.ordered import Ordered
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.stats import column_stats


CURVES = 5
REACH = 5


def _curve(cells: Sequence[Column], bits: int) -> Column:
    """Interleave the bits of non-negative whole numbers."""
    width = len(cells)
    out = F.lit(0).cast("long")
    for axis, cell in enumerate(cells):
        for bit in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1)), bit * width + axis))
    return out


def _gap_distance(coords: Sequence[str]) -> Column:
    """Euclidean distance over the coordinates both rows have, scaled up for the missing ones."""
    total, both = F.lit(0.0), F.lit(0)
    for i in range(len(coords)):
        a, b = F.col(f"qc{i}"), F.col(f"dc{i}")
        shared = a.isNotNull() & b.isNotNull()
        total = total + F.when(shared, (a - b) * (a - b)).otherwise(0.0)
        both = both + shared.cast("int")
    return F.when(both > 0, F.sqrt(total * len(coords) / both))


def nearest_rows(
    df: DataFrame, target: str, coords: Sequence[str], key: Sequence[str], k: int = 5, curves: int = CURVES, seed: int = 42,
) -> DataFrame:
    """(key…, near) for the rows whose target is missing: the k nearest donors as (dist, dk, dv), nearest first."""
    stats = column_stats(df, coords)
    usable = [c for c in coords if stats[c].known]
    middles = exact_quantiles(df, {c: [0.5] for c in usable})
    spread = max((stats[c].high - stats[c].low for c in usable), default=0.0) or 1.0
    bits = min(20, 60 // max(1, len(usable)))
    top = float(2**bits - 1)
    draw = random.Random(seed)
    reach = REACH * k if len(usable) > 1 else k
    width = len(usable)
    frames = [([0.0] * width, np.eye(width))]
    for _ in range(curves - 1 if width > 1 else 0):
        turn = np.linalg.qr(np.array([[draw.gauss(0, 1) for _ in usable] for _ in usable]))[0]
        frames.append(([draw.random() for _ in usable], turn))

    base = df.select(*cols(key), as_double(df, target).alias("_t"),
                     *[as_double(df, c).alias(f"_c{i}") for i, c in enumerate(usable)])

    def along(shift: Sequence[float], turn: np.ndarray) -> Column:
        unit = [(F.coalesce(F.col(f"_c{i}"), F.lit(middles[c][0])) - stats[c].low) / spread for i, c in enumerate(usable)]
        cells = []
        for i in range(width):
            # a unit cube turned in any way stays within sqrt(width) of its corner at 0
            at = sum((u * float(t) for u, t in zip(unit, turn[i])), F.lit(0.0))
            room = math.sqrt(width) if width > 1 else 0.0
            cells.append(F.floor((at + room + shift[i]) / (2 * room + 1.0 if room else 2.0) * top).cast("long"))
        return _curve(cells, bits)

    zs = F.array(*[F.struct(F.lit(i).alias("_curve"), along(*f).alias("_z")) for i, f in enumerate(frames)])
    spread_out = base.select("*", F.inline(zs)).withColumn("_donor", F.col("_t").isNotNull().cast("long"))
    run = Ordered(spread_out, ["_z", "_donor", *key], ["_curve"])
    run.running_sum("_donor", "_rank")
    donors = run.df.where("_donor = 1").select(
        F.col("_curve"), F.col("_rank"), F.col("_t").alias("dv"),
        F.struct(*cols(key)).alias("dk"), *[F.col(f"_c{i}").alias(f"dc{i}") for i in range(len(usable))])
    asking = run.df.where("_donor = 0").select(
        *cols(key), F.col("_curve"),
        F.explode(F.sequence(F.col("_rank") - (reach - 1), F.col("_rank") + reach)).alias("_rank"),
        *[F.col(f"_c{i}").alias(f"qc{i}") for i in range(len(usable))])
    pairs = asking.join(donors, ["_curve", "_rank"]).withColumn("dist", _gap_distance(usable))
    # at most 2·reach·curves candidates per row
    return pairs.where("dist IS NOT NULL").groupBy(*cols(key)).agg(
        F.slice(F.sort_array(F.collect_set(F.struct("dist", "dk", "dv"))), 1, k).alias("near"))


def nearest_fill(
    df: DataFrame, target: str, coords: Sequence[str], key: Sequence[str],
    k: int = 5, weights: str = "uniform", curves: int = CURVES, seed: int = 42,
) -> DataFrame:
    """(key…, fill) for the rows whose target is missing."""
    ranked = nearest_rows(df, target, coords, key, k, curves, seed)
    if weights == "distance":
        zero = F.exists("near", lambda p: p["dist"] == 0)
        weight = F.transform("near", lambda p: F.when(zero, (p["dist"] == 0).cast("double")).otherwise(1 / p["dist"]))
    else:
        weight = F.transform("near", lambda p: F.lit(1.0))
    weighed = ranked.withColumn("w", weight)
    add = lambda a, x: a + x
    top_sum = F.aggregate(F.zip_with("near", "w", lambda p, w: p["dv"] * w), F.lit(0.0), add)
    return weighed.select(*cols(key), (top_sum / F.aggregate("w", F.lit(0.0), add)).alias("fill"))


def impute_knn(
    df: DataFrame, names: Sequence[str], key: Sequence[str],
    k: int = 5, weights: str = "uniform", curves: int = CURVES, seed: int = 42,
) -> DataFrame:
    """Fill each numeric column from its nearest rows; a row with no usable coordinate takes the mean."""
    if not key:
        raise ValueError("a row key is required to match neighbours to rows")
    require(df, [*names, *key])
    numbers = [n for n in names if is_numeric(df, n)]
    stats = column_stats(df, numbers)
    fills = {}
    for name in numbers:
        if 0 < stats[name].known < stats[name].rows:
            coords = [n for n in numbers if n != name]
            fills[name] = nearest_fill(df, name, coords, key, k, weights, curves, seed) if coords else None
    out = df
    for name, table in fills.items():
        value = as_double(df, name)
        if table is None:
            out = out.withColumn(name, F.coalesce(value, F.lit(stats[name].mean)))
            continue
        named = table.toDF(*[f"_k{i}" for i in range(len(key))], "_fill")
        on = [out[quoted(c)] == named[f"_k{i}"] for i, c in enumerate(key)]
        joined = out.join(named, on, "left")
        filled = F.coalesce(as_double(df, name), F.col("_fill"), F.lit(stats[name].mean))
        out = joined.withColumn(name, filled).select(*cols(df.columns))
    return out
