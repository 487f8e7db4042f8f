"""Isolation forest: small trees grown from a bounded sample, all rows scored in Spark tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.columns import as_double, is_numeric
from millrace.operators.outliers import treat_flagged
from millrace.operators.quantiles import exact_quantiles
from millrace.session import session_of

SAMPLE = 256
EULER = 0.5772156649015329


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows of (axis, cut, left, right, depth); axis −1 marks a leaf with its expected depth."""
    limit = math.ceil(math.log2(max(2, len(points))))
    nodes: list[list[float]] = []
    todo = [(points, 0, -1, 0)]
    while todo:
        part, depth, parent, side = todo.pop()
        index = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = index
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
        axes = np.flatnonzero(high > low) if len(part) > 1 and depth < limit else []
        if len(axes) == 0:
            nodes.append([-1, 0.0, index, index, depth + _average_path(len(part))])
            continue
        axis = int(rng.choice(axes))
        cut = float(rng.uniform(low[axis], high[axis]))
        nodes.append([axis, cut, -1, -1, depth])
        left = part[:, axis] < cut
        todo += [(part[~left], depth + 1, index, 1), (part[left], depth + 1, index, 0)]
    return np.array(nodes)


def _path_lengths(tree: np.ndarray, points: np.ndarray) -> np.ndarray:
    at = np.zeros(len(points), dtype=np.int64)
    rows = np.arange(len(points))
    while True:
        axis = tree[at, 0].astype(np.int64)
        inner = axis >= 0
        if not inner.any():
            return tree[at, 4]
        below = points[rows, np.maximum(axis, 0)] < tree[at, 1]
        at = np.where(inner, np.where(below, tree[at, 2], tree[at, 3]).astype(np.int64), at)


def isolation_scores(
    df: DataFrame, names: Sequence[str], trees: int = 100, seed: int = 42, name: str = "iso_score"
) -> DataFrame:
    """Append an anomaly score in (0, 1]; missing values count as the column's median."""
    names = [n for n in names if is_numeric(df, n)]
    middles = exact_quantiles(df, {n: [0.5] for n in names})
    filled = [F.coalesce(as_double(df, n), F.lit(middles[n][0] or 0.0)).alias(f"x{i}") for i, n in enumerate(names)]
    view = df.select(*filled)
    # the smallest hashes of the values are the same sample on every run, whatever the partitions
    picked = (
        view.withColumn("_draw", F.xxhash64(*view.columns, F.lit(seed)))
        .groupBy(*view.columns, "_draw").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("_draw").limit(trees * SAMPLE).collect()
    )
    rng = np.random.default_rng(seed)
    pool = np.array([[r[f"x{i}"] for i in range(len(names))] for r in picked])
    share = np.array([r["n"] for r in picked], dtype=float)
    share /= share.sum()
    size = min(SAMPLE, int(sum(r["n"] for r in picked)))
    forest = [_grow(pool[rng.choice(len(pool), size=size, p=share)], rng) for _ in range(trees)]
    norm = _average_path(size) or 1.0
    shipped = session_of(df).sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            points = part.to_numpy(dtype=float)
            depth = sum(_path_lengths(tree, points) for tree in shipped.value) / len(shipped.value)
            yield pd.Series(np.power(2.0, -depth / norm))

    return df.withColumn(name, score(F.struct(*filled)))


def treat_isolated(
    df: DataFrame,
    names: Sequence[str],
    contamination: float = 0.05,
    trees: int = 100,
    action: str = "clip",
    seed: int = 42,
) -> DataFrame:
    """Treat the share of rows with the highest scores."""
    names = [n for n in names if is_numeric(df, n)]
    scored = isolation_scores(df, names, trees, seed, "_iso")
    cut = exact_quantiles(scored, {"_iso": [1.0 - contamination]})["_iso"][0]
    return treat_flagged(scored, names, F.col("_iso") > F.lit(cut), action).drop("_iso")
