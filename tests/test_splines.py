"""Natural cubic splines against a dense solve."""

import numpy as np
import pytest

from millrace.operators import splines
from millrace.session import TASK_ROWS_KEY


def dense(values):
    """Values with inner gaps on the natural spline and outer ones at the nearest known value."""
    at = np.arange(1, len(values) + 1, dtype=float)
    x, y = at[~np.isnan(values)], values[~np.isnan(values)]
    n = len(x)
    if n == 0:
        return values
    if n == 1:
        return np.full(len(values), y[0])
    h, matrix, right = np.diff(x), np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        matrix[i, i - 1: i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    bend = np.linalg.solve(matrix, right)
    out = values.copy()
    for k in np.flatnonzero(np.isnan(values)):
        if at[k] < x[0] or at[k] > x[-1]:
            out[k] = y[0] if at[k] < x[0] else y[-1]
            continue
        i = np.searchsorted(x, at[k]) - 1
        s, t = (x[i + 1] - at[k]) / h[i], (at[k] - x[i]) / h[i]
        out[k] = s * y[i] + t * y[i + 1] + ((s**3 - s) * bend[i] + (t**3 - t) * bend[i + 1]) * h[i] ** 2 / 6
    return out


def series(seed, size, share):
    pick = np.random.default_rng(seed)
    values = np.cumsum(pick.normal(size=size)) * 10
    values[pick.random(size) < share] = np.nan
    return values


def filled(spark, values, groups=None):
    rows = [(i, None if np.isnan(v) else float(v), groups[i] if groups else "a", "kept") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "t long, v double, g string, `other col` string").repartition(3)
    out = splines.interpolate_spline(df, ["v"], ["t"], ["g"] if groups else [])
    assert out.columns == df.columns
    got = out.orderBy("t").collect()
    assert {r["other col"] for r in got} <= {"kept"}
    return np.array([np.nan if r.v is None else r.v for r in got])


@pytest.mark.parametrize("share", [0.2, 0.9])
@pytest.mark.parametrize("limit", [7, 1_000_000])
def test_against_a_dense_solve(spark, share, limit):
    values = series(1, 300, share)
    values[40:75] = np.nan  # some blocks hold no known point
    spark.conf.set(TASK_ROWS_KEY, str(limit))
    try:
        got = filled(spark, values)
    finally:
        spark.conf.unset(TASK_ROWS_KEY)
    assert np.abs(got - dense(values)).max() < 1e-9


@pytest.mark.parametrize("limit", [9, 1_000_000])
def test_many_series(spark, limit):
    parts = {"x": series(2, 60, 0.5), "y": series(3, 35, 0.7), None: series(4, 20, 0.4), "one": np.array([np.nan, 5.0, np.nan]),
             "none": np.array([np.nan, np.nan]), "two": np.array([1.0, np.nan, np.nan, 4.0])}
    values, groups = np.concatenate(list(parts.values())), [g for g, v in parts.items() for _ in v]
    spark.conf.set(TASK_ROWS_KEY, str(limit))
    try:
        got = filled(spark, values, groups)
    finally:
        spark.conf.unset(TASK_ROWS_KEY)
    want = np.concatenate([dense(v) for v in parts.values()])
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)
    assert np.allclose(got[-4:], [1, 2, 3, 4])


def test_tridiagonal_systems():
    pick = np.random.default_rng(9)
    for n in (1, 2, 3, 64, 257):
        a, c, d = pick.normal(size=n), pick.normal(size=n), pick.normal(size=(n, 3))
        b = np.abs(a) + np.abs(c) + 0.1
        matrix = np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1)
        assert np.allclose(splines.solve_tridiagonal(a, b, c, d), np.linalg.solve(matrix, d), atol=1e-9)


def test_empty_and_text_columns(spark):
    empty = spark.createDataFrame([], "t long, v double")
    assert splines.interpolate_spline(empty, ["v"], ["t"]).count() == 0
    with pytest.raises(ValueError, match="numeric"):
        splines.interpolate_spline(spark.createDataFrame([(1, "a")], "t long, v string"), ["v"], ["t"])
