"""The paths for groups larger than a task give the same rows as the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import charts, hypothesis, ordered, quantiles, series
from millrace.operators.quantiles import exact_quantiles, grouped_quantiles
from millrace.session import TASK_ROWS_KEY


@pytest.fixture
def skewed(spark):
    """900 rows, a third of them under one key and a third of the values equal."""
    rng = np.random.default_rng(5)
    n = 900
    values = np.where(np.arange(n) % 3 == 0, 7.0, np.exp(rng.normal(size=n) * 3))
    frame = pd.DataFrame({
        "id": np.arange(n), "key": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 30, n).astype(str)),
        "t": rng.permutation(n), "v": values, "gap": np.where(rng.random(n) < 0.5, np.nan, values)})
    return frame


def frame_of(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("gap", F.when(~F.isnan("gap"), F.col("gap"))).repartition(5)


@pytest.fixture(params=["sketch", "slices"])
def quantile_path(request, monkeypatch):
    """The sketch path, or the counting passes for data too large for a bracket."""
    monkeypatch.setattr(quantiles, "SKETCH", 25)
    monkeypatch.setattr(quantiles, "PLAIN_ROWS", 60)
    monkeypatch.setattr(quantiles, "BRACKET_SHARE", 1 if request.param == "sketch" else 10**9)


def test_global_quantiles(spark, skewed, small_tasks, quantile_path):
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    found = exact_quantiles(frame_of(spark, skewed), {"v": probs, "id": probs, "gap": [0.5]})
    assert np.allclose(found["v"], np.quantile(skewed.v, probs))
    assert np.allclose(found["id"], np.quantile(skewed.id, probs))
    assert np.allclose(found["gap"], [skewed.gap.median()])


def test_quantiles_of_wide_and_constant_values(spark, small_tasks, quantile_path):
    wide = [float(v) for v in [-1e300, -1.0, 0.0, 1e-300, 2e-300, 1.0, 1e300] * 20]
    df = spark.createDataFrame([(v, 3.0) for v in wide], "a double, b double")
    found = exact_quantiles(df, {"a": [0.5, 0.9], "b": [0.1]})
    assert found["a"] == [float(np.quantile(wide, 0.5)), float(np.quantile(wide, 0.9))] and found["b"] == [3.0]


def test_sketch_on_many_distinct_and_tied_values(spark):
    values = np.concatenate([np.random.default_rng(1).normal(size=150_000), np.full(90_000, 0.5)])
    df = spark.createDataFrame(pd.DataFrame({"v": values, "k": np.arange(240_000) % 3 == 0})).repartition(6)
    probs = [0.0, 0.001, 0.25, 0.5, 0.6, 0.999, 1.0]
    assert np.allclose(exact_quantiles(df, {"v": probs})["v"], np.quantile(values, probs), rtol=0, atol=0)
    got = grouped_quantiles(df, ["k"], F.col("v"), [0.5, 0.9], ["a", "b"]).toPandas().set_index("k")
    want = pd.DataFrame({"v": values, "k": np.arange(240_000) % 3 == 0}).groupby("k").v.quantile([0.5, 0.9]).unstack()
    assert np.allclose(got.sort_index()[["a", "b"]], want.sort_index())


def test_slicing_passes(spark, monkeypatch):
    """More rows than one finishing pass may hold forces several counting passes."""
    monkeypatch.setattr(quantiles, "SLICES", 4)
    monkeypatch.setattr(quantiles, "BRACKET_SHARE", 10**9)
    spark.conf.set(TASK_ROWS_KEY, "40")
    try:
        values = np.random.default_rng(1).lognormal(size=2000)
        df = spark.createDataFrame(pd.DataFrame({"v": values}))
        assert np.allclose(exact_quantiles(df, {"v": [0.1, 0.5, 0.95]})["v"], np.quantile(values, [0.1, 0.5, 0.95]))
    finally:
        spark.conf.unset(TASK_ROWS_KEY)


def test_grouped_quantiles_with_a_hot_key(spark, skewed, small_tasks, quantile_path):
    got = grouped_quantiles(frame_of(spark, skewed), ["key"], F.col("v"), [0.25, 0.5], ["q1", "q2"]).toPandas()
    want = skewed.groupby("key").v.quantile([0.25, 0.5]).unstack()
    got = got.set_index("key").sort_index()
    assert np.allclose(got.q1, want[0.25].sort_index()) and np.allclose(got.q2, want[0.5].sort_index())


@pytest.mark.parametrize("partition", [[], ["key"]])
def test_fills_across_blocks(spark, skewed, small_tasks, partition):
    df = frame_of(spark, skewed)
    ordered_pdf = skewed.sort_values("t")
    group = ordered_pdf.groupby("key").gap if partition else ordered_pdf.gap
    for forward, limit in ((True, None), (False, None), (True, 2), (False, 1)):
        got = ordered.fill(df, ["gap"], ["t"], partition, forward, limit).toPandas().set_index("id").gap.sort_index()
        want = (group.ffill(limit=limit) if forward else group.bfill(limit=limit))
        want.index = ordered_pdf.id
        assert np.allclose(got, want.sort_index(), equal_nan=True), (forward, limit)


def test_interpolation_across_blocks(spark, skewed, small_tasks):
    got = ordered.interpolate(frame_of(spark, skewed), ["gap"], ["t"]).toPandas().set_index("id").gap.sort_index()
    pdf = skewed.sort_values("t")
    want = pdf.gap.interpolate(method="linear", limit_direction="both")
    want.index = pdf.id
    assert np.allclose(got, want.sort_index())


def test_numbers_and_totals_across_blocks(spark, skewed, small_tasks):
    df = frame_of(spark, skewed)
    got = ordered.number_rows(df, ["t"], ["key"]).toPandas().set_index("id").row_no.sort_index()
    want = skewed.sort_values("t").groupby("key").cumcount() + 1
    assert (got.values == want.sort_index().values).all()
    total = ordered.running_total(df, "v", ["t"]).toPandas().set_index("id").total.sort_index()
    cumulative = skewed.sort_values("t").v.cumsum()
    assert np.allclose(total.values, cumulative.sort_index().values)


def test_q_values_across_blocks(spark, small_tasks):
    p = np.random.default_rng(3).random(300).round(2)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "p": p}))
    got = hypothesis.adjust_p_table(df, "p").toPandas().set_index("id").q_value.sort_index()
    want = hypothesis.adjust_p_values(list(p))
    assert np.allclose(np.sort(got), np.sort(want))


def test_rank_test_across_blocks(spark, skewed, small_tasks):
    pdf = skewed[skewed.key.isin(["hot", "1"])]
    df = spark.createDataFrame(pdf[["key", "v"]])
    found = hypothesis.mann_whitney(df, "v", "key", groups=["hot", "1"])
    ranks = pdf.v.rank()
    n1 = (pdf.key == "hot").sum()
    assert found["statistic"] == ranks[pdf.key == "hot"].sum() - n1 * (n1 + 1) / 2


def test_gaps_across_blocks(spark, small_tasks):
    days = pd.date_range("2024-01-01", periods=200, freq="D")
    df = spark.createDataFrame(pd.DataFrame({"d": days}))
    assert series.infer_frequency(df, "d") == "D"


def test_order_is_required(spark, skewed):
    with pytest.raises(ValueError, match="order"):
        ordered.fill(frame_of(spark, skewed), ["gap"], [])


def test_histogram_covers_every_row(spark, skewed):
    bins = charts.histogram(frame_of(spark, skewed), "v", 12).toPandas()
    counts, edges = np.histogram(skewed.v, bins=12)
    assert list(bins.sort_values("bin").n) == list(counts)
    assert np.allclose(bins.sort_values("bin").bin_low, edges[:-1])


def test_no_cartesian_or_single_task_sort_in_grouped_paths(spark, skewed):
    plan = ordered.fill(frame_of(spark, skewed), ["gap"], ["t"], ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
