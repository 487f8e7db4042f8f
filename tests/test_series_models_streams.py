"""Forecasts, model training, streaming and sample data."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import learn, series
from millrace.operators.forecast import forecast_table
from millrace.sources.models import ModelRegistry
from millrace.streaming import jobs


def months(spark, values):
    rows = [(datetime.date(2018 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "period date, value double")


def test_seasonal_series_is_followed(spark):
    t = np.arange(72)
    values = 100 + 2 * t + 20 * np.sin(2 * np.pi * t / 12)
    ahead = np.arange(72, 78)
    truth = 100 + 2 * ahead + 20 * np.sin(2 * np.pi * ahead / 12)
    got = forecast_table(months(spark, values), "M", model="holt_winters").orderBy("step").toPandas()
    assert np.abs(got.point - truth).max() < 6
    assert (got.lower_95 < got.lower_80).all() and (got.upper_80 < got.upper_95).all()
    assert str(got.period.iloc[0]) == "2024-01-01"


@pytest.mark.parametrize("model", ["ses", "ridge_lag", "arima", "holt_winters", None])
def test_models_follow_a_line(spark, model):
    got = forecast_table(months(spark, 50 + 3.0 * np.arange(60)), "M", model=model).orderBy("step").toPandas()
    truth = 50 + 3.0 * np.arange(60, 66)
    assert np.abs(got.point - truth).max() / truth.max() < 0.1


def test_short_series_say_so_and_flat_ones_work(spark):
    short = months(spark, [1, 2, 3])
    told = forecast_table(short, "M").collect()
    assert [(r.best_model, r.step, r.point, r.period) for r in told] == [("too_short", None, None, None)]
    flat = forecast_table(months(spark, [7.0] * 30), "M").toPandas()
    assert np.allclose(flat.point, 7.0, atol=0.5)


@pytest.mark.parametrize("step,letter", [("1D", "D"), ("7D", "W"), ("1h", "H"), ("1min", "T"), ("MS", "M"), ("QS", "Q"), ("YS", "Y"), ("3D", "D")])
def test_frequencies(spark, step, letter):
    stamps = pd.date_range("2020-01-01", periods=20, freq=step)
    df = spark.createDataFrame(pd.DataFrame({"t": stamps}))
    assert series.infer_frequency(df, "t") == letter


def test_short_decomposition_has_no_season(spark):
    out = series.decompose(months(spark, range(10)), "M").toPandas()
    assert (out.seasonal == 0).all() and np.allclose(out.value, out.trend + out.residual)


def make_classes(spark, n=300):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(n), "x": rng.normal(size=n), "y": rng.normal(size=n)})
    pdf["kind"] = np.where(pdf.x > 0, "big", "small")
    pdf["label"] = (pdf.x + 0.3 * rng.normal(size=n) > 0).astype(int)
    pdf.loc[pdf.id % 11 == 0, "y"] = np.nan
    pdf["same"] = 1.0
    return spark.createDataFrame(pdf)


def test_training_scoring_and_attribution(spark, tmp_path):
    df = make_classes(spark)
    trained = learn.train_model(df, "label", ["id"], algorithms=["logistic regression"])
    assert trained.task == "classification" and "same" not in trained.features
    assert trained.metrics["accuracy"] > 0.8 and trained.metrics["roc_auc"] > 0.9
    assert 0 <= trained.metrics["brier"] <= 0.25 and trained.importance[0][0] in ("x", "kind")
    effect = learn.permutation_importance(trained, df, ["id"]).collect()
    assert effect[0]["feature"] in ("x", "kind") and effect[0]["importance"] > 0
    registry = ModelRegistry(spark, str(tmp_path))
    record = registry.register("m", trained)
    scored = registry.score(record["model_id"], df)
    assert set(scored.columns) - set(df.columns) == {"predicted_label", "confidence"}
    right = scored.agg(F.avg((F.col("predicted_label") == F.col("label").cast("string")).cast("int"))).first()[0]
    assert right > 0.8
    assert registry.promote("m-1", "archived")["status"] == "archived"
    with pytest.raises(ValueError):
        registry.promote("m-1", "gold")


def test_regression_beats_the_mean(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(200), "a": rng.normal(size=200), "b": rng.normal(size=200)})
    pdf["target"] = 3 * pdf.a - pdf.b + rng.normal(size=200) * 0.1
    trained = learn.train_model(spark.createDataFrame(pdf), "target", ["id"], algorithms=["ridge"])
    assert trained.task == "regression" and trained.metrics["r2"] > 0.95
    with pytest.raises(ValueError, match="no usable"):
        learn.train_model(spark.createDataFrame(pdf), "target", ["id"], include=[])


def test_preparation_learns_from_training_rows_only(spark):
    train = spark.createDataFrame([(10.0, 1), (20.0, 1), (None, 2), (40.0, 1)], "num double, n int")
    test = spark.createDataFrame([(100.0, 5), (200.0, None), (None, 7)], "num double, n int")
    values = learn.fit_fill(train)
    assert values == {"num": 20.0, "n": 1}
    assert sorted(r["num"] for r in learn.fill_from(test, values).collect()) == [20.0, 100.0, 200.0]
    assert sorted(r["num"] for r in learn.fill_from(train, values).collect()) == [10.0, 20.0, 20.0, 40.0]


def test_imbalance_and_encoding(spark):
    df = spark.createDataFrame([(i, 1 if i < 20 else 0) for i in range(400)], "a long, label int")
    found = learn.detect_imbalance(df, "label")
    assert found["is_imbalanced"] and found["recommended_metric"] == "roc_auc" and found["minority_ratio"] == 0.05
    coded = learn.encode_features(spark.createDataFrame([("b", datetime.date(2024, 1, 1)), ("a", None), (None, None)], "k string, d date"))
    assert coded.columns == ["k"] and sorted((r["k"] for r in coded.collect()), key=str) == [0.0, 1.0, None]


def test_gate_stops_a_stream(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "v").write.parquet(str(tmp_path / "in"))
    stream = jobs.parquet_stream(spark, str(tmp_path / "in"))
    checks = [{"type": "range", "column": "v", "max": 5}]
    places = [str(tmp_path / n) for n in ("out", "verdicts", "mark")]
    with pytest.raises(Exception, match="GateFailed|outside"):
        jobs.quality_stream(stream, checks, *places)
    assert spark.read.parquet(places[1]).first()["failing"] == 4
    assert not (tmp_path / "out").exists()


def test_restarted_stream_reads_only_new_files(spark, tmp_path):
    folder, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for start in (0, 1):
        spark.range(start * 10, start * 10 + 10).write.mode("append").parquet(folder)
        jobs.ingest(jobs.watch_files(spark, folder, "id long", "parquet"), [], sink, mark)
    assert sorted(r["id"] for r in jobs.read_batches(spark, sink).collect()) == list(range(20))


def test_append_trend_waits_for_the_watermark(spark, tmp_path, table):
    sink, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    jobs.daily_trend(jobs.parquet_stream(spark, "/root/testdata/sf0.001/events.parquet"), "ts", "value", sink, mark, mode="append")
    closed = jobs.read_batches(spark, sink).count()
    days = table("events").select(F.col("ts").cast("date")).distinct().count()
    assert 0 < closed < days


def test_a_failing_batch_stops_the_stream_after_the_good_ones(spark, tmp_path):
    folder, sink, verdicts, mark = (str(tmp_path / n) for n in ("in", "out", "verdicts", "mark"))
    checks = [{"type": "not_null", "column": "v"}, {"type": "unique", "column": "id"}, {"type": "row_count", "min_rows": 5}]
    for i, bad in enumerate((False, False, True, False)):
        rows = [(10 * i + k, None if bad and k < 3 else 1.0) for k in range(10)]
        spark.createDataFrame(rows, "id long, v double").coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.watch_files(spark, folder, "id long, v double", "parquet", per_batch=1)
    with pytest.raises(Exception, match="batch 2"):
        jobs.quality_stream(stream, checks, sink, verdicts, mark)
    assert sorted(r.id for r in jobs.read_batches(spark, sink).collect()) == list(range(20))
    found = spark.read.parquet(verdicts).where("batch = 2").collect()
    assert {(r.type, r.passed, r.failing) for r in found} == {("not_null", False, 3), ("unique", True, 0), ("row_count", True, 0)}
