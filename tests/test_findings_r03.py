"""Queries on tables where they once failed or stopped short."""

import datetime
import re

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from millrace.catalog import QUERIES, models, registry
from millrace.operators import learn, splines
from millrace.operators.curves import interpolate_curve
from millrace.operators.shape import split_train_test
from millrace.session import TASK_ROWS_KEY
from millrace.sources import files
from millrace.streaming import jobs

from .conftest import DATA
from .test_splines import dense, filled, series


def _orders(spark, folder, totals):
    rows = [(i, 1, "O", float(v), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), "1-URGENT") for i, v in enumerate(totals)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return folder


def test_a_trend_too_small_to_show_is_still_reported(spark, tmp_path):
    cases = {"even": ([100.0] * 6, 0.0), "slow": ([1000.0, 1001, 1002, 1003, 1004], 0.001), "short": ([100.0, 110], 0.1), "one": ([5.0], None)}
    for name, (totals, want) in cases.items():
        got = QUERIES["ins_trend"](spark, _orders(spark, str(tmp_path / name), totals)).collect()
        assert [tuple(r) for r in got] == [("trend", want)], name


def _events(spark, folder, rows):
    moments = [(i, datetime.datetime.fromisoformat(ts), v) for i, (ts, v) in enumerate(rows)]
    frame = spark.createDataFrame(moments, "event_id long, ts timestamp_ntz, value double")
    frame.coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_a_daily_trend_holds_the_days_still_open(spark, tmp_path):
    _events(spark, str(tmp_path / "events.parquet"),
            [("2024-01-01 05:00:00", 1.0), ("2024-01-01 23:00:00", 2.0), ("2024-01-04 00:00:00", 4.0), ("2024-01-04 01:00:00", 8.0)])
    got = QUERIES["st_daily_trend"](spark, str(tmp_path)).orderBy("day").collect()
    assert [(r.day.day, r.value, r.n) for r in got] == [(1, 3.0, 2), (4, 12.0, 2)]


def test_a_day_that_grows_is_read_as_last_stored(spark, tmp_path):
    folder, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for rows in ([("2024-01-01 05:00:00", 1.0)], [("2024-01-01 06:00:00", 2.0), ("2024-01-02 01:00:00", 4.0)],
                 [("2024-01-02 06:00:00", 8.0)]):
        _events(spark, folder, rows)
        jobs.daily_trend(jobs.parquet_stream(spark, folder), "ts", "value", sink, mark, mode="update")
    got = jobs.latest_days(spark, sink).orderBy("day").collect()
    assert [(r.day.day, r.value, r.n) for r in got] == [(1, 3.0, 2), (2, 12.0, 2)]


def test_many_short_series_are_one_system():
    parts = [series(i, 1 + i % 9, 0.5) for i in range(400)] + [series(7, 150, 0.6)]
    at = np.concatenate([np.arange(1, len(p) + 1) for p in parts]).astype(float)
    got = splines.fill_many(np.repeat(np.arange(len(parts)), [len(p) for p in parts]), at, np.concatenate(parts))
    assert np.allclose(got, np.concatenate([dense(p) for p in parts]), atol=1e-9, equal_nan=True)


def test_series_that_span_several_batches(spark):
    parts = {str(i): series(i, 1 + i * 5 % 23, 0.5) for i in range(40)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = filled(spark, np.concatenate(list(parts.values())), [g for g, v in parts.items() for _ in v])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(got, np.concatenate([dense(v) for v in parts.values()]), atol=1e-9, equal_nan=True)


class _Stop(Exception):
    pass


@pytest.mark.parametrize("name", ["ml_batch_score", "ml_search", "ml_register", "ml_attribution"])
def test_training_does_not_read_the_texts_again(spark, monkeypatch, name):
    seen = {}

    def train(data, *rest, **options):
        seen["files"] = data.inputFiles()
        raise _Stop

    monkeypatch.setattr("millrace.operators.learn.train_model", train)
    with pytest.raises(_Stop):
        QUERIES[name](spark, DATA)
    assert not seen["files"]


def test_training_ranks_the_rows_once(spark, monkeypatch):
    data = spark.range(200).selectExpr("id", "cast(id % 7 as double) AS x", "cast(id % 3 = 0 as int) AS y")
    kept = []

    def imbalance(train, label):
        kept.append(train._jdf.queryExecution().optimizedPlan().toString())
        raise _Stop

    monkeypatch.setattr(learn, "detect_imbalance", imbalance)
    with pytest.raises(_Stop):
        learn.train_model(data, "y", ["id"])
    assert "Window" not in kept[0] and "Join" not in kept[0]


def test_landed_pages_do_not_take_a_folder_each(spark, tmp_path, monkeypatch):
    spark.range(6000).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name").write.parquet(str(tmp_path / "part.parquet"))
    seen, read = [], files.read_pages

    def counted(session, folder, *rest):
        landed = read(session, folder, *rest)
        seen.append(len(session.read.json(folder).inputFiles()))
        return landed

    monkeypatch.setattr(files, "read_pages", counted)
    assert QUERIES["src_paged"](spark, str(tmp_path)).count() == 6000
    assert seen[0] < 20  # 40 pages


@pytest.mark.parametrize("folders", [True, False])
@pytest.mark.parametrize("sizes, want", [([3, 3, 2, 3], 8), ([3, 3, 0, 3], 6), ([3, 3], 6), ([1, 3], 1)])
def test_pages_end_at_the_first_short_one(spark, tmp_path, folders, sizes, want):
    rows = spark.createDataFrame([(i, k) for i, n in enumerate(sizes) for k in range(n)], "page long, k long")
    (rows.write.partitionBy("page") if folders else rows.write).json(str(tmp_path / "in"))
    assert files.read_pages(spark, str(tmp_path / "in"), 3).count() == want


def test_pages_are_counted_once(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(files, "materialize", lambda df: counted.append(df) or df)
    files.concat_pages(spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "page long, k long"), "page", 2)
    assert len(counted) == 1


def _local_curve(values, degree):
    """Plain computation: the degree + 1 nearest of the known points beside a gap."""
    known, each, out = np.flatnonzero(~np.isnan(values)), -(-(degree + 1) // 2), values.copy()
    for k in np.flatnonzero(np.isnan(values)):
        left, right = known[known < k][-each:], known[known > k][:each]
        if len(left) and len(right):
            x = sorted([*left, *right], key=lambda p: (abs(p - k), p))[:degree + 1]
            out[k] = sum(values[p] * np.prod([(k - q) / (p - q) for q in x if q != p]) for p in x)
        elif len(known):
            out[k] = values[right[0] if len(right) else left[-1]]
    return out


@pytest.mark.parametrize("limit", [7, 1_000_000])
@pytest.mark.parametrize("degree, grouped", [(2, False), (1, True), (5, True)])
def test_local_curves_without_a_join(spark, limit, degree, grouped):
    parts = {"x": series(2, 60, 0.5), "y": series(3, 35, 0.8), None: series(4, 20, 0.4), "none": np.full(2, np.nan), "one": np.array([np.nan, 5.0, np.nan])}
    parts["x"][20:40] = np.nan  # some blocks hold no known point
    values = np.concatenate(list(parts.values()))
    groups = [g for g, v in parts.items() for _ in v]
    rows = [(i, None if np.isnan(v) else float(v), g) for i, (v, g) in enumerate(zip(values, groups))]
    df = spark.createDataFrame(rows, "t long, v double, g string").repartition(3)
    spark.conf.set(TASK_ROWS_KEY, str(limit))
    try:
        out = interpolate_curve(df, ["v"], ["t"], ["g"] if grouped else [], degree)
        got = np.array([np.nan if r.v is None else r.v for r in out.orderBy("t").collect()])
    finally:
        spark.conf.unset(TASK_ROWS_KEY)
    want = np.concatenate([_local_curve(v, degree) for v in parts.values()]) if grouped else _local_curve(values, degree)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9, equal_nan=True)
    if limit > 7:
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def _labelled(spark, folder, texts, unlabelled=()):
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate([*texts, *unlabelled])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    marks = [(i, i % 2, 0) for i in range(len(texts))]
    spark.createDataFrame(marks, "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    return registry.Tables(spark, str(folder))


def test_text_features_are_those_of_single_characters(spark, tmp_path):
    texts = ["a b. c!", "  12,3  ", "äö ü_9\n\n-", "...", "x", "7", " ", "\U0001f600 a b", "", None]
    got = {r["doc_id"]: r for r in models._quality(_labelled(spark, tmp_path, texts, [""])).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts[:-1]):
        row = got[i]
        assert row["n_words"] == len(re.split(r"\s+", text, flags=re.ASCII)) and row["n_sentences"] == len(re.split("[.!?]", text)), text
        shares = [len(re.findall(p, text, re.ASCII)) / len(text) if text else None for p in (r"[0-9]", r"[^\w\s]")]
        assert [row["digit_share"], row["mark_share"]] == shares, text
    assert got[9]["digit_share"] is None and got[9]["mark_share"] is None


def test_texts_do_not_move_in_the_join_with_labels(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(models, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()))
    models._quality(_labelled(spark, tmp_path, ["a b", "c"]))
    above, below = plans[0].split("Join ", 1)
    assert "text" not in above and "split(text" in below


def _parts(df):
    return df.groupBy(F.spark_partition_id()).count().count()


@pytest.mark.parametrize("levels", [2, 3])
def test_training_rows_are_spread_over_parts(spark, monkeypatch, levels):
    data = spark.range(400).selectExpr("id", "cast(id % 7 as double) AS x", f"cast(id % {levels} as int) AS y")
    kept = []

    def imbalance(train, label):
        kept.append((_parts(train), sorted(r["id"] for r in train.select("id").collect())))
        raise _Stop

    monkeypatch.setattr(learn, "PART_ROWS", 40, raising=False)
    monkeypatch.setattr(learn, "detect_imbalance", imbalance)
    with pytest.raises(_Stop):
        learn.train_model(data, "y", ["id"])
    parts, ids = kept[0]
    assert parts >= 8
    split = split_train_test(data, ["id"], "y").where(~F.col("is_test"))
    assert ids == sorted(r["id"] for r in split.collect())


def test_shuffled_rows_are_scored_in_many_parts(spark, monkeypatch):
    data = spark.range(400).selectExpr("id", "cast(id % 7 as double) AS x", "cast(id % 5 as double) AS z", "cast(id % 7 > 3 as int) AS y")
    seen = []

    class Model:
        def transform(self, df):
            seen.append((_parts(df), df.groupBy("_which").count().orderBy("_which").collect()))
            return df.withColumn("prediction", (F.col("x") > 3).cast("double"))

    monkeypatch.setattr(learn, "PART_ROWS", 40, raising=False)
    trained = learn.Trained(Model(), "classification", "y", ["x", "z"], ["0", "1"], [], {}, [])
    got = {r["feature"]: r["importance"] for r in learn.permutation_importance(trained, data, ["id"]).collect()}
    parts, rows = seen[0]
    assert parts >= 8 and [tuple(r) for r in rows] == [(-1, 400), (0, 400), (1, 400)]
    assert got["x"] > 0.3 and got["z"] == 0


def test_held_rows_are_scored_once(spark, monkeypatch):
    counted, parts, classify = spark.sparkContext.accumulator(0), [], learn.classification_metrics
    monkeypatch.setattr(learn, "classification_metrics", lambda df, *rest: parts.append(_parts(df)) or classify(df, *rest))
    monkeypatch.setattr(learn, "PART_ROWS", 100)

    def score(x):
        counted.add(1)
        return Vectors.dense([1 - x, x])

    data = spark.range(200).selectExpr("id", "cast(id % 7 > 3 as double) AS _label", "pmod(id * 37, 101) / 101D AS x")
    scored = data.repartition(20, "id").select(learn.LABEL, (F.col("x") > 0.5).cast("double").alias("prediction"), F.udf(score, VectorUDT())("x").alias("probability"))
    got = learn.evaluate(scored, "classification", 2)
    assert counted.value == 200 and parts == [2]
    plain = data.withColumn("prediction", (F.col("x") > 0.5).cast("double"))
    want = classify(plain, learn.LABEL, "prediction") | learn.binary_metrics(plain, learn.LABEL, F.col("x"))
    assert got == {k: round(v, 4) for k, v in want.items()}
