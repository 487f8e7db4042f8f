"""Small cases with results worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.columns import distinct_names, resolve_column, snake
from millrace.operators import aggregates, charts, features, filters, impute, joins, outliers, shape
from millrace.operators.joins import JoinSpec, run_join
from millrace.operators.insights import insight_report, insight_table, run_insights
from millrace.operators.profile import detect_schema, table_profile
from millrace.operators.root_cause import root_cause
from millrace.operators.series import resample
from millrace.plans.cleaning import clean_auto, clean_rules, rule_diff
from millrace.plans.transform import StepError, describe_steps, run_steps


@pytest.fixture
def golden(spark):
    rows = [(f"O{i}", r, c, p, u) for i, (r, c, p, u) in enumerate([
        ("North", "Tech", 100.0, 5), ("South", "Home", 50.0, 2), ("North", "Tech", None, 4), ("East", "Home", 20.0, 1),
        ("South", "Tech", 75.0, 3), ("West", "Home", 60.0, 10)])]
    return spark.createDataFrame(
        rows, "`Order ID` string, `Customer Region` string, `Product Category` string, `Unit Price` double, `Units Sold` long")


@pytest.fixture
def gaps(spark):
    return spark.createDataFrame(
        [(1, "A", 10.0), (2, "B", None), (3, None, 30.0), (4, "A", None), (5, None, 50.0)], "id long, category string, score double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_golden_transform(golden):
    kept = run_steps(golden, [{"op": "filter", "rules": [{"col": "Customer Region", "op": "in", "val": ["North", "South"]}]}])
    assert kept.count() == 4
    made = run_steps(golden, [{"op": "create", "name": "w", "formula": "Units_Sold * 10"}])
    assert [r["w"] for r in made.orderBy("Order ID").collect()] == [50, 20, 40, 10, 30, 100]
    assert describe_steps([{"op": "create", "name": "w", "formula": "v * 2"}, {"op": "drop_cols", "cols": ["v"]}]) == "add w = v * 2; leave out v"


def test_golden_cleaning(golden):
    out, stats = clean_auto(golden)
    assert out.df.columns == ["order_id", "customer_region", "product_category", "unit_price", "units_sold"]
    assert out.df.where("unit_price IS NULL").count() == 0
    assert stats["original_rows"] == stats["cleaned_rows"] == 6 and stats["imputed_columns_count"] == 1


def test_unknown_step_changes_nothing(golden):
    with pytest.raises(StepError):
        run_steps(golden, [{"op": "cast"}])


def test_three_valued_procedure_filters(gaps):
    assert ids(gaps.where(filters.sql_predicate(gaps, "category", "=", "A"))) == [1, 4]
    assert ids(gaps.where(filters.sql_predicate(gaps, "category", "!=", "A"))) == [2]
    assert ids(gaps.where(filters.sql_predicate(gaps, "category", "IS NULL", None))) == [3, 5]
    row = gaps.agg(F.count("*"), F.count("score"), F.sum("score"), F.avg("score")).first()
    assert tuple(row) == (5, 3, 90.0, 30.0)


def test_two_valued_transform_filters(gaps):
    assert ids(filters.filter_rules(gaps, [{"col": "category", "op": "!=", "val": "A"}])) == [2, 3, 5]
    assert ids(filters.filter_rules(gaps, [{"col": "category", "op": "not_in", "val": "A,B"}])) == [3, 5]
    first_or = [{"col": "score", "op": ">", "val": 100, "logic": "OR"}]
    assert filters.filter_rules(gaps, first_or).count() == 5
    assert ids(filters.filter_rules(gaps, [{"col": "score", "op": "<", "val": "30"},
                                           {"col": "category", "op": "is_null", "logic": "OR"}])) == [1, 3, 5]


def test_null_keys_do_not_join(spark):
    left = spark.createDataFrame([(1, "K1"), (2, None), (3, "K2")], "left_id long, key string")
    right = spark.createDataFrame([(1, "K1"), (2, None), (3, "K3")], "right_id long, key string")
    assert joins.join_two(left, right, "key", "key").count() == 1
    assert joins.join_two(left, right, "key", "key", "FULL").count() == 5
    assert joins.join_two(left, right, "key", "key", "ANTI").columns == ["left_id", "key"]


def test_three_way_join_with_colliding_names(spark):
    a = spark.createDataFrame([(1, "x")], "id long, name string")
    b = spark.createDataFrame([(1, "y", 5)], "id long, name string, qty long")
    c = spark.createDataFrame([(5, "z")], "qty long, note string")
    spec = joins.JoinSpec("a", [
        {"table": "b", "join_type": "inner", "conditions": [{"left_col": "id", "right_col": "id"}]},
        {"table": "c", "join_type": "left", "conditions": [{"left_table": "b", "left_col": "qty", "right_col": "qty"}]}])
    out = joins.run_join({"a": a, "b": b, "c": c}, spec)
    assert out.columns == ["a_id", "a_name", "b_id", "b_name", "b_qty", "c_qty", "note"]
    assert tuple(out.first()) == (1, "x", 1, "y", 5, 5, "z")
    with pytest.raises(ValueError):
        joins.run_join({"a": a}, joins.JoinSpec("nope"))


def test_a_join_without_condition_must_say_cross(spark):
    tables = {"a": spark.range(3), "b": spark.range(2)}
    with pytest.raises(ValueError, match="CROSS"):
        run_join(tables, JoinSpec("a", [{"table": "b", "join_type": "inner", "conditions": []}]))
    assert run_join(tables, JoinSpec("a", [{"table": "b", "join_type": "cross"}])).count() == 6


def test_group_options(spark):
    df = spark.createDataFrame([(None, 1, None), ("a", 2, None), ("a", 5, None)], "k string, v long, w double")
    out = aggregates.group_aggregate(df, ["k"], {"v": "median", "w": "sum"})
    assert [tuple(r) for r in out.collect()] == [("a", 3.5, 0.0)]
    assert aggregates.group_aggregate(df, ["k"], {"v": "sum"}, drop_null_keys=False).count() == 2
    with pytest.raises(ValueError, match="order"):
        aggregates.group_aggregate(df, ["k"], {"v": "first"})
    firsts = aggregates.group_aggregate(df, ["k"], {"v": "first"}, order=["v"])
    assert firsts.first()["v"] == 2


def test_names(spark):
    assert [snake(n) for n in ("Order ID", "customerName", "HTMLPage", "a--b (c)", "__x__")] == [
        "order_id", "customer_name", "html_page", "a_b_c", "x"]
    assert distinct_names(["a", "A", "a"]) == ["a", "A_2", "a_3"]
    assert resolve_column(" REGION ", ["Region", "x"]) == "Region"
    odd = spark.createDataFrame([(1, 2)], "`a.b` long, `A B` long")
    assert shape.clean_names(odd).columns == ["a_b", "a_b_2"]
    assert shape.sort_rows(odd, "a.b").count() == 1


def test_sort_puts_gaps_last_both_ways(gaps):
    for ascending in (True, False):
        assert [r["score"] for r in shape.sort_rows(gaps, "score", ascending).collect()][3:] == [None, None]
    texts = gaps.sparkSession.createDataFrame([("10",), ("9",), ("",), (None,), ("b",), ("1e1",)], "s string")
    assert [r["s"] for r in shape.sort_natural(texts, "s").collect()][:4] == ["9", "10", "1e1", "b"]


def test_imputation_choices(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, None), (2, None, 2.0, None), (3, "a", None, None), (4, "b", 3.0, None), (5, "b", 200.0, 1.0)],
        "id long, t string, skewed double, empty double")
    out = impute.impute_auto(df, flag=True)
    assert "empty" not in out.df.columns
    by_id = {r["id"]: r for r in out.df.collect()}
    assert by_id[2]["t"] == "a" and by_id[2]["t_imputed"] and by_id[3]["skewed"] == 2.5
    assert {e["type"] for e in out.log} == {"drop", "fill"}
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert sorted(r[0] for r in impute.impute(nan, ["x"], "mean").collect()) == [1.0, 2.0, 3.0]


def test_trimmed_mean_with_ties(spark):
    values = [1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 9.0, 9.0, 9.0, 100.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert impute.trimmed_mean(df, "v", 0.2) == pytest.approx(sum(values[2:-2]) / 6)
    flat = spark.createDataFrame([(5.0,)] * 4, "v double")
    assert impute.trimmed_mean(flat, "v", 0.25) == 5.0


METHODS = {"iqr": {}, "zscore": {"zscore_threshold": 1.5}, "mad": {}, "percentile": {"upper_percentile": 0.9}}


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("action", ["clip", "drop_rows", "fill_median", "nullify"])
def test_outlier_methods_and_actions(spark, method, action):
    df = spark.createDataFrame([(float(v),) for v in [*range(10, 20), 500]], "v double")
    out = clean_rules(df, [{"action_type": "outlier", "column": "v", "outlier_method": method, "outlier_action": action,
                            **METHODS[method]}]).df
    values = [r["v"] for r in out.collect()]
    assert 500.0 not in values
    assert len(values) == (11 if action != "drop_rows" else 10 if method != "percentile" else 9)
    if action == "fill_median":
        assert values.count(15.0) >= 2


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, None)], "same double, empty double")
    for method in ("robust", "standard", "minmax"):
        out = features.scale(df, ["same", "empty"], method)
        assert [r["same"] for r in out.collect()] == [0.0, 0.0]
    none = df.where("same > 9")
    assert clean_rules(none, [{"action_type": "impute", "column": "same", "impute_method": "mean"}]).df.count() == 0
    assert outliers.iqr_fences(none, ["same"]) == {}
    assert table_profile(none)["missing_pct"] == 0.0
    assert charts.histogram(none, "same").count() == 0


def test_encoding_options(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)] + [(None,)], "k string")
    wide = features.one_hot(df, "k", min_freq=0.2)
    assert wide.columns == ["k_Other", "k_a", "k_b"] and wide.where("k_Other").count() == 1
    codes = sorted(r["k"] for r in features.ordinal(df, ["k"]).collect())
    assert codes == [-1] + [0] * 6 + [1] * 3 + [2]


def test_personal_data_in_one_text(spark):
    text = "mail a.b@x.org card 4111 1111 1111 1111 ssn 123-45-6789 call +49 (30) 123-4567 now"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    rule = {"action_type": "text", "column": "t", "text_case": "none", "pii_mask": True,
            "pii_entities": ["email", "phone", "ssn", "credit_card"],
            "pii_order": ["email", "ssn", "credit_card", "phone"]}
    out = [r["t"] for r in clean_rules(df, [rule]).df.collect()]
    # the phone pattern also takes the space before the next word
    assert out == ["mail [REDACTED_EMAIL] card [REDACTED_CARD] ssn [REDACTED_SSN] call [REDACTED_PHONE]now", None]


def test_rule_diff_shows_removed_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "id long, v double")
    found = rule_diff(df, {"action_type": "impute", "column": "v", "impute_method": "drop_rows"}, ["id"])
    assert [(r["after"], r["changed"]) for r in found["diff"].orderBy("id").collect()] == [
        ("5.0", False), ("REMOVED", True), ("7.0", False)]
    assert found["before"]["nulls"] == 1 and found["after"]["nulls"] == 0
    dropped = rule_diff(df, {"action_type": "drop", "column": "v"}, ["id"])
    assert dropped["after"] is None


def test_roles_and_insights(golden):
    roles = detect_schema(golden)
    assert roles["date"] is None and "Customer Region" in roles["dimensions"]
    found = run_insights(golden, roles, top_n=6)
    # six rows hold no metric: two findings, the overview and two category cards are all there is
    assert [i.type for i in found] == ["categorical", "data_quality", "profile", "profile", "profile"]
    assert all(0 <= i.importance <= 1 for i in found)
    assert insight_table(golden, found).count() == 5
    assert insight_report(found).startswith("Executive Summary")


def test_root_cause_modes(spark):
    rows = [(datetime.date(2024, 1, d), r, v) for d in (1, 2, 3, 4) for r, v in (("n", 10.0), ("s", 5.0 * d))]
    df = spark.createDataFrame(rows, "day date, region string, v double")
    total = root_cause(df, "v", ["region"])
    assert total.mode == "contribution" and total.total == 90.0
    moved = root_cause(df, "v", ["region"], "day")
    assert moved.mode == "change" and moved.total == 20.0
    assert {r["value"]: r["contribution"] for r in moved.drivers.collect()} == {"n": 0.0, "s": 20.0}


def test_resample_fills_missing_days(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 1), 1.0), (datetime.date(2024, 1, 4), 2.0)], "d date, v double")
    assert [r["value"] for r in resample(df, "d", "v", "D").orderBy("period").collect()] == [1.0, 0.0, 0.0, 2.0]


def test_stratified_sample_and_split(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 50, "rare").otherwise("common"))
    kept = {r["c"]: r["count"] for r in shape.sample_stratified(df, "c", ["id"], 200).groupBy("c").count().collect()}
    assert kept == {"rare": 10, "common": 190}
    tagged = shape.split_train_test(df, ["id"], "c")
    tests = {r["c"]: r["n"] for r in tagged.groupBy("c").agg(F.count_if("is_test").alias("n")).collect()}
    assert tests == {"rare": 10, "common": 190}
    assert shape.sample_rows(df, ["id"], 7).collect() == shape.sample_rows(df.repartition(3), ["id"], 7).collect()
