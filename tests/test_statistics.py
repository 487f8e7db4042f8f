"""Tests of hypothesis tests, correlation control, alerts and relationships."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from millrace.functions import distributions
from millrace.functions.formats import brief, precise_value, short_value
from millrace.operators import alerts, hypothesis
from millrace.operators.relations import infer_relationships


def test_adjusted_p_values_are_monotone():
    p = [0.001, 0.01, 0.03, 0.04, 0.20, 0.50]
    q = hypothesis.adjust_p_values(p)
    assert q == sorted(q) and all(0 <= v <= 1 for v in q) and q[0] <= 0.05 < q[-1]
    assert q[0] == pytest.approx(0.006) and q[2] == q[3] == pytest.approx(0.06)
    assert hypothesis.adjust_p_values(p, "bonferroni")[1] == pytest.approx(0.06)
    assert hypothesis.adjust_p_values(p, "fdr_by")[0] == pytest.approx(0.006 * sum(1 / i for i in range(1, 7)))
    assert hypothesis.adjust_p_values([0.2, 0.2, float("nan")]) == pytest.approx([0.3, 0.3, 1.0])
    with pytest.raises(ValueError):
        hypothesis.adjust_p_values(p, "none")


def test_noise_columns_give_few_discoveries(spark):
    raw, found = [], []
    for seed in (42, 43, 44):
        data = np.random.default_rng(seed).normal(size=(100, 40))
        df = spark.createDataFrame(pd.DataFrame(data, columns=[f"c{i}" for i in range(40)]))
        tests = hypothesis.numeric_correlations(df, df.columns)
        assert len(tests) == 780
        raw.append(sum(t.p_value < 0.05 for t in tests))
        found.append(sum(t.significant for t in tests))
    assert np.mean(raw) >= 15 and np.mean(found) <= 1


def test_planted_pairs_rank_first(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(150, 16)), columns=[f"n{i}" for i in range(16)])
    pdf["x1"] = rng.normal(size=150)
    pdf["x2"] = 0.9 * pdf.x1 + rng.normal(size=150) * 0.2
    pdf["x3"] = rng.normal(size=150)
    pdf["x4"] = -0.85 * pdf.x3 + rng.normal(size=150) * 0.2
    pdf["flat"] = 1.0
    top = hypothesis.numeric_correlations(spark.createDataFrame(pdf), list(pdf.columns))[:2]
    assert {frozenset((t.column_a, t.column_b)) for t in top} == {frozenset(("x1", "x2")), frozenset(("x3", "x4"))}
    assert all(t.q_value < 0.01 for t in top)


def test_tail_probabilities(spark):
    assert distributions.t_two_sided(spark, 2.228138852, 10) == pytest.approx(0.05, rel=1e-6)
    assert distributions.chi_square_upper(spark, 3.841458821, 1) == pytest.approx(0.05, rel=1e-6)
    assert distributions.chi_square_upper(spark, 400.0, 1) > 0
    assert distributions.f_upper(spark, 4.964602744, 1, 10) == pytest.approx(0.05, rel=1e-6)
    assert distributions.normal_two_sided(1.959963985) == pytest.approx(0.05, rel=1e-6)
    assert distributions.pearson_p(spark, 1.0, 10) == 0.0 and distributions.pearson_p(spark, 0.5, 2) == 1.0


def test_welch_and_anova_agree_for_two_equal_groups(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", v) for v in (3.0, 4.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    t = hypothesis.t_test(df, "v", "g")
    f = hypothesis.anova(df, "v", "g")
    assert t["statistic"] ** 2 == pytest.approx(f["statistic"]) and t["p_value"] == pytest.approx(f["p_value"])
    assert t["statistic"] == pytest.approx(-2.19089, abs=1e-5) and t["band"] == "Large"


def test_rank_test_exact_and_normal(spark):
    small = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    found = hypothesis.mann_whitney(small, "v", "g")
    assert found["statistic"] == 0 and found["p_value"] == pytest.approx(0.1)
    tied = spark.createDataFrame([("a", float(i // 2)) for i in range(30)] + [("b", float(i // 2 + 4)) for i in range(30)],
                                 "g string, v double")
    assert hypothesis.mann_whitney(tied, "v", "g")["p_value"] < 0.01
    same = spark.createDataFrame([(1.0, 1.0)] * 20, "x double, y double")
    assert hypothesis.mann_whitney(same, "x", "y")["p_value"] == 1.0


def test_two_by_two_uses_the_continuity_correction(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 15
    df = spark.createDataFrame(rows, "a string, b string")
    found = hypothesis.chi_square(df, "a", "b")
    n, det = 75, abs(10 * 15 - 20 * 30)
    assert found["statistic"] == pytest.approx(n * (det - n / 2) ** 2 / (30 * 45 * 40 * 35))
    with pytest.raises(ValueError, match="unknown test"):
        hypothesis.run_test(df, "sign", "a", "b")


def test_alert_rules(spark, tmp_path):
    path = str(tmp_path / "base")
    df = spark.createDataFrame([(10.0, 1.0)] * 10, "a double, b double")
    assert alerts.check(df, ["a", "b"], path).count() == 0
    worse = spark.createDataFrame([(5.0, 2.0)] * 5 + [(None, 2.0)], "a double, b double")
    fired = [(r["rule"], r["severity"], r["metric"]) for r in alerts.check(worse, ["a", "b"], path).collect()]
    assert fired[0] == ("critical_drop", "critical", "a")
    assert {f[0] for f in fired} == {"critical_drop", "metric_drop", "metric_spike", "missing_values", "row_count_drop"}
    other = spark.createDataFrame([(1.0,)], "c double")
    assert alerts.check(other, ["c"], path).count() == 0
    assert [r["metric"] for r in alerts.load_baseline(spark, path).collect()] == ["c"]


def test_relationship_rules(spark):
    orders = spark.createDataFrame([(1, 1, "u1"), (2, 1, "u2"), (3, 2, "u1")], "id long, customers_id long, user_id string")
    customers = spark.createDataFrame([(1, 5), (2, 6)], "id long, user_id long")
    rows = {(r["left_column"], r["right_column"]): r for r in infer_relationships({"orders": orders, "customers": customers}).collect()}
    assert rows[("customers_id", "id")]["confidence"] == 0.98 and rows[("customers_id", "id")]["cardinality"] == "many_to_one"
    assert rows[("user_id", "user_id")]["confidence"] == 0.47 and rows[("id", "id")]["cardinality"] == "one_to_one"


def test_number_texts():
    assert [short_value("price", v) for v in (5, 1500, 2_250_000, 1000)] == ["$5.00", "$1.5K", "$2.25M", "$1K"]
    assert [short_value("n", v) for v in (5, 5.25, -1500.0)] == ["5", "5.25", "-1.5K"]
    assert precise_value("sales", 1234.5) == "$1,234.50" and precise_value("x", 1234.0) == "1,234"
    assert [brief(v) for v in (12.345, 12_345, 1_234_567)] == ["12.35", "12.3K", "1.2M"] or brief(12.345) in ("12.34", "12.35")


def test_all_pairs_of_categories_against_plain_counts(spark):
    pick = np.random.default_rng(12)
    rows = [(str(pick.integers(0, 2)), None if pick.random() < 0.2 else f"l{pick.integers(0, 60)}", int(pick.integers(0, 4)),
             None if pick.random() < 0.97 else "rare", "same", "yn"[int(pick.random() < 0.4)]) for _ in range(3_000)]
    names = ["two", "many", "four", "scarce", "flat", "yn"]
    df = spark.createDataFrame(rows, "two string, many string, four int, scarce string, flat string, yn string").repartition(5)
    found = {(x.column_a, x.column_b): x for x in hypothesis.categorical_associations(df, names)}
    want = {}
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            counts = Counter((str(r[i]), str(r[j])) for r in rows if r[i] is not None and r[j] is not None)
            if sum(counts.values()) >= 15:
                stat, dof, n, left, right = hypothesis.chi_square_stats(counts)
                if min(left, right) >= 2 and max(left, right) <= 50:
                    want[a, names[j]] = stat, n
    assert found.keys() == want.keys() == {("two", "four"), ("two", "yn"), ("four", "yn")}
    for pair, (stat, n) in want.items():
        assert found[pair].sample_size == n and math.isclose(found[pair].statistic, stat, rel_tol=1e-9)
    wide = hypothesis.categorical_associations(df, ["many", "four"], max_levels=60)
    assert len(wide) == 1 and hypothesis.categorical_associations(df.limit(0), names) == []


def test_variance_over_every_level_or_those_named(spark):
    rows = [(f"g{i % 9}", float((i * 7) % 13 + i % 9)) for i in range(120)] + [("lone", 4.0), (None, 2.0), ("g1", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    groups = {}
    for g, v in rows:
        if g not in (None, "lone") and v is not None:
            groups.setdefault(g, []).append(v)

    def plain(chosen):
        values = [np.array(groups[g]) for g in chosen]
        every = np.concatenate(values)
        between = sum(len(v) * (v.mean() - every.mean()) ** 2 for v in values) / (len(values) - 1)
        return between / (sum(((v - v.mean()) ** 2).sum() for v in values) / (len(every) - len(values)))

    every = hypothesis.anova(df, "v", "g")
    assert every["groups"] == 9 and math.isclose(every["statistic"], plain(sorted(groups)), rel_tol=1e-9)
    some = hypothesis.anova(df, "v", "g", groups=["g1", "g8", "g3"])
    assert some["groups"] == 3 and math.isclose(some["statistic"], plain(["g1", "g8", "g3"]), rel_tol=1e-9)
    with pytest.raises(ValueError, match="two groups"):
        hypothesis.anova(df, "v", "g", groups=["g1", "lone"])
