"""Results cover whole tables at every size: no cap, prefix or switch changes them."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from millrace.operators import hypothesis, learn, profile, questions, shape
from millrace.operators.quantiles import exact_quantiles
from millrace.plans import cleaning
from millrace.session import DRIVER_ROWS_KEY, TASK_ROWS_KEY, shared_root


@pytest.fixture
def tiny_driver(spark):
    spark.conf.set(DRIVER_ROWS_KEY, "10")
    yield 10
    spark.conf.unset(DRIVER_ROWS_KEY)


def test_answer_text_sees_every_group(spark):
    df = spark.range(5000).select(F.concat(F.lit("g"), "id").alias("g"), F.col("id").cast("double").alias("v"))
    plan = {"intent": "mean", "numeric_col": "v", "category_col": "g"}
    assert questions.answer_text(questions.answer(df, plan), plan) == "'g4999' has the highest v of 5,000 g groups: 4,999.00."


@pytest.mark.parametrize("intent,part", [
    ("missing", "largest share"), ("summary", "columns"), ("correlation", "move together"), ("top_n", "last of the"),
    ("sum", "total of v"), ("outlier", "1.5 IQR"),
])
def test_answer_text_of_each_kind(spark, intent, part):
    df = spark.createDataFrame([(f"g{i % 3}", float(i), float(i * i), None if i else 1.0) for i in range(40)], "g string, v double, w double, x double")
    plan = {"intent": intent, "numeric_col": "v", "category_col": "g" if intent == "top_n" else None, "n": 2}
    assert part in questions.answer_text(questions.answer(df, plan), plan)


def test_text_features_of_many_levels_stay(spark, tiny_driver):
    rows = [(i, f"code{i % 40}", float(i % 7), float(i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, code string, x double, y double")
    assert learn.feature_names(df, "y", exclude=["id"]) == ["code", "x"]
    trained = learn.train_model(df, "y", ["id"], task="regression", algorithms=["rf"])
    assert "code" in trained.features
    audit = {r.name: r for r in learn.audit_features(df, "y").collect()}
    assert audit["code"].correlation is not None


def test_date_roles_look_at_every_row(spark):
    texts = ["2024-01-%02d" % (1 + i % 28) for i in range(50)]
    good = spark.createDataFrame([(t, 2000 + i % 20) for i, t in enumerate(texts)], "date_text string, year int")
    assert profile.detect_schema(good)["date"] == "date_text" and "year" in profile.detect_schema(good)["dimensions"]
    bad = good.unionByName(spark.createDataFrame([("soon", 12)], good.schema))
    assert profile.detect_schema(bad)["date"] is None


def brute_u(n1, n2, u):
    sums = [sum(c) - n1 * (n1 + 1) // 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
    top = max(u, n1 * n2 - u)
    return min(1.0, 2 * sum(s >= top for s in sums) / len(sums))


def test_exact_rank_test_at_every_size(spark):
    for n1, n2 in ((2, 5), (3, 7), (5, 6)):
        for u in range(n1 * n2 + 1):
            assert math.isclose(hypothesis._exact_u(n1, n2, u), brute_u(n1, n2, u), rel_tol=1e-12)
    rows = [("a", -1.0 - i) for i in range(6)] + [("b", float(i)) for i in range(1000)]
    found = hypothesis.mann_whitney(spark.createDataFrame(rows, "g string, v double"), "v", "g")
    assert math.isclose(found["p_value"], 2 / math.comb(1006, 6), rel_tol=1e-9)


def test_rank_test_of_a_huge_group_continues_the_exact_one(monkeypatch):
    exact = hypothesis._exact_u(4, 5000, 18_000)
    monkeypatch.setattr(hypothesis, "RANK_CELLS", 10)
    assert math.isclose(hypothesis._exact_u(4, 5000, 18_000), exact, rel_tol=2e-4)


@pytest.mark.parametrize("m", [1, 2, 7, 1000, 123_456])
def test_harmonic_numbers(m):
    assert math.isclose(hypothesis.harmonic(m), math.fsum(1 / i for i in range(1, m + 1)), rel_tol=1e-14)


def test_permutation_uses_all_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 13), float(i % 13) * 2) for i in range(2500)], "id long, x double, y double")
    trained = learn.train_model(df, "y", ["id"], task="regression", algorithms=["linear"])
    seen = []
    real = learn.number_rows
    monkeypatch.setattr(learn, "number_rows", lambda d, *a, **k: seen.append(d.count()) or real(d, *a, **k))
    learn.permutation_importance(trained, df, ["id"])
    assert seen == [2500]


def test_many_classes_are_split_and_sampled(spark, small_tasks):
    df = spark.range(6000).select("id", F.concat(F.lit("c"), F.col("id") % 1500).alias("label"))
    split = shape.split_train_test(df, ["id"], "label", 0.25)
    sizes = split.groupBy("label").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n"))
    assert sizes.where("t <> 1 OR n <> 4").count() == 0 and sizes.count() == 1500
    assert shape.sample_stratified(df, "label", ["id"], 3000).groupBy("label").count().where("count <> 2").count() == 0


def test_chi_square_and_imbalance_keep_cells_in_spark(spark, tiny_driver):
    rows = [(f"a{i % 7}", f"b{(i * i) % 11}") for i in range(500)]
    df = spark.createDataFrame(rows, "a string, b string")
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    want, got = hypothesis.chi_square_stats(counts), hypothesis.independence(df, "a", "b")
    assert got[1:] == want[1:] and math.isclose(got[0], want[0], rel_tol=1e-12)
    found = learn.detect_imbalance(df, "b")
    assert found["minority_ratio"] == round(min(df.groupBy("b").count().toPandas()["count"]) / 500, 4)


def test_chi_square_beside_a_constant_collects_no_cells(spark, monkeypatch):
    df = spark.createDataFrame([("same", f"b{i % 400}") for i in range(1000)] + [(None, "b0")], "a string, b string")
    small = spark.createDataFrame([("x", "y"), ("x", "z"), ("w", "z")], "a string, b string")
    assert hypothesis.independence(small, "a", "b")[1:] == (1, 3, 2, 2)
    assert hypothesis.independence(small.limit(0), "a", "b") == (0.0, 0, 0, 0, 0)
    monkeypatch.setattr(hypothesis, "chi_square_stats", lambda counts: pytest.fail("cells on the driver"))
    assert hypothesis.independence(df, "a", "b") == (0.0, 0, 1000, 1, 400)
    assert hypothesis.independence(df, "b", "a") == (0.0, 0, 1000, 400, 1)


def test_three_classes_are_boosted(spark):
    rows = [(i, float(i % 3) + (i % 5) / 10, "abc"[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, x double, y string")
    trained = learn.train_model(df, "y", ["id"], algorithms=["gbt"])
    assert trained.leaderboard[0][0] == "gbt" and trained.metrics["accuracy"] > 0.9


def test_quantiles_send_numbers_only(spark, monkeypatch):
    df = spark.range(400_000).select(*[(F.xxhash64("id", F.lit(c)) / 1e9).alias(f"c{c}") for c in range(4)])
    sizes = []
    kind = type(df)
    real = kind.first

    def first(self):
        row = real(self)
        sizes.append(max(len(v) if isinstance(v, list) else 1 for v in row))
        return row

    monkeypatch.setattr(kind, "first", first)
    spark.conf.set(TASK_ROWS_KEY, "200000")
    try:
        got = exact_quantiles(df, {f"c{c}": [0.1, 0.5, 0.9] for c in range(4)})
    finally:
        spark.conf.unset(TASK_ROWS_KEY)
    monkeypatch.undo()
    assert max(sizes) <= 6
    want = df.agg(*[F.percentile(f"c{c}", F.array(*map(F.lit, (0.1, 0.5, 0.9)))) for c in range(4)]).first()
    assert all(math.isclose(x, y, rel_tol=1e-12) for c in range(4) for x, y in zip(got[f"c{c}"], want[c]))


def test_clusters_need_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Session())


def test_neighbouring_rules_share_a_pass(spark):
    df = spark.createDataFrame([(float(i), float(i % 5) if i % 3 else None, None if i % 4 == 0 else float(i)) for i in range(60)],
                               "k double, a double, b double")
    rules = [{"action_type": "impute", "column": "a", "impute_method": "median"},
             {"action_type": "impute", "column": "b", "impute_method": "median"},
             {"action_type": "outlier", "column": "b", "outlier_method": "iqr", "outlier_action": "clip"},
             {"action_type": "impute", "column": "a", "impute_method": "mean"}]
    assert [r["columns"] for r in cleaning._together(rules)] == [["a", "b"], ["b"], ["a"]]
    alone = df
    for rule in rules:
        alone = cleaning.clean_rules(alone, [rule]).df
    assert sorted(cleaning.clean_rules(df, rules).df.collect()) == sorted(alone.collect())


def test_costly_rules_are_cut_off(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i) if i % 3 else None, float(i % 7)) for i in range(40)], "k long, a double, b double")
    cut = []
    monkeypatch.setattr(cleaning, "materialize", lambda d: cut.append(1) or d)
    fill = {"action_type": "impute", "column": "a", "impute_method": "ffill", "order_by": ["k"]}
    cleaning.clean_rules(df, [fill, {"action_type": "scale", "column": "b"}])
    cleaning.clean_rules(df, [fill])
    assert cut == [1]


def test_class_metrics_against_plain_counts(spark):
    pick = random.Random(4)
    pairs = [(pick.choice("abcd"), pick.choice("abcde")) for _ in range(300)] + [(None, "a"), ("a", None), (None, None)]
    got = learn.classification_metrics(spark.createDataFrame(pairs, "y string, p string"), "y", "p")
    want = dict.fromkeys(("precision", "recall", "f1"), 0.0) | {"accuracy": sum(y == p for y, p in pairs) / len(pairs)}
    for value in {y for y, _ in pairs}:
        hit, actual = sum(y == p == value for y, p in pairs), sum(y == value for y, _ in pairs)
        guessed = sum(p == value for _, p in pairs)
        precision, recall = hit / guessed if guessed else 0.0, hit / actual
        for name, number in (("precision", precision), ("recall", recall),
                             ("f1", 2 * precision * recall / (precision + recall) if precision + recall else 0.0)):
            want[name] += number * actual / len(pairs)
    assert {n: pytest.approx(v) for n, v in want.items()} == got
    numbers = spark.createDataFrame([(1, 1.0), (0, 1.0), (1, 0.0)], "y int, p double")
    assert learn.classification_metrics(numbers, "y", "p")["accuracy"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("name, values, want", [
    ("user_id", ["a"], True), ("no of rooms", ["a"], True), ("price", ["a"], False), ("total", [float(i) for i in range(99)], False),
    ("amount", list(range(99)), False), ("amount", [1, 2, 3] * 40, True), ("made", list(range(1950, 2020)) * 3, True)])
def test_id_like_names_and_numbers(spark, name, values, want):
    kind = {str: "string", float: "double", int: "int"}[type(values[0])]
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")
    assert profile.id_like(df, name) is want
