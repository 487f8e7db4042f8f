"""Randomised or iterative operators against brute force or known structure."""

from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import chained, fuzzy
from millrace.operators.chained import impute_mice
from millrace.operators.curves import interpolate_curve
from millrace.operators.forest import isolation_scores, treat_isolated
from millrace.operators.neighbours import impute_knn, nearest_rows
from millrace.session import TASK_ROWS_KEY


def ratio(a, b):
    return max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())


def brute_groups(labels, threshold):
    parent = {v: v for v in labels}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(labels, 2):
        if ratio(a, b) >= threshold:
            parent[root(a)] = root(b)
    groups = {}
    for v in labels:
        groups.setdefault(root(v), []).append(v)
    return {v: min(g, key=lambda w: (-len(w), w)) for g in groups.values() for v in g}


def make_labels():
    rng = np.random.default_rng(2)
    words = ["acme", "global", "north", "trade", "steel", "media", "works", "zen", "ab", "abc", "abcd", "abcde", "xyzzy"]
    out = set(words)
    for _ in range(120):
        base = " ".join(rng.choice(words, size=rng.integers(1, 4)))
        out.add(base)
        for _ in range(2):
            at = int(rng.integers(0, len(base)))
            out.add(base[:at] + rng.choice(list("aeioux ")) + base[at + int(rng.integers(0, 2)):])
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.7, 0.85, 0.95])
def test_fuzzy_labels_match_brute_force(spark, threshold):
    labels = make_labels()
    df = spark.createDataFrame([(v,) for v in labels], "label string")
    got = {r["label"]: r["canonical"] for r in fuzzy.canonical_labels(df, threshold).collect()}
    want = {k: v for k, v in brute_groups(labels, threshold).items() if k != v}
    assert {k: v for k, v in got.items() if k != v} == want


def test_fuzzy_deeper_keys_find_the_same_pairs(spark, monkeypatch):
    labels = make_labels()
    df = spark.createDataFrame([(v,) for v in labels], "label string")
    want = {(a, b) for a, b in combinations(labels, 2) if ratio(a, b) >= 0.85}
    for crowded in (1, 10_000):
        monkeypatch.setattr(fuzzy, "CROWDED", crowded)
        assert {(r["a"], r["b"]) for r in fuzzy.similar_pairs(df, 0.85).collect()} == want


def test_fuzzy_part_names_of_the_given_table(spark, table):
    labels = sorted(r[0] for r in table("part").select("p_name").distinct().collect())
    want = brute_groups(labels, 0.8)
    got = fuzzy.fuzzy_dedupe(table("part").select(F.col("p_name").alias("raw"), "p_name"), "p_name", 0.8)
    assert all(r["p_name"] == want[r["raw"]] for r in got.collect())


def test_one_coordinate_neighbours_are_exact(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": np.arange(300), "x": rng.random(300).round(6), "y": rng.random(300)})
    pdf.loc[pdf.id % 5 == 0, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = impute_knn(df, ["x", "y"], ["id"], 4).toPandas().set_index("id").y
    donors = pdf[pdf.y.notna()]
    for row in pdf[pdf.y.isna()].itertuples():
        near = donors.assign(d=(donors.x - row.x).abs()).nsmallest(4, "d")
        assert got[row.id] == pytest.approx(near.y.mean())


def test_two_coordinate_neighbours_are_close(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": np.arange(600), "a": rng.random(600), "b": rng.random(600)})
    pdf["y"] = pdf.a * 3 + pdf.b
    truth = pdf.y.copy()
    pdf.loc[pdf.id % 6 == 0, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    for weights in ("uniform", "distance"):
        got = impute_knn(df, ["a", "b", "y"], ["id"], 5, weights).toPandas().set_index("id").y.sort_index()
        missing = pdf.y.isna()
        assert (got[missing.values] - truth[missing]).abs().mean() < 0.15
    with pytest.raises(ValueError, match="key"):
        impute_knn(df, ["a", "y"], [])


def test_neighbours_across_blocks(spark):
    pdf = pd.DataFrame({"id": np.arange(199), "x": np.arange(199) * 1.0, "y": np.arange(199) * 2.0})
    pdf.loc[pdf.id % 7 == 3, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    spark.conf.set(TASK_ROWS_KEY, "30")
    try:
        got = impute_knn(df, ["x", "y"], ["id"], 2).toPandas().set_index("id").y.sort_index()
    finally:
        spark.conf.unset(TASK_ROWS_KEY)
    assert np.allclose(got, np.arange(199) * 2.0)


def test_chained_regression_recovers_linear_columns(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=400)
    pdf = pd.DataFrame({"x": x, "y": 2 * x + 1 + rng.normal(size=400) * 0.01, "z": -x + rng.normal(size=400) * 0.01})
    truth = pdf.copy()
    pdf.loc[rng.random(400) < 0.2, "y"] = np.nan
    pdf.loc[rng.random(400) < 0.2, "z"] = np.nan
    pdf["id"] = np.arange(400)
    df = spark.createDataFrame(pdf)
    got = impute_mice(df, ["x", "y", "z"]).toPandas().sort_values("id")
    assert np.abs(got.y.values - truth.y.values).max() < 0.2 and np.abs(got.z.values - truth.z.values).max() < 0.2


def test_isolation_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": np.arange(1000), "a": rng.normal(size=1000), "b": rng.normal(size=1000)})
    pdf.loc[:19, ["a", "b"]] += 12
    df = spark.createDataFrame(pdf)
    top = isolation_scores(df, ["a", "b"]).orderBy(F.desc("iso_score")).limit(20).toPandas()
    assert (top.id < 20).sum() >= 19
    kept = treat_isolated(df, ["a", "b"], 0.02, action="drop_rows")
    assert kept.count() == 980
    assert treat_isolated(df, ["a", "b"], 0.02, action="nullify").where("a IS NULL").count() == 20
    again = isolation_scores(df.repartition(5), ["a", "b"]).agg(F.sum("iso_score")).first()[0]
    assert again == pytest.approx(isolation_scores(df, ["a", "b"]).agg(F.sum("iso_score")).first()[0])


def test_curve_follows_a_parabola(spark):
    t = np.arange(40)
    pdf = pd.DataFrame({"t": t, "g": t % 2, "v": 0.5 * t**2 - t})
    holes = pdf.copy()
    holes.loc[[6, 7, 8, 21, 22], "v"] = np.nan
    df = spark.createDataFrame(holes).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = interpolate_curve(df, ["v"], ["t"], degree=2).toPandas().sort_values("t")
    assert np.allclose(got.v, pdf.v)
    parted = interpolate_curve(df, ["v"], ["t"], ["g"], degree=2).toPandas().sort_values("t")
    assert np.allclose(parted.v, pdf.v)


def test_chained_regressions_by_patterns_equal_the_rounds(spark):
    pick = np.random.default_rng(6)
    base = pick.normal(size=(400, 2)) @ pick.normal(size=(2, 5)) + pick.normal(size=(400, 5)) * 0.3
    data = base * [1, 10, 0.1, 5, 2] + [0, 100, 3, -7, 1]
    data[pick.random(data.shape) < [0.3, 0.2, 0.0, 0.1, 0.25]] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)],
                               "id long, a double, b double, c double, d double, e double")
    for rounds, tolerance in ((2, 1e-3), (30, 1e-2)):
        got = impute_mice(df, list("abcde"), rounds, tolerance=tolerance)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(chained.Chain, "by_patterns", lambda self: None)
            want = impute_mice(df, list("abcde"), rounds, tolerance=tolerance)
        assert got.columns == df.columns
        left, right = (x.toPandas().sort_values("id")[list("abcde")].to_numpy() for x in (got, want))
        assert np.abs(left - right).max() < 1e-9 and not np.isnan(left).any()
        assert (left[~np.isnan(data)] == data[~np.isnan(data)]).all()


def test_patterns_beyond_the_driver_take_the_rounds(spark, monkeypatch):
    rows = [(i, None if i % 5 == 0 else float(i), None if i % 3 == 0 else 2.0 * i, float(i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    want = impute_mice(df, list("abc"), 3).toPandas().sort_values("id")
    monkeypatch.setattr(chained, "CELLS_PER_ROW", 0)
    got = impute_mice(df, list("abc"), 3).toPandas().sort_values("id")
    assert np.abs(got[list("abc")].to_numpy() - want[list("abc")].to_numpy()).max() < 1e-9


@pytest.mark.parametrize("width", [2, 5])
def test_most_of_the_nearest_rows_are_found(spark, width):
    pick, n = np.random.default_rng(width), 1_500
    points = np.concatenate([pick.normal(size=(n // 3, width)) * 0.3 + pick.normal(size=width) * 3 for _ in range(3)])
    gap = pick.random(n) < 0.1
    rows = [(i, *map(float, points[i]), None if gap[i] else 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"x{j} double" for j in range(width)) + ", y double")
    apart, donors = ((points[gap][:, None] - points[~gap][None]) ** 2).sum(axis=2), np.flatnonzero(~gap)
    want = dict(zip(np.flatnonzero(gap).tolist(), (set(donors[o].tolist()) for o in np.argsort(apart, axis=1)[:, :5])))
    got = {r.id: {p.dk.id for p in r.near} for r in nearest_rows(df, "y", [f"x{j}" for j in range(width)], ["id"]).collect()}
    assert np.mean([len(got[q] & near) / 5 for q, near in want.items()]) >= 0.9
