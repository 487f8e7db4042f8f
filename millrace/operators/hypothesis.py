"""Tests of association and difference, with control of the false discovery rate.

Spark reduces the data to sufficient statistics; only those reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.columns import as_double, col, is_numeric
from millrace.functions.distributions import (
    chi_square_upper, f_upper, normal_two_sided, pearson_p, t_two_sided,
)
from millrace.operators.ordered import Ordered
from millrace.operators.stats import pearson
from millrace.session import materialize, session_of

METHODS = ("fdr_bh", "fdr_by", "bonferroni")


# ---- false discovery rate

def harmonic(m: int) -> float:
    """1 + 1/2 + … + 1/m: asymptotic series at m + 64, where its first terms are exact to the last digit."""
    n = m + 64
    tail = math.fsum(1.0 / i for i in range(m + 1, n + 1))
    return math.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4) - 1 / (252 * n**6) - tail


def adjust_p_values(p_values: Sequence[float], method: str = "fdr_bh") -> list[float]:
    """Adjusted p-values in the order given (a short list, e.g. one per column pair)."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    m = len(p_values)
    clean = [1.0 if p is None or math.isnan(p) else min(max(p, 0.0), 1.0) for p in p_values]
    if method == "bonferroni":
        return [min(p * m, 1.0) for p in clean]
    factor = harmonic(m) if method == "fdr_by" else 1.0
    out, floor = [0.0] * m, 1.0
    by_size = sorted(range(m), key=lambda i: clean[i])
    for rank in range(m, 0, -1):
        i = by_size[rank - 1]
        floor = min(floor, clean[i] * m * factor / rank)
        out[i] = floor
    return out


def adjust_p_table(df: DataFrame, p: str, method: str = "fdr_bh", alpha: float = 0.05) -> DataFrame:
    """q-values for a p-value table of any size: ranks and a minimum from the largest p down."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    held = F.coalesce(F.when(~F.isnan(col(p)), col(p)), F.lit(1.0))
    m = df.count()
    if method == "bonferroni":
        q = F.least(F.least(F.greatest(held, F.lit(0.0)), F.lit(1.0)) * m, F.lit(1.0))
        return df.withColumn("q_value", q).withColumn("reject", F.col("q_value") <= alpha)
    factor = harmonic(m) if method == "fdr_by" else 1.0
    names = df.columns
    work = df.withColumn("_p", F.least(F.greatest(held, F.lit(0.0)), F.lit(1.0)))
    run = Ordered(work, ["_p", *names])
    run.number("_rank")
    raw = F.col("_p") * m * factor / F.col("_rank")
    run.df = run.df.withColumn("_raw", raw)
    local = F.min("_raw").over(run.after())
    if run.blocked:
        run.with_carry({"_later": F.min("_raw")}, lambda n, w: F.min(n).over(w), forward=False)
        local = F.least(local, F.col("_later"))
    out = run.df.withColumn("q_value", F.least(local, F.lit(1.0)))
    return out.select(*[col(n) for n in names], "q_value", (F.col("q_value") <= alpha).alias("reject"))


# ---- pairs of columns

@dataclass
class PairTest:
    family: str
    column_a: str
    column_b: str
    sample_size: int
    statistic: float
    effect_size: float
    p_value: float
    q_value: float = 1.0
    significant: bool = False


def _finish(tests: list[PairTest], alpha: float, method: str) -> list[PairTest]:
    for test, q in zip(tests, adjust_p_values([t.p_value for t in tests], method)):
        test.q_value, test.significant = q, q <= alpha
    return sorted(tests, key=lambda t: (t.significant, t.effect_size), reverse=True)


def pair_table(df: DataFrame, tests: Sequence[PairTest]) -> DataFrame:
    schema = ("family string, column_a string, column_b string, sample_size long, statistic double, "
              "effect_size double, p_value double, q_value double, significant boolean")
    return df.sparkSession.createDataFrame([tuple(asdict(t).values()) for t in tests], schema)


def numeric_correlations(
    df: DataFrame, names: Sequence[str], min_samples: int = 10, alpha: float = 0.05, method: str = "fdr_bh"
) -> list[PairTest]:
    """Pearson r of every pair over the rows where both are known, all pairs in one aggregate."""
    names = [n for n in names if n in df.columns and is_numeric(df, n)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return []
    view = df.select(*[as_double(df, n).alias(f"x{i}") for i, n in enumerate(names)])
    at = {n: F.col(f"x{i}") for i, n in enumerate(names)}
    picks = []
    for i, (a, b) in enumerate(pairs):
        both = at[a].isNotNull() & at[b].isNotNull()
        picks += [F.count_if(both).alias(f"n{i}"), pearson(at[a], at[b]).alias(f"r{i}"),
                  F.stddev_pop(F.when(both, at[a])).alias(f"a{i}"), F.stddev_pop(F.when(both, at[b])).alias(f"b{i}")]
    row = view.agg(*picks).first()
    spark, tests = session_of(df), []
    for i, (a, b) in enumerate(pairs):
        n, r = row[f"n{i}"], row[f"r{i}"]
        flat = min(row[f"a{i}"] or 0.0, row[f"b{i}"] or 0.0) < 1e-12
        if n < min_samples or flat or r is None or math.isnan(r):
            continue
        tests.append(PairTest("numeric_numeric", a, b, n, r, abs(r), pearson_p(spark, r, n)))
    return _finish(tests, alpha, method)


def chi_square_stats(counts: dict[tuple[Any, Any], int]) -> tuple[float, int, int, int, int]:
    """(chi², degrees of freedom, n, rows, columns) of a contingency table, corrected for 2×2."""
    left: dict[Any, int] = {}
    right: dict[Any, int] = {}
    for (a, b), n in counts.items():
        left[a] = left.get(a, 0) + n
        right[b] = right.get(b, 0) + n
    total = sum(counts.values())
    dof = (len(left) - 1) * (len(right) - 1)
    statistic = 0.0
    for a in left:
        for b in right:
            expected = left[a] * right[b] / total
            apart = abs(counts.get((a, b), 0) - expected)
            if dof == 1:
                apart -= min(0.5, apart)
            statistic += apart * apart / expected
    return statistic, dof, total, len(left), len(right)


def independence(df: DataFrame, a: str, b: str) -> tuple[float, int, int, int, int]:
    """The same five numbers for two columns of a table, from cells and margins that stay in Spark."""
    cells = df.dropna(subset=[a, b]).groupBy(col(a).cast("string").alias("a"), col(b).cast("string").alias("b")).agg(
        F.count(F.lit(1)).alias("n"))
    left = cells.groupBy("a").agg(F.sum("n").alias("l"))
    right = cells.groupBy("b").agg(F.sum("n").alias("r"))
    rows, total = left.agg(F.count(F.lit(1)), F.sum("l")).first()
    columns = right.count()
    dof = (rows - 1) * (columns - 1)
    if rows > 0 and dof == 0:
        return 0.0, 0, total, rows, columns  # beside a constant column every pair occurs as often as expected
    if rows <= 2 and columns <= 2:
        return chi_square_stats({(r["a"], r["b"]): r["n"] for r in cells.collect()}) if total else (0.0, 0, 0, 0, 0)
    expected = F.col("l") * F.col("r").cast("double") / total
    # pairs that never occur add their expected number, which is what the observed pairs leave
    apart = F.sum((F.col("n") - expected) ** 2 / expected).alias("seen")
    row = cells.join(left, "a").join(right, "b").agg(apart, F.sum(expected).alias("covered")).first()
    return row["seen"] + total - row["covered"], dof, total, rows, columns


def _pair_cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(pair, a, b, n): how often two levels of the columns i < j meet, for pair = i * columns + j.

    Every task codes the levels it sees and counts each pair of columns in one small matrix, so no row is
    copied; what travels is one row per cell and task.
    """
    width = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[dict[str, int]] = [{} for _ in names]
        tables: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            codes = []
            for column, known in zip(batch.columns, levels):
                coded = column.dictionary_encode()
                place = np.array([known.setdefault(v, len(known)) for v in coded.dictionary.to_pylist()] + [-1], np.int64)
                codes.append(place[coded.indices.fill_null(len(place) - 1).to_numpy(zero_copy_only=False)])
            for i in range(width):
                for j in range(i + 1, width):
                    shape = (len(levels[i]), len(levels[j]))
                    both = (codes[i] >= 0) & (codes[j] >= 0)
                    met = np.bincount(codes[i][both] * shape[1] + codes[j][both], minlength=shape[0] * shape[1]).reshape(shape)
                    if (i, j) in tables:
                        old = tables[i, j]
                        met[: old.shape[0], : old.shape[1]] += old
                    tables[i, j] = met
        for (i, j), table in tables.items():
            left, right = np.nonzero(table)
            names_of = [pa.array(list(levels[k]), pa.string()).take(pa.array(at)) for k, at in ((i, left), (j, right))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(left), i * width + j, np.int32)), *names_of, pa.array(table[left, right])],
                names=["pair", "a", "b", "n"])

    rows = df.select(*[col(n).cast("string").alias(f"c{i}") for i, n in enumerate(names)])
    cells = rows.mapInArrow(count, "pair int, a string, b string, n long")
    return cells.groupBy("pair", "a", "b").agg(F.sum("n").alias("n"))


def categorical_associations(
    df: DataFrame, names: Sequence[str], min_samples: int = 15, alpha: float = 0.05, method: str = "fdr_bh",
    max_levels: int = 50,
) -> list[PairTest]:
    """Chi-square and Cramér's V of every pair of columns with at most 50 levels, one job for all counts.

    Cells and margins stay in Spark; the driver gets five numbers for each pair.
    """
    names = [n for n in names if n in df.columns]
    if len(names) < 2:
        return []
    levels = df.agg(*[F.approx_count_distinct(col(n), 0.02).alias(f"d{i}") for i, n in enumerate(names)]).first()
    # the sketch only rules out columns far above the limit; the exact rule is applied below
    names = [n for i, n in enumerate(names) if levels[i] <= max_levels * 1.5]
    if len(names) < 2:
        return []
    cells = materialize(_pair_cells(df, names))
    left = cells.groupBy("pair", "a").agg(F.sum("n").alias("l"))
    right = cells.groupBy("pair", "b").agg(F.sum("n").alias("r"))
    totals = left.groupBy("pair").agg(F.sum("l").alias("total"), F.count(F.lit(1)).alias("rows")).join(
        right.groupBy("pair").agg(F.count(F.lit(1)).alias("columns")), "pair").where(
        (F.col("total") >= min_samples) & (F.greatest("rows", "columns") <= max_levels) & (F.least("rows", "columns") >= 2))
    # at most max_levels x max_levels cells a pair, with those that never occur
    whole = left.join(totals, "pair").join(right, "pair").join(cells, ["pair", "a", "b"], "left")
    expected = F.col("l") * F.col("r").cast("double") / F.col("total")
    apart = F.abs(F.coalesce("n", F.lit(0)) - expected)
    apart = apart - F.when((F.col("rows") == 2) & (F.col("columns") == 2), F.least(F.lit(0.5), apart)).otherwise(0.0)
    found = whole.groupBy("pair", "total", "rows", "columns").agg(F.sum(apart * apart / expected).alias("statistic")).collect()
    spark, tests = session_of(df), []
    for r in sorted(found):
        v = math.sqrt(r["statistic"] / (r["total"] * min(r["rows"] - 1, r["columns"] - 1)))
        p = chi_square_upper(spark, r["statistic"], (r["rows"] - 1) * (r["columns"] - 1))
        a, b = divmod(r["pair"], len(names))
        tests.append(PairTest("categorical_categorical", names[a], names[b], r["total"], r["statistic"], min(v, 1.0), p))
    return _finish(tests, alpha, method)


# ---- single tests

def _two_groups(df: DataFrame, a: str, b: str, groups: Sequence[Any] | None) -> tuple[list[str], DataFrame]:
    """(names, long table of g, v): two categories of b over a, or the two numeric columns."""
    if not is_numeric(df, a):
        raise ValueError("the first column must be numeric")
    if is_numeric(df, b):
        pair = F.array(F.struct(F.lit(a).alias("g"), as_double(df, a).alias("v")),
                       F.struct(F.lit(b).alias("g"), as_double(df, b).alias("v")))
        return [a, b], df.select(F.inline(pair)).where("v IS NOT NULL")
    names = [str(g) for g in groups or _first_levels(df, b, 2)]
    if len(names) < 2:
        raise ValueError(f"column {b!r} needs at least two categories")
    text = col(b).cast("string")
    long = df.where(text.isin(names[:2])).select(text.alias("g"), as_double(df, a).alias("v"))
    return names[:2], long.where("v IS NOT NULL")


def _first_levels(df: DataFrame, name: str, n: int) -> list[str]:
    """The first n levels in alphabetical order (rows have no order of their own)."""
    text = col(name).cast("string")
    return [r[0] for r in df.where(col(name).isNotNull()).select(text).distinct().orderBy(text).limit(n).collect()]


def _moments(long: DataFrame, key: str = "g") -> dict[str, tuple[int, float, float]]:
    rows = long.groupBy(key).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s")).collect()
    return {r[key]: (r["n"], r["m"], r["s"] or 0.0) for r in rows}


def t_test(df: DataFrame, a: str, b: str, alpha: float = 0.05, groups: Sequence[Any] | None = None) -> dict[str, Any]:
    """Welch's test of two means with Cohen's d."""
    names, long = _two_groups(df, a, b, groups)
    moments = _moments(long)
    if any(moments.get(g, (0,))[0] < 2 for g in names):
        raise ValueError("each group needs at least two values")
    (n1, m1, v1), (n2, m2, v2) = (moments[g] for g in names)
    error = v1 / n1 + v2 / n2
    statistic = (m1 - m2) / math.sqrt(error) if error else math.copysign(math.inf, m1 - m2) if m1 != m2 else 0.0
    dof = error**2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) if error else n1 + n2 - 2
    p = t_two_sided(session_of(df), statistic, dof)
    pooled = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / max(1, n1 + n2 - 2))
    d = abs(m1 - m2) / pooled if pooled else 0.0
    band = "Large" if d >= 0.8 else "Medium" if d >= 0.5 else "Small"
    return {"test": "t_test", "statistic": statistic, "p_value": p, "dof": dof, "effect_size": d, "band": band,
            "significant": p < alpha, "groups": {g: moments[g][:2] for g in names}}


def mann_whitney(
    df: DataFrame, a: str, b: str, alpha: float = 0.05, groups: Sequence[Any] | None = None
) -> dict[str, Any]:
    """Two-sided rank test; exact for a group of at most 8 without ties, else normal with corrections.

    Ranks are taken over distinct values, so ties need no sort of equal rows, and the running count
    is carried across blocks where the distinct values do not fit one task.
    """
    names, long = _two_groups(df, a, b, groups)
    counts = long.groupBy("v").agg(F.count(F.lit(1)).alias("n"),
                                   F.count_if(F.col("g") == names[0]).alias("n1"))
    run = Ordered(counts, ["v"])
    run.running_sum("n", "_upto")
    n = F.col("n").cast("double")
    rank = F.col("_upto") - n + (n + 1) / 2
    row = run.df.agg(F.sum(F.col("n1") * rank).alias("r1"), F.sum("n1").alias("n1"), F.sum("n").alias("n"),
                     F.sum(n * n * n - n).alias("ties")).first()
    n1, total = row["n1"] or 0, row["n"] or 0
    n2 = total - n1
    if n1 < 2 or n2 < 2:
        raise ValueError("each group needs at least two values")
    u = row["r1"] - n1 * (n1 + 1) / 2
    if min(n1, n2) <= 8 and row["ties"] == 0:
        p = _exact_u(n1, n2, u)
    else:
        spread = n1 * n2 / 12 * ((total + 1) - row["ties"] / (total * (total - 1)))
        apart = max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5
        p = min(1.0, normal_two_sided(apart / math.sqrt(spread))) if spread > 0 and apart > 0 else 1.0
    return {"test": "mann_whitney", "statistic": u, "p_value": p, "effect_size": u, "significant": p < alpha,
            "groups": {names[0]: n1, names[1]: n2}}


# cells of the table of rank sums that the driver fills at most (160 MB)
RANK_CELLS = 20_000_000


def _exact_u(n1: int, n2: int, u: float) -> float:
    """Two-sided p from the number of arrangements for every rank sum; the smaller group has at most 8 rows.

    The counts are the coefficients of a Gaussian binomial, built up one row of the small group at a time:
    times (1 - q^(n2 + i)), divided by (1 - q^i). Only the tail is built. Where even that is too long, the
    second group is so large that its ranks are a continuum: a sum of n1 uniform draws.
    """
    n1, n2 = min(n1, n2), max(n1, n2)
    reach = n1 * n2 - math.ceil(max(u, n1 * n2 - u) - 1e-9)
    if reach >= RANK_CELLS:
        x = (reach + 0.5 + n1 * (n1 + 1) / 4) / (n2 + (n1 + 1) / 2)
        parts = [(-1) ** k * math.comb(n1, k) * (x - k) ** n1 for k in range(math.floor(x) + 1)]
        return min(1.0, 2.0 * math.fsum(parts) / math.factorial(n1))
    ways = np.zeros(reach + 1)
    ways[0] = 1.0
    for i in range(1, n1 + 1):
        if n2 + i <= reach:
            ways[n2 + i :] -= ways[: reach + 1 - n2 - i].copy()
        for start in range(i):
            ways[start::i] = np.cumsum(ways[start::i])
    return min(1.0, 2.0 * float(ways.sum()) / math.comb(n1 + n2, n1))


def anova(df: DataFrame, a: str, b: str, alpha: float = 0.05, groups: Sequence[Any] | None = None) -> dict[str, Any]:
    """One-way analysis of variance over all categories with at least two values, or over those named.

    Moments per category stay in Spark, so any number of categories can take part.
    """
    text = col(b).cast("string")
    rows = df.where(text.isNotNull()) if groups is None else df.where(text.isin([str(g) for g in groups]))
    long = rows.select(text.alias("g"), as_double(df, a).alias("v")).where("v IS NOT NULL")
    moments = long.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s")).where("n >= 2")
    total = moments.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    gap = F.col("m") - F.col("grand")
    row = moments.crossJoin(F.broadcast(total.select("grand"))).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * gap * gap).alias("between"),
        F.sum((F.col("n") - 1) * F.col("s")).alias("within")).first()
    if row["k"] < 2:
        raise ValueError("at least two groups need two values each")
    d1, d2 = row["k"] - 1, row["n"] - row["k"]
    between, within = row["between"], row["within"]
    statistic = (between / d1) / (within / d2) if within > 0 and d2 > 0 else 0.0
    p = f_upper(session_of(df), statistic, d1, d2) if within > 0 and d2 > 0 else 1.0
    return {"test": "anova", "statistic": statistic, "p_value": p, "effect_size": statistic, "groups": row["k"],
            "significant": p < alpha}


def chi_square(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> dict[str, Any]:
    """Test of independence with Cramér's V."""
    statistic, dof, n, r, c = independence(df, a, b)
    p = chi_square_upper(session_of(df), statistic, dof)
    k = min(r - 1, c - 1)
    v = math.sqrt(statistic / n / k) if k > 0 and n else 0.0
    band = "Strong" if v >= 0.3 else "Moderate" if v >= 0.15 else "Weak"
    return {"test": "chi_square", "statistic": statistic, "p_value": p, "dof": dof, "effect_size": v, "band": band,
            "significant": p < alpha}


TESTS = {"t_test": t_test, "mann_whitney": mann_whitney, "anova": anova, "chi_square": chi_square}


def run_test(df: DataFrame, kind: str, a: str, b: str, alpha: float = 0.05) -> dict[str, Any]:
    if kind not in TESTS:
        raise ValueError(f"unknown test {kind!r}; use one of {sorted(TESTS)}")
    return TESTS[kind](df, a, b, alpha)


def result_table(df: DataFrame, results: Sequence[dict[str, Any]], digits: int = 4) -> DataFrame:
    rows = [(r["test"], round(float(r["statistic"]), digits), float(r["p_value"]), round(float(r["effect_size"]), digits),
             bool(r["significant"])) for r in results]
    return df.sparkSession.createDataFrame(
        rows, "test string, statistic double, p_value double, effect_size double, significant boolean")
