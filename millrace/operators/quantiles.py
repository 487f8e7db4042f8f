"""Exact quantiles that never hold an unbounded group in one task.

``percentile`` keeps one hash map per group, so it serves only small groups. Otherwise a sketch
(``percentile_approx``, bounded size, map-side combine) brackets the wanted rank, and one more pass
counts the rows below the bracket and gathers the few values strictly inside it. Where even the
bracket would hold too many rows it is narrowed by counting: each pass counts rows in equal-width
slices and keeps the slice with the wanted rank. A group with a third of all rows is no slower than
an even spread on any of these paths.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import as_double, cols, quoted
from millrace.session import driver_rows, session_of, task_rows

SLICES = 2048
# accuracy of the sketch, and how many times its rank error a bracket may span
SKETCH = 10_000
BRACKET_SHARE = 8
# groups up to this size are sorted out by the built-in exact percentile; well above the sketch
# accuracy, so that in larger groups the ranks a bracket asks for lie apart
PLAIN_ROWS = 100_000


def quantile_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long form (name, v) of numeric columns, missing values dropped."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), as_double(df, n).alias("v")) for n in names])
    return df.select(F.inline(pairs)).where("v IS NOT NULL")


def _bracket_probs(probs: Sequence[float]) -> list[float]:
    """Sketch ranks that surely enclose each wanted rank."""
    margin = 2.0 / SKETCH
    return [min(1.0, max(0.0, p + side * margin)) for p in probs for side in (-1, 1)]


def _positions(p: float, n: int) -> tuple[int, int, float]:
    at = p * (n - 1)
    return math.floor(at), math.ceil(at), at - math.floor(at)


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, Sequence[float]],
    rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of several numeric columns; two jobs, one for a small table."""
    wanted = {n: [float(p) for p in ps] for n, ps in wanted.items() if ps}
    if not wanted:
        return {}
    spark = session_of(df)
    limit = task_rows(spark)
    if rows is not None and rows <= min(PLAIN_ROWS, limit):
        picks = [F.percentile(as_double(df, n), F.array(*[F.lit(p) for p in ps])) for n, ps in wanted.items()]
        row = df.agg(*picks).first()
        return {n: list(row[i]) if row[i] is not None else [None] * len(ps)
                for i, (n, ps) in enumerate(wanted.items())}
    plain = min(PLAIN_ROWS, limit)
    view = df.select(*[as_double(df, n).alias(f"v{i}") for i, n in enumerate(wanted)])
    picks = []
    for i, ps in enumerate(wanted.values()):
        probs = F.array(*[F.lit(p) for p in _bracket_probs(ps)])
        picks += [F.count(f"v{i}").alias(f"n{i}"), F.approx_count_distinct(f"v{i}").alias(f"d{i}"), F.percentile_approx(f"v{i}", probs, SKETCH).alias(f"s{i}"),
                  F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}")]
    sketch = view.agg(*picks).first()
    out: dict[str, list[float | None]] = {n: [None] * len(ps) for n, ps in wanted.items()}
    brackets, large, small = {}, {}, {}
    for i, (name, ps) in enumerate(wanted.items()):
        n = sketch[f"n{i}"]
        if n and min(n, sketch[f"d{i}"]) <= plain:
            # few distinct values: the built-in map is small, whatever the number of rows
            small[name] = F.percentile(f"v{i}", F.array(*[F.lit(p) for p in ps])).alias(f"q{i}")
        elif n and BRACKET_SHARE * n / SKETCH > limit:
            large[name] = ps
        elif n:
            for k, p in enumerate(ps):
                low = sketch[f"lo{i}"] if p <= 2.0 / SKETCH else sketch[f"s{i}"][2 * k]
                high = sketch[f"hi{i}"] if p >= 1 - 2.0 / SKETCH else sketch[f"s{i}"][2 * k + 1]
                brackets[(i, name, k, p, n)] = (low, high)
    if small:
        row = view.agg(*small.values()).first()
        out |= {name: list(row[b]) for b, name in enumerate(small)}
    for part in _within_budget(brackets, limit):
        counts, picks = [], []
        for b, ((i, *_), (low, high)) in enumerate(part):
            counts += [c.alias(f"{k}{b}") for k, c in _around(F.col(f"v{i}"), F.lit(low), F.lit(high)).items()]
        for b, ((_, _, _, p, n), (low, high)) in enumerate(part):
            first, second, _ = _positions(p, n)
            picks += [_ranked_around(b, F.lit(r), F.lit(low), F.lit(high)).alias(f"{c}{b}") for c, r in (("x", first), ("y", second))]
        # the ranks are picked where the values are: two numbers for each bracket leave Spark
        row = view.agg(*counts).select(*picks).first()
        for b, ((_, name, k, p, n), _) in enumerate(part):
            x, y, share = row[f"x{b}"], row[f"y{b}"], _positions(p, n)[2]
            if x is None or y is None:
                large[name] = wanted[name]
            else:
                out[name][k] = x + (y - x) * share
    if large:
        long = quantile_table(df, list(large))
        found = _ranked(long, ["name"], {(n,): ps for n, ps in large.items()})
        out |= {n: found.get((n,), [None] * len(ps)) for n, ps in large.items()}
    return out


def _within_budget(brackets: dict, limit: int) -> list[list]:
    """Brackets in groups whose inside values together stay within the rows of one task."""
    parts, held = [], 0.0
    for key, ends in brackets.items():
        expected = BRACKET_SHARE * key[4] / SKETCH
        if not parts or held + expected > limit:
            parts.append([])
            held = 0.0
        parts[-1].append((key, ends))
        held += expected
    return parts


def _ranked_around(b: int, rank: Column, low: Column, high: Column) -> Column:
    """Value of a rank from the aggregates of bracket ``b``; NULL when the rank lies outside it."""
    place = rank - F.col(f"below{b}")
    after = place - F.col(f"low{b}")
    inside = F.col(f"inside{b}")
    return (F.when(place < 0, F.lit(None).cast("double")).when(after < 0, low)
            .when(after < F.size(inside), F.get(inside, after.cast("int")))
            .when(after - F.size(inside) < F.col(f"high{b}"), high))


def _around(v: Column, low: Column, high: Column) -> dict[str, Column]:
    """Aggregates that locate a rank in [low, high]; equal values at the ends are only counted."""
    return {
        "below": F.count_if(v < low), "low": F.count_if(v == low),
        "high": F.count_if((v == high) & (high > low)),
        "inside": F.sort_array(F.collect_list(F.when((v > low) & (v < high), v))),
    }


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Sequence[float],
    names: Sequence[str],
) -> DataFrame:
    """Quantiles per group by the same three ways, chosen by the size of the groups."""
    spark = session_of(df)
    probs = [float(p) for p in probs]
    data = df.select(*cols(keys), value.cast("double").alias("v"))
    limit = task_rows(spark)
    sizes = data.groupBy(*cols(keys)).agg(F.count("v").alias("n"), F.approx_count_distinct("v").alias("d"))
    huge = limit * SKETCH // BRACKET_SHARE
    distinct, oversized = sizes.agg(F.max(F.least("n", "d")), F.count_if(F.col("n") > huge)).first()
    # the built-in map holds one entry per distinct value
    if (distinct or 0) <= min(PLAIN_ROWS, limit):
        array = F.percentile("v", F.array(*[F.lit(p) for p in probs]))
        packed = data.groupBy(*cols(keys)).agg(array.alias("q"))
        return packed.select(*cols(keys), *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    if not oversized:
        return _bracketed_groups(data, keys, probs, names)
    if oversized > driver_rows(spark):
        raise ValueError("too many oversized groups; raise the task row limit")
    hot_rows = sizes.where(F.col("n") > huge).select(*cols(keys)).collect()
    hot_keys = spark.createDataFrame(hot_rows, sizes.select(*cols(keys)).schema)
    same = [data[quoted(k)].eqNullSafe(hot_keys[quoted(k)]) for k in keys]
    cold = data.join(F.broadcast(hot_keys), same, "left_anti")
    warm = data.join(F.broadcast(hot_keys), same, "left_semi").where("v IS NOT NULL")
    found = _ranked(warm, list(keys), {tuple(r): list(probs) for r in hot_rows})
    schema = T.StructType(
        [data.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in names]
    )
    rows = [key + tuple(values) for key, values in found.items()]
    return _bracketed_groups(cold, keys, probs, names).unionByName(spark.createDataFrame(rows, schema))


def _bracketed_groups(data: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Sketch per group, joined back to gather the values inside each bracket (a bounded number)."""
    wide = F.array(*[F.lit(p) for p in _bracket_probs(probs)])
    sketch = data.groupBy(*cols(keys)).agg(
        F.count("v").alias("n"), F.percentile_approx("v", wide, SKETCH).alias("s"), F.min("v").alias("lo"),
        F.max("v").alias("hi"))
    ends = []
    for k, p in enumerate(probs):
        # a small group is gathered whole: its sketch ranks would not lie apart
        low = F.when((F.col("n") <= PLAIN_ROWS) | F.lit(p <= 2.0 / SKETCH), F.col("lo")).otherwise(F.col("s")[2 * k])
        high = F.when((F.col("n") <= PLAIN_ROWS) | F.lit(p >= 1 - 2.0 / SKETCH), F.col("hi")).otherwise(F.col("s")[2 * k + 1])
        ends += [low.alias(f"lo{k}"), high.alias(f"hi{k}")]
    table = sketch.select(*[F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(keys)], "n", *ends)
    on = [data[quoted(c)].eqNullSafe(table[f"_k{i}"]) for i, c in enumerate(keys)]
    joined = data.join(table, on)
    counts = [F.first("n").alias("n")]
    for k in range(len(probs)):
        low, high = F.col(f"lo{k}"), F.col(f"hi{k}")
        counts += [c.alias(f"{w}{k}") for w, c in _around(F.col("v"), low, high).items()]
        counts += [F.first(low).alias(f"a{k}"), F.first(high).alias(f"b{k}")]
    packed = joined.groupBy(*cols(keys)).agg(*counts)

    def value(k: int, rank: Column) -> Column:
        place = rank - F.col(f"below{k}")
        after = place - F.col(f"low{k}")
        inner = F.get(F.col(f"inside{k}"), after.cast("int"))
        return F.when(after < 0, F.col(f"a{k}")).when(
            after < F.size(F.col(f"inside{k}")), inner).otherwise(F.col(f"b{k}"))

    out = []
    for k, (p, name) in enumerate(zip(probs, names)):
        at = F.lit(p) * (F.col("n") - 1)
        low, high = F.floor(at), F.ceil(at)
        out.append((value(k, low) + (value(k, high) - value(k, low)) * (at - low)).alias(name))
    return packed.select(*cols(keys), *out)


def _ranked(
    long: DataFrame, keys: list[str], wanted: dict[tuple, Sequence[float]]
) -> dict[tuple, list[float | None]]:
    """Interpolated quantiles of ``v`` per key tuple from exact order statistics."""
    spans = {
        tuple(r[k] for k in keys): (r["n"], r["lo"], r["hi"])
        for r in long.groupBy(*cols(keys))
        .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    }
    asked: dict[tuple[tuple, int], list] = {}
    for key, probs in wanted.items():
        if key not in spans:
            continue
        n, lo, hi = spans[key]
        for p in probs:
            position = p * (n - 1)
            for rank in {math.floor(position), math.ceil(position)}:
                asked[(key, rank)] = [rank, lo, hi, n]
    values = _order_statistics(long, keys, asked)
    out: dict[tuple, list[float | None]] = {}
    for key, probs in wanted.items():
        if key not in spans:
            continue
        n = spans[key][0]
        row = []
        for p in probs:
            position = p * (n - 1)
            low, high = values[(key, math.floor(position))], values[(key, math.ceil(position))]
            row.append(low + (high - low) * (position - math.floor(position)))
        out[key] = row
    return out


def _order_statistics(
    long: DataFrame, keys: list[str], asked: dict[tuple[tuple, int], list]
) -> dict[tuple[tuple, int], float]:
    spark = session_of(long)
    finish = max(SLICES, task_rows(spark) // 8)
    done: dict[tuple[tuple, int], float] = {}
    open_ = dict(asked)
    schema = T.StructType(
        [T.StructField("tid", T.IntegerType())]
        + [T.StructField(f"k_{i}", long.schema[k].dataType) for i, k in enumerate(keys)]
        + [
            T.StructField("rank", T.LongType()),
            T.StructField("lo", T.DoubleType()),
            T.StructField("hi", T.DoubleType()),
        ]
    )
    while True:
        for target, (_, lo, hi, _) in list(open_.items()):
            if lo == hi:
                done[target] = lo
                del open_[target]
        if not open_:
            return done
        order = list(open_)
        rows = [(i, *t[0], open_[t][0], open_[t][1], open_[t][2]) for i, t in enumerate(order)]
        targets = spark.createDataFrame(rows, schema)
        match = [long[quoted(k)].eqNullSafe(targets[f"k_{i}"]) for i, k in enumerate(keys)]
        match += [F.col("v") >= F.col("lo"), F.col("v") <= F.col("hi")]
        joined = long.join(F.broadcast(targets), match)
        if all(open_[t][3] <= finish for t in order):
            picked = joined.groupBy("tid", "rank").agg(F.sort_array(F.collect_list("v")).alias("vs"))
            for r in picked.select("tid", F.col("vs")[F.col("rank").cast("int")].alias("v")).collect():
                done[order[r["tid"]]] = r["v"]
            return done
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        sliced = joined.withColumn(
            "slice", F.least(F.lit(SLICES - 1), F.floor(share * SLICES).cast("int"))
        )
        counted = sliced.groupBy("tid", "rank", "slice").agg(
            F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        # at most SLICES rows per target reach this window
        running = F.sum("n").over(Window.partitionBy("tid").orderBy("slice"))
        held = counted.withColumn("upto", running).where("rank < upto AND rank >= upto - n")
        for r in held.collect():
            open_[order[r["tid"]]] = [r["rank"] - (r["upto"] - r["n"]), r["lo"], r["hi"], r["n"]]


def median_split(df: DataFrame, value: Column) -> float | None:
    """Median of one expression, e.g. the microseconds of a date column."""
    view = df.select(value.cast("double").alias("v"))
    return exact_quantiles(view, {"v": [0.5]})["v"][0]
