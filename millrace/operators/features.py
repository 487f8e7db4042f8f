"""Scaling, encoding, casting and structural clean-up of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import as_double, col, cols, is_numeric, is_text, missing, text_names, type_of
from millrace.functions.dates import parse_mixed
from millrace.functions.text import strip
from millrace.operators.ordered import number_rows
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.shape import clean_names
from millrace.operators.stats import column_stats
from millrace.session import driver_rows, session_of


def scale(
    df: DataFrame,
    names: Sequence[str],
    method: str = "robust",
    quantile_low: float = 25.0,
    quantile_high: float = 75.0,
    scale_min: float = 0.0,
    scale_max: float = 1.0,
) -> DataFrame:
    """Robust, standard or min-max scaling; a zero spread counts as 1."""
    names = [n for n in names if is_numeric(df, n)]
    changes: dict[str, Column] = {}
    if method == "robust":
        probs = [0.5, quantile_low / 100.0, quantile_high / 100.0]
        for name, (middle, low, high) in exact_quantiles(df, {n: probs for n in names}).items():
            if middle is not None:
                spread = high - low if high > low else 1.0
                changes[name] = (as_double(df, name) - middle) / spread
    elif method in ("standard", "minmax"):
        for name, s in column_stats(df, names).items():
            if s.known == 0:
                continue
            if method == "standard":
                changes[name] = (as_double(df, name) - s.mean) / (s.std or 1.0)
            else:
                spread = s.high - s.low or 1.0
                unit = (as_double(df, name) - s.low) / spread
                changes[name] = unit * (scale_max - scale_min) + scale_min
    else:
        raise ValueError(f"unknown scaler {method!r}")
    return df.withColumns(changes) if changes else df


def categories(df: DataFrame, name: str) -> list[tuple[object, int]]:
    """Sorted categories with counts; a column with more of them than the driver may hold is refused."""
    limit = driver_rows(session_of(df))
    counts = df.where(col(name).isNotNull()).groupBy(col(name)).count()
    rows = counts.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"column {name!r} has more than {limit} categories")
    return sorted(((r[0], r["count"]) for r in rows), key=lambda pair: pair[0])


def one_hot(df: DataFrame, name: str, drop_first: bool = False, min_freq: float = 0.0) -> DataFrame:
    """One boolean column per category; categories rarer than ``min_freq`` become ``Other``."""
    found = categories(df, name)
    value = col(name)
    if min_freq > 0:
        total = sum(n for _, n in found)
        rare = [v for v, n in found if n / total < min_freq]
        if rare:
            value = F.when(col(name).isin(rare), F.lit("Other")).otherwise(col(name).cast("string"))
            kept = {str(v) for v, _ in found if v not in set(rare)} | {"Other"}
            found = [(v, 0) for v in sorted(kept)]
    levels = [v for v, _ in found][1 if drop_first else 0 :]
    dummies = [F.coalesce(value == F.lit(v), F.lit(False)).alias(f"{name}_{v}") for v in levels]
    return df.select(*cols(n for n in df.columns if n != name), *dummies)


def ordinal(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """0-based code of each value in sorted order, −1 for a missing one.

    The code table is joined in; it is broadcast only when its size allows.
    """
    out = df
    for name in names:
        limit = driver_rows(session_of(df))
        levels = df.where(col(name).isNotNull()).select(col(name)).distinct()
        rows = levels.limit(limit + 1).collect()
        if len(rows) <= limit:
            spark = session_of(df)
            ranked = [(v, i) for i, v in enumerate(sorted(r[0] for r in rows))]
            kind = T.StructType([T.StructField("_v", type_of(df, name)), T.StructField("_code", T.IntegerType())])
            table = F.broadcast(spark.createDataFrame(ranked, kind))
        else:
            numbered = number_rows(levels, [name], name="_code")
            table = numbered.select(col(name).alias("_v"), (F.col("_code") - 1).cast("int").alias("_code"))
        joined = out.join(table, col(name) == F.col("_v"), "left")
        out = joined.withColumn(name, F.coalesce(F.col("_code"), F.lit(-1))).drop("_v", "_code")
    return out


def cast_lenient(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Cleaning casts: values that do not convert become NULL (0 for int)."""
    changes: dict[str, Column] = {}
    for name in names:
        c = col(name)
        if target == "float":
            changes[name] = as_double(df, name)
        elif target == "int":
            changes[name] = F.coalesce(as_double(df, name).try_cast("bigint"), F.lit(0).cast("bigint"))
        elif target == "datetime":
            changes[name] = parse_mixed(c) if is_text(df, name) else c.try_cast("timestamp")
        elif target == "string" or target == "category":
            changes[name] = c.cast("string")
        elif target == "bool":
            text = is_text(df, name)
            changes[name] = (c != "") if text else c.cast("double") != 0
        else:
            raise ValueError(f"unknown cast {target!r}")
    return df.withColumns(changes)


def cast_strict(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """SQL casts of a procedure node: bad data fails the job."""
    words = {"varchar": "string", "text": "string", "integer": "int", "hugeint": "decimal(38,0)"}
    return df.withColumns({n: col(n).cast(words.get(k.lower(), k)) for n, k in casts.items() if n in df.columns})


def structural_clean(df: DataFrame) -> tuple[DataFrame, list[str], int]:
    """Snake names, distinct rows, trimmed text, no empty rows, typed text columns.

    One job decides everything (two when rows repeat); the result is returned with its row count.
    """
    actions = []
    named = clean_names(df)
    renamed = sum(a != b for a, b in zip(df.columns, named.columns))
    if renamed:
        actions.append(f"Renamed {renamed} column(s) to snake_case")
    texts = text_names(named)
    trimmed = {n: strip(col(n)) for n in texts}
    empty = F.lit(True)
    for name in named.columns:
        empty = empty & missing(named, name)
    full = ~empty

    def measures() -> list[Column]:
        picks = [F.count(F.lit(1)).alias("kept"), F.count_if(empty).alias("hollow")]
        for i, name in enumerate(texts):
            value = trimmed[name]
            picks += [F.count_if(full & value.try_cast("double").isNotNull()).alias(f"n{i}"),
                      F.count_if(full & parse_mixed(value).isNotNull()).alias(f"d{i}")]
        return picks

    # row hashes tell whether any row repeats; whole rows are shuffled only when some do
    hashes = F.count_distinct(F.xxhash64(*cols(named.columns)), F.hash(*cols(named.columns)))
    row = named.agg(*measures(), hashes.alias("unlike")).first()
    rows = row["kept"]
    if row["unlike"] < rows:
        row = named.distinct().agg(*measures()).first()
    repeats, left = rows - row["kept"], row["kept"] - row["hollow"]
    out = named.distinct() if repeats else named
    if repeats:
        actions.append(f"Removed {repeats:,} duplicate row(s)")
    if texts:
        out = out.withColumns(trimmed)
        actions.append(f"Stripped whitespace from {len(texts)} string column(s)")
    if row["hollow"]:
        out = out.where(full)
        actions.append(f"Removed {row['hollow']} fully-empty row(s)")
    share = 0.85 * left
    numbers = [n for i, n in enumerate(texts) if left and row[f"n{i}"] > share]
    dates = [n for i, n in enumerate(texts) if n not in numbers and left and row[f"d{i}"] > share]
    out = out.withColumns({n: col(n).try_cast("double") for n in numbers} | {n: parse_mixed(col(n)) for n in dates})
    actions += [f"Coerced '{n}' to numeric" for n in numbers] + [f"Parsed '{n}' as datetime" for n in dates]
    return out, actions or ["Nothing to change in the structure"], left
