"""Projection, naming, sorting, paging, top-k, sampling and union."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col, cols, distinct_names, present, require, snake
from millrace.operators.ordered import number_rows
from millrace.operators.quantiles import exact_quantiles


class Preview(NamedTuple):
    rows: DataFrame
    total: int


def preview(df: DataFrame, limit: int = 50, columns: Sequence[str] | None = None) -> Preview:
    """First rows of some columns plus the full row count."""
    shown = df.select(*cols(present(df, columns))) if columns else df
    return Preview(shown.limit(limit), df.count())


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.toDF(*[mapping.get(n, n) for n in df.columns])


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*cols(n for n in df.columns if n not in set(names)))


_CASINGS = {
    "snake_case": snake,
    "uppercase": lambda n: n.strip().upper(),
    "lowercase": lambda n: n.strip().lower(),
}


def clean_names(df: DataFrame, casing: str = "snake_case") -> DataFrame:
    """Rewrite every column name; names that collide get a numeric suffix."""
    rule = _CASINGS.get(casing, str.strip)
    return df.toDF(*distinct_names([rule(n) for n in df.columns]))


def sort_rows(df: DataFrame, by: str | Sequence[str], ascending: bool = False) -> DataFrame:
    """One direction for all columns, missing values last either way."""
    names = present(df, [by] if isinstance(by, str) else by)
    if not names:
        raise ValueError(f"sort columns not found: {by}")
    keys = [col(n).asc_nulls_last() if ascending else col(n).desc_nulls_last() for n in names]
    return df.orderBy(*keys)


def natural_keys(name: str, ascending: bool = True) -> list[Column]:
    """Sort keys that compare number-like text as numbers and put empty cells last."""
    text = col(name).cast("string")
    amount = F.trim(text).try_cast("double")
    empty = (text.isNull() | (text == "")).cast("int").asc()
    if ascending:
        return [empty, amount.isNull().cast("int").asc(), amount.asc_nulls_last(), text.asc_nulls_last()]
    return [empty, amount.isNull().cast("int").desc(), amount.desc_nulls_last(), text.desc_nulls_last()]


def sort_natural(df: DataFrame, name: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(*natural_keys(name, ascending))


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int = 25) -> DataFrame:
    """Slice ``number`` (0-based) of a sorted table."""
    return df.orderBy(*order).offset(number * size).limit(size)


AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "avg": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.count_distinct,
}


def top_groups(
    df: DataFrame,
    category: str,
    measure: str,
    function: str = "sum",
    n: int = 10,
    ascending: bool = False,
) -> DataFrame:
    """The n categories with the largest (or smallest) aggregate; ties go by name."""
    require(df, [category, measure])
    grouped = df.where(col(category).isNotNull()).groupBy(col(category))
    table = grouped.agg(AGGREGATES[function](col(measure)).alias(measure))
    value = col(measure).asc_nulls_last() if ascending else col(measure).desc_nulls_last()
    return table.orderBy(value, col(category)).limit(n)


def top_frequent(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    counts = df.where(col(name).isNotNull()).groupBy(col(name)).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), col(name)).limit(n)


def top_values(df: DataFrame, name: str, n: int = 10, ascending: bool = False) -> DataFrame:
    key = col(name).asc() if ascending else col(name).desc()
    return df.select(col(name)).where(col(name).isNotNull()).orderBy(key).limit(n)


def last_rows(df: DataFrame, order: Sequence[str], n: int = 5, complete: Sequence[str] = ()) -> DataFrame:
    """The last n rows of an explicit order, in that order."""
    require(df, order)
    kept = df.dropna(subset=list(complete)) if complete else df
    return kept.orderBy(*[col(o).desc() for o in order]).limit(n).orderBy(*cols(order))


def _draw(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*cols(keys), F.lit(seed))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same ones on every run and engine: the n smallest MD5 of key and seed."""
    require(df, keys)
    draw = F.md5(F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))
    order = df.withColumn("_draw", draw).orderBy("_draw", *cols(keys)).limit(n)
    return order.drop("_draw")


def _ranked_in_class(df: DataFrame, label: str, keys: Sequence[str], seed: int) -> DataFrame:
    """``df`` with the place of a row in its class by key hash (_rank) and the class's size (_size)."""
    drawn = df.withColumn("_draw", F.pmod(_draw(keys, seed), F.lit(1 << 52)).cast("double"))
    ranked = number_rows(drawn, ["_draw", *keys], [label], "_rank").drop("_draw")
    sizes = df.groupBy(col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_size"))
    return ranked.join(sizes, col(label).eqNullSafe(F.col("_class"))).drop("_class")


def sample_stratified(
    df: DataFrame, label: str, keys: Sequence[str], n: int, seed: int = 42
) -> DataFrame:
    """About n rows with the class shares of the whole table; all rows when the table is smaller.

    A class keeps the rows with its smallest key hashes, so class sizes are right to the row, whatever
    their number; classes too large for one task are ranked block by block.
    """
    require(df, [label, *keys])
    total = df.count()
    if total <= n:
        return df
    share = F.bround(F.col("_size") * n / F.lit(total))
    return _ranked_in_class(df, label, keys, seed).where(F.col("_rank") <= share).select(*cols(df.columns))


def split_train_test(
    df: DataFrame, keys: Sequence[str], label: str | None = None, test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Mark each row ``is_test``; with a label the share is exact in every class."""
    require(df, keys)
    if label is None:
        tagged = df.withColumn("_draw", F.pmod(_draw(keys, seed), F.lit(1 << 52)).cast("double"))
        cut = exact_quantiles(tagged, {"_draw": [test]})["_draw"][0]
        return tagged.withColumn("is_test", F.col("_draw") <= cut).drop("_draw")
    last = F.floor(F.lit(test) * (F.col("_size") - 1)) + 1
    ranked = _ranked_in_class(df, label, keys, seed).withColumn("is_test", F.col("_rank") <= last)
    return ranked.select(*cols(df.columns), "is_test")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Append by column name; a column one side lacks becomes NULL there."""
    if not frames:
        raise ValueError("union needs at least one input")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def top_n_with_other(
    df: DataFrame, category: str, measure: str | None, function: str = "sum", n: int = 10
) -> DataFrame:
    """(label, value) of the n largest groups plus one ``Other`` row for the rest."""
    value = F.count(F.lit(1)) if measure is None or function == "count" else AGGREGATES[function](col(measure))
    kept = df.where(col(category).isNotNull())
    if measure is not None:
        kept = kept.where(col(measure).isNotNull())
    groups = kept.groupBy(col(category).cast("string").alias("label")).agg(value.cast("double").alias("value"))
    top = groups.orderBy(F.desc("value"), "label").limit(n)
    rest = groups.join(F.broadcast(top.select("label")), "label", "left_anti")
    folded = rest.agg((F.avg if function == "mean" else F.sum)("value").alias("value"))
    other = folded.where(F.col("value").isNotNull()).select(F.lit("Other").alias("label"), "value")
    return top.unionByName(other).select("label", F.round("value", 2).alias("value"))
