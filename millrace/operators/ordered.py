"""Operators over an explicit row order: numbering, carries, fills and running sums.

Spark rows have no order of their own, so every call names one. A window over one partition runs
in one task; where a partition is too large for that, rows are range-partitioned into blocks of
bounded size, each block is solved alone, and a table with one row per block carries the running
state from block to block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.columns import col, cols, is_numeric, quoted, require
from millrace.session import materialize, session_of, task_rows

BLOCK = "_block"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; partial aggregation keeps hot keys cheap."""
    if not keys:
        return df.count()
    return df.groupBy(*cols(keys)).count().agg(F.max("count")).first()[0] or 0


class Ordered:
    """A frame plus its order, cut into blocks only where one task could not hold a partition."""

    def __init__(self, df: DataFrame, order: Sequence[str], partition: Sequence[str] = ()):
        if not order:
            raise ValueError("an order column is required: Spark rows have no order of their own")
        require(df, [*order, *partition])
        self.order = list(order)
        self.partition = list(partition)
        limit = task_rows(session_of(df))
        self.blocked = largest_group(df, self.partition) > limit
        if self.blocked:
            blocks = max(2, math.ceil(df.count() / limit))
            ranged = df.repartitionByRange(blocks, *cols(self.partition), *cols(self.order))
            df = materialize(ranged.withColumn(BLOCK, F.spark_partition_id()))
        self.df = df

    def _groups(self) -> list[str]:
        return [*self.partition, BLOCK] if self.blocked else self.partition

    def window(self, start: int, end: int) -> WindowSpec:
        keys = cols(self._groups()) or [F.lit(0)]
        return Window.partitionBy(*keys).orderBy(*cols(self.order)).rowsBetween(start, end)

    def before(self) -> WindowSpec:
        return self.window(Window.unboundedPreceding, Window.currentRow)

    def after(self) -> WindowSpec:
        """Rows from the end back to the current one: a growing frame, unlike one that shrinks."""
        keys = cols(self._groups()) or [F.lit(0)]
        back = Window.partitionBy(*keys).orderBy(*[c.desc() for c in cols(self.order)])
        return back.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def with_carry(
        self,
        summaries: dict[str, Column],
        carry: Callable[[str, WindowSpec], Column],
        forward: bool = True,
    ) -> None:
        """Attach, per row, what the earlier (or later) blocks of its partition add up to."""
        if not self.blocked:
            return
        direction = F.col(BLOCK).asc() if forward else F.col(BLOCK).desc()
        keys = cols(self.partition) or [F.lit(0)]
        past = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
        table = self.df.groupBy(*cols(self._groups())).agg(
            *[expr.alias(name) for name, expr in summaries.items()]
        )
        table = table.select(
            *[col(k).alias(f"_j{i}") for i, k in enumerate(self._groups())],
            *[carry(name, past).alias(name) for name in summaries],
        )
        if not self.partition:
            table = F.broadcast(table)  # a row per block; else the join would move all rows once more
        on = [self.df[quoted(k)].eqNullSafe(table[f"_j{i}"]) for i, k in enumerate(self._groups())]
        self.df = self.df.join(table, on, "left").drop(*[f"_j{i}" for i in range(len(self._groups()))])

    def number(self, name: str) -> None:
        """1-based position in the whole partition."""
        local = F.row_number().over(
            Window.partitionBy(*(cols(self._groups()) or [F.lit(0)])).orderBy(*cols(self.order))
        )
        if not self.blocked:
            self.df = self.df.withColumn(name, local.cast("long"))
            return
        self.with_carry({"_offset": F.count(F.lit(1))}, lambda n, w: F.sum(n).over(w))
        total = local + F.coalesce(F.col("_offset"), F.lit(0))
        self.df = self.df.withColumn(name, total.cast("long")).drop("_offset")

    def running_sum(self, value: str, name: str) -> None:
        local = F.sum(col(value)).over(self.before())
        if not self.blocked:
            self.df = self.df.withColumn(name, local)
            return
        self.with_carry({"_offset": F.sum(col(value))}, lambda n, w: F.sum(n).over(w))
        self.df = self.df.withColumn(name, local + F.coalesce(F.col("_offset"), F.lit(0))).drop("_offset")

    def nearest(self, source: Column, name: str, position: str, forward: bool = True) -> None:
        """Struct (pos, val) of the last known value at or before (forward) or after each row."""
        held = F.when(source.isNotNull(), F.struct(col(position).alias("pos"), source.alias("val")))
        local = F.last(held, ignorenulls=True).over(self.before() if forward else self.after())
        if not self.blocked:
            self.df = self.df.withColumn(name, local)
            return
        edge = F.max(held) if forward else F.min(held)
        self.with_carry({"_edge": edge}, lambda n, w: F.last(F.col(n), ignorenulls=True).over(w), forward)
        self.df = self.df.withColumn(name, F.coalesce(local, F.col("_edge"))).drop("_edge")

    def result(self, names: Sequence[str]) -> DataFrame:
        return self.df.select(*cols(names))


def number_rows(
    df: DataFrame, order: Sequence[str], partition: Sequence[str] = (), name: str = "row_no"
) -> DataFrame:
    run = Ordered(df, order, partition)
    run.number(name)
    return run.result([*df.columns, name])


def running_total(
    df: DataFrame, value: str, order: Sequence[str], partition: Sequence[str] = (), name: str = "total"
) -> DataFrame:
    run = Ordered(df, order, partition)
    run.running_sum(value, name)
    return run.result([*df.columns, name])


def fill(
    df: DataFrame,
    names: Sequence[str],
    order: Sequence[str],
    partition: Sequence[str] = (),
    forward: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Carry the last (or next) known value into gaps, at most ``limit`` rows far."""
    require(df, names)
    run = Ordered(df, order, partition)
    run.number("_pos")
    for name in names:
        run.nearest(col(name), "_near", "_pos", forward)
        value = F.col("_near.val")
        if limit:
            value = F.when(F.abs(F.col("_pos") - F.col("_near.pos")) <= limit, value)
        run.df = run.df.withColumn(name, F.coalesce(col(name), value)).drop("_near")
    return run.result(df.columns)


def interpolate(
    df: DataFrame,
    names: Sequence[str],
    order: Sequence[str],
    partition: Sequence[str] = (),
    direction: str = "both",
) -> DataFrame:
    """Linear interpolation by row position; the edges take the nearest known value."""
    require(df, names)
    bad = [n for n in names if not is_numeric(df, n)]
    if bad:
        raise ValueError(f"interpolation needs numeric columns: {bad}")
    run = Ordered(df, order, partition)
    run.number("_pos")
    for name in names:
        value = col(name).cast("double")
        run.nearest(value, "_prev", "_pos", True)
        run.nearest(value, "_next", "_pos", False)
        prev, nxt = F.col("_prev"), F.col("_next")
        share = F.try_divide(F.col("_pos") - prev["pos"], nxt["pos"] - prev["pos"])
        between = prev["val"] + (nxt["val"] - prev["val"]) * share
        tail = prev["val"] if direction in ("both", "forward") else F.lit(None).cast("double")
        head = nxt["val"] if direction in ("both", "backward") else F.lit(None).cast("double")
        gap = F.when(prev.isNull(), head).when(nxt.isNull(), tail).otherwise(between)
        run.df = run.df.withColumn(name, F.coalesce(value, gap)).drop("_prev", "_next")
    return run.result(df.columns)


def split_halves(
    df: DataFrame, order: Sequence[str], partition: Sequence[str] = (), name: str = "half"
) -> DataFrame:
    """Label the first n//2 ordered rows 1 and the rest 2."""
    run = Ordered(df, order, partition)
    run.number("_pos")
    if run.partition:
        sizes = df.groupBy(*cols(run.partition)).agg(F.count(F.lit(1)).alias("_n"))
        out = run.df.join(sizes, run.partition)
    else:
        out = run.df.withColumn("_n", F.lit(df.count()))
    label = F.when(F.col("_pos") <= F.floor(F.col("_n") / 2), 1).otherwise(2)
    return out.withColumn(name, label).select(*cols(df.columns), name)
