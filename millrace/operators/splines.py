"""Natural cubic spline through the known points of a series, by row position.

The second derivatives at the known points solve a tridiagonal system. Where a task can hold a series it is
solved there. A longer series is cut into blocks (see ``ordered``): every block is eliminated for its own
right side and for unit values of the unknowns just before and after it, which leaves two equations a block.
That small system, one row per block, gives the unknowns between the blocks, and each block then fills its
gaps. So the series is read twice and nothing but one row per block is ever gathered.

Series that a task can hold are taken many at a time: their systems, side by side, are one tridiagonal system
without couplings between them, so the work a series costs is that of its rows.

Within a block the system is solved by cyclic reduction on arrays; it is diagonally dominant, so this is stable.
Gaps before the first and after the last known point take the nearest known value; a series of one known
point takes it throughout, one of two is a line, one without any keeps its gaps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.columns import as_double, col, cols, is_numeric, require
from millrace.operators.ordered import BLOCK, Ordered
from millrace.session import materialize


def solve_tridiagonal(
    below: np.ndarray, main: np.ndarray, above: np.ndarray, right: np.ndarray, longest: int | None = None
) -> np.ndarray:
    """Solution for every column of ``right``; each step halves the couplings that are left.

    ``longest`` is the size of the largest of several uncoupled systems, where it is known.
    """
    a, b, c, d = below.copy(), main.copy(), above.copy(), right.copy()
    a[:1], c[-1:] = 0.0, 0.0
    step, n = 1, len(b)
    while step < min(n, longest or n):
        low = np.zeros(n)
        high = np.zeros(n)
        low[step:] = -a[step:] / b[:-step]
        high[:-step] = -c[:-step] / b[step:]
        fresh_a, fresh_c, fresh_b, fresh_d = np.zeros(n), np.zeros(n), b.copy(), d.copy()
        fresh_a[step:] = low[step:] * a[:-step]
        fresh_b[step:] += low[step:] * c[:-step]
        fresh_d[step:] += low[step:, None] * d[:-step]
        fresh_c[:-step] = high[:-step] * c[step:]
        fresh_b[:-step] += high[:-step] * a[step:]
        fresh_d[:-step] += high[:-step, None] * d[step:]
        a, b, c, d = fresh_a, fresh_b, fresh_c, fresh_d
        step *= 2
    return d / b[:, None]


def _system(at: np.ndarray, value: np.ndarray, before: tuple | None, after: tuple | None) -> tuple[np.ndarray, ...]:
    """The equations of a block's known points, given the points (position, value) beside the block."""
    x = np.concatenate([[before[0]] if before else [], at, [after[0]] if after else []])
    y = np.concatenate([[before[1]] if before else [], value, [after[1]] if after else []])
    gap, slope = np.diff(x), np.diff(y) / np.diff(x)
    n = len(at)
    below, main, above, right = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    shift = 1 if before else 0  # place of the block's first point in x
    inner = np.arange(0 if before else 1, n if after else n - 1)
    left = inner + shift - 1
    below[inner], above[inner] = gap[left], gap[left + 1]
    main[inner] = 2 * (gap[left] + gap[left + 1])
    right[inner] = 6 * (slope[left + 1] - slope[left])
    return below, main, above, right


def curvatures(at: np.ndarray, value: np.ndarray, before: tuple | None = None, after: tuple | None = None) -> np.ndarray:
    """Second derivatives: own part, and the parts of the unknowns before and after the block, as three columns."""
    below, main, above, right = _system(at, value, before, after)
    sides = np.zeros((len(at), 3))
    sides[:, 0] = right
    sides[0, 1], sides[-1, 2] = -below[0], -above[-1]
    return solve_tridiagonal(below, main, above, sides)


def evaluate(x: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline at positions between the first and the last point."""
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    s, t = (x[i + 1] - at) / h, (at - x[i]) / h
    return s * y[i] + t * y[i + 1] + ((s ** 3 - s) * m[i] + (t ** 3 - t) * m[i + 1]) * h * h / 6


def _filled(at: np.ndarray, value: np.ndarray, before: tuple | None = None, after: tuple | None = None) -> np.ndarray:
    """Values with their gaps filled, outer ones by the nearest known point; sides are (position, value, second derivative)."""
    known = ~np.isnan(value)
    x, y = at[known], value[known]
    if len(x):
        parts = curvatures(x, y, before and before[:2], after and after[:2])
        m = parts[:, 0] + (parts[:, 1] * before[2] if before else 0.0) + (parts[:, 2] * after[2] if after else 0.0)
    else:
        m = np.zeros(0)
    x, y, m = (np.concatenate([[side] if before else [], own, [other] if after else []])
               for side, own, other in zip(before or (0, 0, 0), (x, y, m), after or (0, 0, 0)))
    out = value.copy()
    if len(x) > 1:
        inside = ~known & (at > x[0]) & (at < x[-1])
        out[inside] = evaluate(x, y, m, at[inside])
    if len(x):
        out[~known & (at <= x[0])], out[~known & (at >= x[-1])] = y[0], y[-1]
    return out


def fill_many(series: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The same for whole series one after the other, each with ascending positions; ``series`` numbers them from 0."""
    known = ~np.isnan(value)
    out = value.copy()
    s, x, y = series[known], at[known], value[known]
    if not len(x):
        return out
    n = len(x)
    joined = s[1:] == s[:-1]  # the next known point belongs to the same series
    gap = np.where(joined, np.diff(x), 1.0)
    slope = np.diff(y) / gap
    inner = np.zeros(n, bool)
    inner[1:-1] = joined[1:] & joined[:-1]
    i = np.flatnonzero(inner)
    below, main, above, right = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    below[i], above[i], main[i] = gap[i - 1], gap[i], 2 * (gap[i - 1] + gap[i])
    right[i] = 6 * (slope[i] - slope[i - 1])
    ends = np.flatnonzero(np.append(~joined, True))
    longest = int(np.diff(ends, prepend=-1).max())
    m = solve_tridiagonal(below, main, above, right[:, None], longest)[:, 0]
    empty = np.flatnonzero(~known)
    after = np.cumsum(known)[empty]  # the next known point; the one before it is the last known one
    has_left = (after > 0) & (s[np.maximum(after, 1) - 1] == series[empty])
    has_right = (after < n) & (s[np.minimum(after, n - 1)] == series[empty])
    both, k = empty[has_left & has_right], after[has_left & has_right]
    h = x[k] - x[k - 1]
    l, r = (x[k] - at[both]) / h, (at[both] - x[k - 1]) / h
    out[both] = l * y[k - 1] + r * y[k] + ((l ** 3 - l) * m[k - 1] + (r ** 3 - r) * m[k]) * h * h / 6
    out[empty[has_left & ~has_right]] = y[after[has_left & ~has_right] - 1]
    out[empty[has_right & ~has_left]] = y[after[has_right & ~has_left]]
    return out


def _fill_series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by series and position; ``_pos`` is 1 at the start of a series. The last series of a batch may go on
    in the next, so it waits."""
    waiting: list[pa.RecordBatch] = []

    def solved(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        at = _numbers(table.column("_pos"))
        fresh = fill_many(np.cumsum(at == 1), at, _numbers(table.column("_v")))
        place = table.column_names.index("_v")
        yield from table.set_column(place, "_v", pa.array(fresh, pa.float64(), from_pandas=True)).to_batches()

    for batch in batches:
        starts = np.flatnonzero(_numbers(batch.column("_pos")) == 1)
        if len(starts):
            whole = [*waiting, batch.slice(0, int(starts[-1]))]
            if sum(p.num_rows for p in whole):
                yield from solved(whole)
            waiting = [batch.slice(int(starts[-1]))]
        else:
            waiting.append(batch)
    if waiting:
        yield from solved(waiting)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _side(table: pa.Table, name: str) -> tuple | None:
    first = table.column(name)[0].as_py() if table.num_rows else None
    return None if first is None or first["pos"] is None else tuple(first.values())


def _fill_group(table: pa.Table) -> pa.Table:
    """One series, or one block with the points beside it."""
    table = table.sort_by("_pos")
    sides = [_side(table, n) if n in table.column_names else None for n in ("_before", "_after")]
    fresh = _filled(_numbers(table.column("_pos")), _numbers(table.column("_v")), *sides)
    place = table.column_names.index("_v")
    return table.set_column(place, "_v", pa.array(fresh, pa.float64(), from_pandas=True)).select(
        [n for n in table.column_names if n not in ("_before", "_after")])


def interpolate_spline(
    df: DataFrame, names: Sequence[str], order: Sequence[str], partition: Sequence[str] = ()
) -> DataFrame:
    """Fill inner gaps by the natural cubic spline; the edges take the nearest known value."""
    require(df, names)
    bad = [n for n in names if not is_numeric(df, n)]
    if bad:
        raise ValueError(f"interpolation needs numeric columns: {bad}")
    out = df
    for name in names:
        run = Ordered(out, order, partition)
        run.number("_pos")
        rows = run.df.withColumn("_v", as_double(out, name))
        if run.blocked:
            rows = _with_sides(rows, list(partition))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema
                           if f.name not in ("_before", "_after"))
        if run.blocked:
            filled = rows.groupBy(*cols([*partition, BLOCK])).applyInArrow(_fill_group, schema)
        else:
            # numbering has brought the rows of a series together; sorted by the same columns, they stay in order
            filled = rows.sortWithinPartitions(*cols([*partition, *order]), "_pos").mapInArrow(_fill_series, schema)
        out = filled.withColumn(name, F.col("_v")).select(*cols(df.columns))
    return out


def _between(head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last unknown of each block of a series.

    ``head`` and ``tail`` say how they follow from 1, the last unknown of the block before and the first of the
    block after. Going forward, the last unknown of the blocks so far is written as p + q times the next first one.
    """
    n = len(head)
    u, w, p, q = np.zeros(n), np.zeros(n), np.zeros(n + 1), np.zeros(n + 1)
    for k in range(n):
        rest = 1 - head[k, 1] * q[k]
        u[k], w[k] = (head[k, 0] + head[k, 1] * p[k]) / rest, head[k, 2] / rest
        p[k + 1] = tail[k, 0] + tail[k, 1] * (p[k] + q[k] * u[k])
        q[k + 1] = tail[k, 2] + tail[k, 1] * q[k] * w[k]
    first, last, after = np.zeros(n), np.zeros(n), 0.0
    for k in range(n - 1, -1, -1):
        last[k] = p[k + 1] + q[k + 1] * after
        first[k] = after = u[k] + w[k] * after
    return first, last


def _with_sides(rows: DataFrame, partition: list[str]) -> DataFrame:
    """Each row of a block with the known points (pos, val, second derivative) next to the block on both sides."""
    keys = [*partition, BLOCK]
    whole = cols(partition) or [F.lit(0)]
    past = Window.partitionBy(*whole).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*whole).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cols(keys)).schema)

    def beside(table: DataFrame, sides: DataFrame, *names: str) -> DataFrame:
        picked = sides.select(*[col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *names)
        on = [table[k].eqNullSafe(picked[f"_j{i}"]) for i, k in enumerate(keys)]
        return table.join(picked, on, "left").drop(*[f"_j{i}" for i in range(len(keys))])

    def neighbours(edges: DataFrame, first: str, last: str) -> DataFrame:
        return edges.withColumns({"_before": F.last(last, ignorenulls=True).over(past),
                                  "_after": F.last(first, ignorenulls=True).over(later)})

    def ends(key: tuple, table: pa.Table) -> pa.Table:
        """A block's first and last second derivative as affine functions of those beside it."""
        table = table.sort_by("_pos")
        parts = curvatures(_numbers(table.column("_pos")), _numbers(table.column("_v")),
                           _side(table, "_before"), _side(table, "_after"))
        held = [pa.array([k.as_py()], table.schema.field(n).type) for k, n in zip(key, keys)]
        return pa.table([*held, pa.array([parts[0].tolist()]), pa.array([parts[-1].tolist()])], names=[*keys, "_head", "_tail"])

    def between(table: pa.Table) -> pa.Table:
        table = table.sort_by(BLOCK)
        first, last = _between(*(np.array(table.column(c).to_pylist()).reshape(-1, 3) for c in ("_head", "_tail")))
        return table.select(keys).append_column("_mf", pa.array(first)).append_column("_ml", pa.array(last))

    # what follows is one row per block, but for the two passes over the rows
    point = F.when(F.col("_v").isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col("_v").alias("val")))
    edges = materialize(rows.groupBy(*cols(keys)).agg(F.min(point).alias("_first"), F.max(point).alias("_last")))
    known = beside(rows.where("_v IS NOT NULL").select(*cols(keys), "_pos", "_v"), neighbours(edges, "_first", "_last"),
                   "_before", "_after")
    reduced = known.groupBy(*cols(keys)).applyInArrow(ends, f"{own}, _head array<double>, _tail array<double>")
    solved = reduced.groupBy(*cols(partition)).applyInArrow(between, f"{own}, _mf double, _ml double")

    def bent(name: str, curvature: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(f"{name}.pos", f"{name}.val", F.col(curvature).alias("bend")))

    full = beside(edges, solved, "_mf", "_ml").withColumns({"_f": bent("_first", "_mf"), "_l": bent("_last", "_ml")})
    return beside(rows, materialize(neighbours(full, "_f", "_l")), "_before", "_after")
