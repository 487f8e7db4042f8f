"""Imputation by chained regressions (MICE).

A regression needs only sums of products, and an imputed cell is an affine function of the other cells of its
row. So one pass sums up a Gram matrix for every pattern of gaps, and all rounds run on these few matrices:
re-estimating a column replaces one row of each pattern's map T (from the starting cells to the present ones),
and the sums of products after that are T G T'. The composed maps then fill the table in one pass.

The rounds end when no cell moves by more than the tolerance. The sum of squared moves, which the matrices
give, bounds the largest move from above, and their mean from below; a pass over the rows measures it only where these leave
it open. Tables whose patterns have more cells than the driver may hold take one aggregate per column and round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import as_double, col, is_numeric, missing
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.stats import column_stats, modes
from millrace.session import driver_rows, materialize, session_of

RIDGE = 1e-6
CELLS_PER_ROW = 32  # numbers of a pattern that count as one row of driver state


def _unit(name: str, center: dict[str, float], spread: dict[str, float]) -> Column:
    return (col(name) - center[name]) / spread[name]


def _solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    size = len(right)
    return np.linalg.solve(gram + RIDGE * np.trace(gram) / size * np.eye(size), right)


def impute_mice(
    df: DataFrame, names: Sequence[str], max_iter: int = 10, initial: str = "median", tolerance: float = 1e-3
) -> DataFrame:
    """Fill numeric columns by ridge regressions on one another, fewest gaps first, until they settle."""
    numbers = [n for n in names if is_numeric(df, n)]
    stats = column_stats(df, numbers)
    numbers = [n for n in numbers if stats[n].known]
    gaps = sorted((n for n in numbers if stats[n].nulls), key=lambda n: stats[n].nulls)
    if not gaps:
        return df
    if initial == "mean" or len(numbers) < 2:
        start = {n: stats[n].mean for n in gaps}
    elif initial == "most_frequent":
        start = {n: float(m[0]) for n, m in modes(df, gaps).items()}
    else:
        start = {n: q[0] for n, q in exact_quantiles(df, {n: [0.5] for n in gaps}, stats[gaps[0]].rows).items()}
    work = df.withColumns({f"_gap_{n}": missing(df, n) for n in gaps})
    work = work.withColumns({n: as_double(df, n) for n in numbers})
    work = work.withColumns({n: F.coalesce(col(n), F.lit(v)) for n, v in start.items()})
    if len(numbers) < 2:
        return work.select(*[col(n) for n in df.columns])
    center = {n: stats[n].mean for n in numbers}
    spread = {n: stats[n].std or 1.0 for n in numbers}
    reach = max(max(abs(stats[n].low), abs(stats[n].high)) for n in numbers) or 1.0
    chain = Chain(work, numbers, gaps, center, spread, max_iter, tolerance * reach)
    filled = chain.by_patterns()
    return (chain.by_rounds() if filled is None else filled).select(*[col(n) for n in df.columns])


class Chain:
    """Starting cells, their scale, and the two ways to run the rounds."""

    def __init__(self, work: DataFrame, numbers: list[str], gaps: list[str], center: dict[str, float],
                 spread: dict[str, float], max_iter: int, tolerance: float):
        self.work, self.numbers, self.gaps = work, numbers, gaps
        self.center, self.spread, self.max_iter, self.tolerance = center, spread, max_iter, tolerance
        self.place = {n: i + 1 for i, n in enumerate(numbers)}  # 0 is the constant
        self.pattern = F.concat(*[F.col(f"_gap_{n}").cast("int").cast("string") for n in gaps])

    # ---- all rounds on Gram matrices

    def grams(self) -> dict[str, np.ndarray] | None:
        """Gram matrix of (1, cells) per pattern of gaps; None if they are more than the driver may hold."""
        terms = [F.lit(1.0)] + [_unit(n, self.center, self.spread) for n in self.numbers]
        size = len(terms)
        pairs = list(combinations_with_replacement(range(size), 2))
        most = driver_rows(session_of(self.work)) * CELLS_PER_ROW // (size * size)
        picks = [F.sum(terms[i] * terms[j]).alias(f"p{i}_{j}") for i, j in pairs]
        rows = self.work.groupBy(self.pattern.alias("_pattern")).agg(*picks).limit(most + 1).collect()
        if len(rows) > most:
            return None
        out = {}
        for row in rows:
            gram = np.zeros((size, size))
            for i, j in pairs:
                gram[i, j] = gram[j, i] = row[f"p{i}_{j}"]
            out[row["_pattern"]] = gram
        return out

    def by_patterns(self) -> DataFrame | None:
        start = self.grams()
        if start is None:
            return None
        size = len(self.numbers) + 1
        maps = {p: np.eye(size) for p in start}
        history = [dict(maps)]
        open_rounds = []  # rounds whose largest move the sums leave open
        for number in range(1, self.max_iter + 1):
            for k, name in enumerate(self.gaps):
                target = self.place[name]
                others = [0, *[self.place[n] for n in self.numbers if n != name]]
                whole = reduce(np.add, (maps[p] @ g @ maps[p].T for p, g in start.items() if p[k] == "0"))
                weights = _solve(whole[np.ix_(others, others)], whole[others, target])
                for p in maps:
                    if p[k] == "1":
                        fresh = maps[p].copy()
                        fresh[target] = weights @ maps[p][others]
                        maps[p] = fresh
            history.append(dict(maps))
            low, high = self._moves(start, history, number)
            if high < self.tolerance:
                break
            if low < self.tolerance:
                open_rounds.append(number)
        ended = len(history) - 1
        if open_rounds:
            largest = self._measured(history, open_rounds)
            ended = next((r for r in open_rounds if largest[r] < self.tolerance), ended)
        return self._filled(history[ended])

    def _moves(self, start: dict[str, np.ndarray], history: list[dict], number: int) -> tuple[float, float]:
        """Bounds of the largest move of a round: root of the mean and of the sum of squares."""
        low = high = 0.0
        for p, gram in start.items():
            apart = history[number][p] - history[number - 1][p]
            squares = np.einsum("ij,jk,ik->i", apart, gram, apart)
            for name in self.gaps:
                square = max(float(squares[self.place[name]]), 0.0) * self.spread[name] ** 2
                low, high = max(low, (square / max(gram[0, 0], 1.0)) ** 0.5), max(high, square ** 0.5)
        # what rounding may take from or add to the sums
        return low * (1 - 1e-6), high * (1 + 1e-6) + 1e-9 * self.tolerance

    def _mapped(self, weights: Column) -> Column:
        """Inner product of an array of weights and (1, cells)."""
        out = weights[0]
        for name, i in self.place.items():
            out = out + weights[i] * _unit(name, self.center, self.spread)
        return out

    def _with_weights(self, tables: dict[str, dict[str, np.ndarray]]) -> DataFrame:
        """The rows with one array of weights per label, looked up by the pattern."""
        labels = list(tables)
        patterns = list(next(iter(tables.values())))
        schema = "_pattern string, " + ", ".join(f"`{label}` array<double>" for label in labels)
        rows = [(p, *[tables[label][p].tolist() for label in labels]) for p in patterns]
        weights = session_of(self.work).createDataFrame(rows, schema)
        return self.work.withColumn("_pattern", self.pattern).join(F.broadcast(weights), "_pattern")

    def _measured(self, history: list[dict], rounds: list[int]) -> dict[int, float]:
        tables = {f"_{r}_{n}": {p: (history[r][p] - history[r - 1][p])[self.place[n]] * self.spread[n] for p in history[r]}
                  for r in rounds for n in self.gaps}
        picks = [F.max(F.greatest(*[F.abs(self._mapped(col(f"_{r}_{n}"))) for n in self.gaps], F.lit(0.0))).alias(f"r{r}")
                 for r in rounds]
        row = self._with_weights(tables).agg(*picks).first()
        return {r: row[f"r{r}"] or 0.0 for r in rounds}

    def _filled(self, maps: dict[str, np.ndarray]) -> DataFrame:
        tables = {f"_fill_{n}": {p: m[self.place[n]] for p, m in maps.items()} for n in self.gaps}
        rows = self._with_weights(tables)
        return rows.withColumns({
            n: F.when(F.col(f"_gap_{n}"), self._mapped(col(f"_fill_{n}")) * self.spread[n] + self.center[n]).otherwise(col(n))
            for n in self.gaps})

    # ---- one aggregate per column and round

    def _regress(self, df: DataFrame, target: str, others: Sequence[str]) -> tuple[float, list[float]]:
        """Ridge fit of the target on the other columns over the rows where the target was known."""
        terms = [F.lit(1.0)] + [_unit(n, self.center, self.spread) for n in others]
        goal = _unit(target, self.center, self.spread)
        size = len(terms)
        pairs = list(combinations_with_replacement(range(size), 2))
        picks = [F.sum(terms[i] * terms[j]).alias(f"p{i}_{j}") for i, j in pairs]
        picks += [F.sum(terms[i] * goal).alias(f"g{i}") for i in range(size)]
        row = df.where(~F.col(f"_gap_{target}")).agg(*picks).first()
        gram = np.zeros((size, size))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = row[f"p{i}_{j}"]
        weights = _solve(gram, np.array([row[f"g{i}"] for i in range(size)]))
        return float(weights[0]), [float(w) for w in weights[1:]]

    def by_rounds(self) -> DataFrame:
        """The same with a reliable checkpoint per round, which keeps the plan short."""
        work = materialize(self.work)
        for _ in range(self.max_iter):
            work = work.withColumns({f"_old_{n}": col(n) for n in self.gaps})
            for name in self.gaps:
                others = [n for n in self.numbers if n != name]
                base, slopes = self._regress(work, name, others)
                guess = F.lit(base)
                for slope, other in zip(slopes, others):
                    guess = guess + _unit(other, self.center, self.spread) * slope
                guess = guess * self.spread[name] + self.center[name]
                work = work.withColumn(name, F.when(F.col(f"_gap_{name}"), guess).otherwise(col(name)))
            work = materialize(work)
            moved = work.agg(*[F.max(F.abs(col(n) - F.col(f"_old_{n}"))) for n in self.gaps]).first()
            if max(m or 0.0 for m in moved) < self.tolerance:
                break
        return work
