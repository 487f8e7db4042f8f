"""Whitening of vectors by spectral divide and conquer on their covariance.

Entries become whole numbers, so counts and sums are exact. One pass over the distinct vectors gives count and
sums, a second one the covariance of the centred vectors as one matrix of each task's partial sums. The
eigenvectors come from polar decompositions: the orthogonal polar factor U of the covariance shifted by a value
inside its spectrum has the eigenvalues 1 and -1, so (I + U) / 2 and (I - U) / 2 project on the invariant
subspaces above and below the shift. Both get an orthogonal basis, the covariance is restricted to each, and
the halves are split again until single components are left. Polar factors are found by the
QR-based dynamically weighted Halley iteration (Nakatsukasa, Bai and Gygi, 2010), which needs at most six or
seven steps. The components are broadcast (at most 16 x dimensions numbers), every row is whitened in place,
and a last pass over the distinct vectors measures how far the covariance of the whitened ones is from the identity.

Only matrices of dimensions x dimensions reach the driver, whatever the number of rows.

Defined cases: vectors that are NULL or hold NULL, NaN or infinite entries are dropped; shorter vectors count as
filled up with zeros; entries beyond 4e18 / 64 are cut there; repeated rows keep their places and count once in the fit; rows with a NULL vec_id stay;
components without variance (below 1e-12 of the largest one) are not given, so a table of equal vectors, an
empty one, and one of empty vectors give no rows; deviations beyond a long are cut to its range; further columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged

COMPONENTS = 16
FACTOR, SHIFT = 64, 1_000_000
ROWS = 4_096
MOST = 4e18
LONG = (1 << 63) - 1


def whole_numbers(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of every entry as longs; NULL if the vector is dropped."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    inside = lambda x: F.greatest(F.least(x.cast("double") * FACTOR, F.lit(MOST)), F.lit(-MOST))
    return F.when(fine, F.transform(vector, lambda x: F.floor(inside(x)).cast("long") + SHIFT))


def _padded(vectors: Column, width: int) -> Column:
    return F.concat(vectors, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size(vectors)))


def _chunks(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Rows of longs, some thousands at a time."""
    for at in range(0, len(column), ROWS):
        yield column.slice(at, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(fit: DataFrame, width: int, partial, cells: int) -> np.ndarray:
    """Sum over all tasks of one array of doubles that ``partial`` gets from a task's rows of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            for rows in _chunks(batch.column("x"), width):
                total += partial(rows)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = fit.select("x").mapInArrow(run, "sums array<double>")
    out = np.zeros(cells)
    for row in parts.select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[row.place] = row.value
    return out


def polar_factor(matrix: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix without the eigenvalue 0, by QDWH."""
    n = len(matrix)
    x = matrix / np.linalg.norm(matrix)
    low = max(1.0 / (np.sqrt(n) * np.linalg.norm(np.linalg.inv(x))), 1e-17)  # least singular value, from below
    eye = np.eye(n)
    for _ in range(rounds):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        a = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        fresh = b / c * x + (a - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        fresh = (fresh + fresh.T) / 2
        moved = np.linalg.norm(fresh - x)
        x, low = fresh, min(low * (a + b * square) / (1 + c * square), 1.0)
        if moved < 1e-14 * np.sqrt(n) or (1 - low < 1e-15 and moved < 1e-8):
            break
    return x


def _basis(projector: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Orthonormal basis of a projector's range."""
    start = projector @ np.random.default_rng(seed).normal(size=(len(projector), rank))
    for _ in range(2):
        start, _ = np.linalg.qr(projector @ start)
    return start


def _shifts(matrix: np.ndarray) -> Iterator[float]:
    """Values inside the spectrum to try in turn: near the median of the diagonal, then elsewhere between its ends."""
    own = np.sort(np.diag(matrix))
    middle = own[(len(own) - 1) // 2: len(own) // 2 + 1].mean()
    yield float(middle)
    mean, spread = own.mean(), np.linalg.norm(matrix - own.mean() * np.eye(len(own))) / np.sqrt(len(own))
    for part in (0.0, 0.31, -0.31, 0.73, -0.73, 0.11, -0.11, 0.93, -0.93):
        yield float(mean + part * spread)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale = np.linalg.norm(matrix)
    values, vectors = [], []
    open_parts = [(np.eye(len(matrix)), matrix)] if len(matrix) else []
    while open_parts:
        basis, part = open_parts.pop()
        n = len(part)
        mean = np.trace(part) / n
        if n == 1 or np.linalg.norm(part - mean * np.eye(n)) <= 4e-16 * scale:
            values += [mean] * n
            vectors += list(basis.T)
            continue
        for shift in _shifts(part):
            moved = part - shift * np.eye(n)
            try:
                sign = polar_factor(moved)
            except np.linalg.LinAlgError:  # the shift is an eigenvalue
                continue
            above = int(round((n + np.trace(sign)) / 2))
            if 0 < above < n and np.linalg.norm(sign @ sign - np.eye(n)) < 1e-10:
                for side, rank in ((1, above), (-1, n - above)):
                    own = _basis((np.eye(n) + side * sign) / 2, rank, n)
                    # bases stay orthogonal to working precision however deep the division goes
                    whole, _ = np.linalg.qr(basis @ own)
                    inner = whole.T @ matrix @ whole
                    open_parts.append((whole, (inner + inner.T) / 2))
                break
        else:
            raise ArithmeticError("no shift divides the spectrum")
    order = np.argsort(values)[::-1]
    vectors = np.array(vectors).reshape(-1, len(matrix))[order]
    return np.array(values)[order], vectors.T


def _mean(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """S / n as its whole part and the rest, so that x - S / n loses nothing."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def _fitted(fit: DataFrame, width: int, components: int) -> tuple[int, list[int], np.ndarray, list[float], float]:
    """Rows n and sums of the fit list, whitening matrix, explained shares and identity error."""
    n = fit.count()
    totals = fit.select(F.posexplode("x").alias("place", "value")).groupBy("place").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(s) for _, s in sorted((r.place, r.s) for r in totals)]
    whole, rest = _mean(sums, n)

    def squares(x: np.ndarray) -> np.ndarray:
        centred = (x - whole).astype(float) - rest
        return (centred.T @ centred).ravel()

    covariance = _summed(fit, width, squares, width * width).reshape(width, width) / n
    values, vectors = eigen((covariance + covariance.T) / 2)
    kept = int((values[:components] > 1e-12 * values[0]).sum()) if values[0] > 0 else 0
    if not kept:
        return n, sums, vectors[:, :0], [], 0.0
    whitener = vectors[:, :kept] / np.sqrt(values[:kept])

    def identity(x: np.ndarray) -> np.ndarray:
        white = ((x - whole).astype(float) - rest) @ whitener
        return np.concatenate([(white.T @ white).ravel(), white.sum(axis=0)])

    moments = _summed(fit, width, identity, kept * kept + kept) / n
    mean = moments[kept * kept:]  # zero but for rounding, as x is centred already
    error = np.abs(moments[: kept * kept].reshape(kept, kept) - np.outer(mean, mean) - np.eye(kept)).max()
    return n, sums, whitener, (values[:kept] / np.trace(covariance)).tolist(), float(error)


def whiten(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component."""
    spark = table.sparkSession
    kind = table.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    rows = table.select("vec_id", whole_numbers(F.col(vector)).alias("x")).where("x IS NOT NULL")
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("x", _padded(F.col("x"), width))
    with staged(rows.select("x").distinct(), "whitening-fit") as fit:
        n, sums, whitener, explained, error = _fitted(fit, width, components)
    if not len(explained):
        return spark.createDataFrame([], schema)
    kept = len(explained)
    whole, rest = _mean(sums, n)
    exact = np.array(sums, object)
    remainders = np.array([s % n for s in sums], np.int64)

    def deviations(x: np.ndarray) -> np.ndarray:
        gap = int(np.abs(x - whole).max(initial=0)) + 1
        if width * (gap * n) ** 2 < LONG:
            own = n * (x - whole) - remainders
            return (own * own).sum(axis=1)
        return np.array([min(int(v), LONG) for v in ((n * x.astype(object) - exact) ** 2).sum(axis=1)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _chunks(batch.column("x"), width):
                white = ((x - whole).astype(float) - rest) @ whitener
                again = np.repeat(np.arange(len(x)), kept)
                ids = batch.column("vec_id").slice(at, len(x))
                at += len(x)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(again)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(again), n, np.int64)), pa.array(deviations(x)[again]), pa.array(white.ravel()),
                     pa.array(np.tile(explained, len(x))), pa.array(np.full(len(again), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
