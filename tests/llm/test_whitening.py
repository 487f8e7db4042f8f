"""Whitening against dense linear algebra."""

import math

import numpy as np
import pytest

from millrace.llm import whitening
from millrace.llm.whitening import eigen, polar_factor

PICK = np.random.default_rng(4)


def orthogonal(n):
    return np.linalg.qr(PICK.normal(size=(n, n)))[0]


@pytest.mark.parametrize("values", [
    PICK.normal(size=24), 10.0 ** -np.arange(30), 1 + 1e-9 * np.arange(12), [1] * 5 + [1e-6] * 5, [0] * 6, [3.0], [2, 2, 2, 1], [1, 0, 0, 0, 0]])
def test_eigenvectors(values):
    turn = orthogonal(len(values))
    matrix = turn @ np.diag(np.array(values, float)) @ turn.T
    matrix = (matrix + matrix.T) / 2
    got, vectors = eigen(matrix)
    scale = np.abs(values).max() + 1e-300
    assert np.abs(got - np.sort(values)[::-1]).max() <= 1e-14 * scale * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * got).max() <= 1e-13 * scale


def test_polar_factor():
    turn, values = orthogonal(12), PICK.normal(size=12)
    values[0] = 1e-11
    factor = polar_factor(turn @ np.diag(values) @ turn.T)
    assert np.abs(factor - turn @ np.diag(np.sign(values)) @ turn.T).max() < 1e-4
    assert np.abs(factor @ factor - np.eye(12)).max() < 1e-12


def brute(rows, components=16):
    """{(vec_id, deviation): whitened} up to the sign of each component, with n and explained shares."""
    def fine(v):
        return v is not None and all(c is not None and math.isfinite(c) for c in v)

    width = max(len(v) for _, v in rows if fine(v))
    own = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v) + (1_000_000,) * (width - len(v))) for i, v in rows if fine(v)]
    fit = sorted({x for _, x in own})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for i, x in own:
        gap = [n * c - s for c, s in zip(x, sums)]
        out.append((i, sum(g * g for g in gap), np.array(gap) / n @ vectors / np.sqrt(values)))
    return n, values / np.trace(centred.T @ centred / n), out


def check(spark, rows):
    table = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<double>, whitened double")
    got = whitening.whiten(table).collect()
    n, explained, want = brute(rows)
    k = len(explained)
    assert len(got) == len(want) * k and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    blocks = [got[a: a + k] for a in range(0, len(got), k)]
    key = lambda r: (str(r[0]), r[1])
    mine = sorted(((b[0].vec_id, b[0].deviation, np.array([r.whitened for r in b])) for b in blocks), key=key)
    want.sort(key=key)
    assert [m[:2] for m in mine] == [w[:2] for w in want]
    left, right = np.array([m[2] for m in mine]), np.array([w[2] for w in want])
    signs = np.sign((left * right).sum(axis=0))
    assert np.abs(left * signs - right).max() < 1e-7
    assert [r.component for r in blocks[0]] == list(range(1, k + 1))
    assert np.allclose([r.explained for r in blocks[0]], explained, rtol=1e-9)


def test_against_dense_algebra(spark):
    mix = PICK.normal(size=(20, 20)) * 0.5
    rows = [(i, (PICK.normal(size=20) @ mix).tolist()) for i in range(300)]
    rows += [(i + 1000, rows[0][1]) for i in range(150)]  # a third are copies
    rows += [(5, rows[9][1]), (None, rows[3][1]), (2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20),
             (2003, [float("inf")] + [0.0] * 19), (2004, [0.5, 0.25])]
    check(spark, rows)


def test_few_components(spark):
    check(spark, [(i, PICK.normal(size=3).tolist()) for i in range(50)])


def test_degenerate_tables(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string"))

    assert run([]).count() == 0 and run([(1, [], "a"), (2, None, "a")]).count() == 0
    assert run([(i, [1.0, 2.0], "a") for i in range(9)]).count() == 0
    line = run([(i, [float(i), 2.0 * i, 0.0], "a") for i in range(9)]).collect()
    assert len(line) == 9 and {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    far = run([(1, [3e38, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, -3e38], "a")]).collect()
    assert {r.vec_id for r in far} == {1, 2, 3} and max(r.deviation for r in far) == (1 << 63) - 1
