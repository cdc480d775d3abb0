import math

import numpy as np
import pytest
from penprint.llm import whitening
from penprint.llm.bidiagonal import dqds, right_singular

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, part string, n string"


def table(spark, vectors, parts=5):
    return spark.createDataFrame([(i, v, None, "x", "p", "n") for i, v in vectors], SCHEMA).repartition(parts)


def plain(vectors, components=16):
    """Fit by numpy's eigh over Python integers."""
    whole = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in vectors}
    fit = np.array(sorted(set(whole.values())), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    centred = np.array(fit * n - total, np.float64) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return whole, n, total, values[order], directions[:, order], values.sum()


@pytest.mark.parametrize("name", ["isotropic", "graded", "equal values"])
def test_whitening_equals_a_dense_solver(spark, name):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 24))
    if name == "graded":
        v *= np.logspace(2, -1, 24)
    if name == "equal values":
        v = np.vstack([np.eye(24), -np.eye(24)]) * 3
    vectors = [(i, [float(c) for c in row]) for i, row in enumerate(v)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(300)] + [(7, vectors[7][1])]
    whole, n, total, values, directions, trace = plain(vectors)
    got = whitening.whiten(table(spark, vectors)).collect()
    assert len(got) == len(vectors) * 16
    by = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-10
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-9 * r.explained
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(whole[r.vec_id], total, strict=True))
        by.setdefault(r.component, {})[r.vec_id] = r.whitened
    if name == "equal values":
        return
    for k in range(1, 17):
        d = directions[:, k - 1]
        want = {i: float((np.array(w, dtype=object) * n - total).astype(float) @ d) / n / math.sqrt(values[k - 1])
                for i, w in whole.items()}
        sign = np.sign(want[7] * by[k][7])
        assert max(abs(sign * by[k][i] - x) for i, x in want.items()) < 1e-8


def test_rows_left_out_and_kept(spark):
    rng = np.random.default_rng(6)
    good = [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 0.0, 0.0]),
           (104, [1.0, 2.0]), (105, []), (106, [1e30, 0.0, 0.0]), (None, good[3][1]), (3, good[3][1])]
    got = whitening.whiten(table(spark, good + odd)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted(
        (str(i), c) for i in [*range(30), None, 3] for c in (1, 2, 3))
    assert {r.n for r in got} == {30}


def test_tables_without_directions(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_many_tasks_merge_by_levels(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = rng.integers(-500, 500, (700, 5)) + whitening.SHIFT
    fit = spark.createDataFrame([(r,) for r in rows.tolist()], "x array<bigint>").repartition(37)
    centre = whitening._Centre(len(rows), [int(s) for s in rows.sum(axis=0)])
    monkeypatch.setattr(whitening, "MERGE", 3)
    upper = whitening.fit_triangle(fit, centre)
    c = rows - rows.mean(axis=0)
    assert np.allclose(upper.T @ upper, c.T @ c, rtol=1e-12)


def test_deviations_beyond_long_are_null():
    centre = whitening._Centre(3, [3_000_000, 3_000_001])
    x = np.array([[1_000_000 + (1 << 30), 1_000_000], [1_000_000 + (1 << 40), 0], [1_000_005, 999_000]])
    want = [(3 * int(a) - 3_000_000) ** 2 + (3 * int(b) - 3_000_001) ** 2 for a, b in x]
    assert centre.deviations(x) == [want[0] if want[0] < 1 << 63 else None, None, want[2]]


def test_singular_values_to_high_relative_accuracy():
    # Bidiagonal matrices define all their singular values to high relative accuracy, tiny ones too.
    diagonal, over = np.logspace(0, -120, 30), np.logspace(-1, -121, 29) * 0.5
    got = np.sqrt(dqds(diagonal, over))
    product = np.prod(np.longdouble(diagonal))
    assert abs(np.prod(got.astype(np.longdouble)) / product - 1) < 1e-12
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    for values in (np.ones(40), 1 + 1e-9 * np.arange(40), np.r_[np.ones(20), np.zeros(20)], np.logspace(0, -7, 40)):
        matrix = np.linalg.qr(q * values @ q.T, mode="r")
        squares, vectors = right_singular(matrix, 16)
        assert np.abs(np.sqrt(squares) - np.sort(values)[::-1]).max() < 1e-14
        assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12
        assert np.abs(matrix.T @ (matrix @ vectors) - vectors * squares[:vectors.shape[1]]).max() < 1e-11
