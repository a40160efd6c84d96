"""Whitening against numpy's own eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from revlume.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, vector string, n int, component string"


def matrices():
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    for n in (1, 2, 3, 17, 64):
        a = rng.normal(size=(n, 2 * n))
        yield a @ a.T
    yield np.eye(9)
    yield np.zeros((4, 4))
    yield np.diag([1.0, 1, 1, 2, 2, 5, 5, 5, 0, 0])
    yield np.diag([-1.0, 0, 1])
    yield np.ones((12, 12))
    for values in ([1] * 20 + [3] * 20, np.logspace(0, -14, 40), [2.0] * 20 + [2 + 1e-9 * i for i in range(20)], range(-20, 20)):
        yield (turn * np.array(values)) @ turn.T
    thin = rng.normal(size=(40, 3))
    yield thin @ thin.T
    yield np.kron(np.array([[2.0, 1], [1, 2]]), np.ones((6, 6)))


@pytest.mark.parametrize("v", list(matrices()))
def test_eigenvectors(v):
    values, vectors = whitening.eigenvectors(v)
    size = np.linalg.norm(v) + 1e-300
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-14 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(v))).max() < 1e-13
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-14 * size


def test_polar_factor_is_the_sign():
    a = np.diag([3.0, -2.0, 1e-9, -1e-7])
    assert np.abs(whitening.polar(a) - np.sign(a)).max() < 1e-12


def brute(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * c - s) ** 2 for c, s in zip(row, sums))) for row in x]
    centred = ((n * x - sums) / n).astype(float)
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:8], directions[:, ::-1][:, :8]
    return deviation, centred @ directions / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def vectors(n=300, dims=12, seed=2):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dims)) * np.linspace(3, 0.3, dims) + rng.normal(size=dims)).astype(np.float32).tolist()


def test_whitened_rows(spark):
    good = vectors()
    good += [good[0], good[0]]
    bad = [None, [], [1.0, None] * 6, [float("nan")] * 12, [float("inf")] * 12, [1.0] * 5]
    rows = [(None if i == 7 else i, v, "x", 1, "y") for i, v in enumerate(good)] + [(9000 + i, v, "x", 1, "y") for i, v in enumerate(bad)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    deviation, wanted, explained = brute(good)
    assert len(got) == 8 * len(good)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == {r[0] for r in rows[: len(good)]}
    mine = np.array([[by[rows[i][0]][c]["whitened"] for c in range(1, 9)] for i in range(len(good))])
    signs = np.sign((mine * wanted).sum(axis=0))
    assert np.abs(mine - wanted * signs).max() < 1e-9
    assert all(by[rows[i][0]][c]["deviation"] == deviation[i] and by[rows[i][0]][c]["n"] == len(good) for i in range(len(good)) for c in (1, 8))
    assert np.abs(np.array([by[0][c]["explained"] for c in range(1, 9)]) - explained).max() < 1e-12
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-9


def test_few_directions(spark):
    # two dimensions of variance, one constant
    rows = [(i, [float(i % 5), float(i % 3), 7.0], "x", 1, "y") for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 60 and got[0]["identity_error"] < 1e-9


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, "x", 1, "y")], [(1, [1.0, 2.0], "x", 1, "y")], [(i, [1.0, 2.0], "x", 1, "y") for i in range(5)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_deviation_beyond_64_bits_is_null():
    big = whitening.Whitener(10**9, [10**14, 0], np.diag([4.0, 1.0]))
    assert big.deviations(np.array([[10**5 + 10, 0], [10**5, 0]])) == [None, 0]
    assert big.deviations(np.array([[10**5 + 1, 0]])) == [10**18]
