"""Whitening: the polynomial, its roots and the components against plain exact and numpy versions."""

import random
from fractions import Fraction

import numpy as np
import pytest

from terrasift.llm import charpoly

from .conftest import clashing

COLUMNS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def exact_polynomial(m):
    """Faddeev and LeVerrier, in fractions."""
    d = len(m)
    a = [[Fraction(v) for v in row] for row in m]
    coefs, b = [Fraction(1)], [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        ab = [[sum(a[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c = -sum(ab[i][i] for i in range(d)) / k
        coefs.append(c)
        b = [[ab[i][j] + (c if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(c) for c in reversed(coefs)]


@pytest.mark.parametrize("d,rank,scale", [(1, 1, 5), (2, 2, 3), (5, 5, 1000), (6, 3, 50), (7, 7, 10**9), (4, 1, 2)])
def test_polynomial_and_roots(spark, d, rank, scale):
    rng = random.Random(d * rank)
    f = [[rng.randint(-scale, scale) for _ in range(d)] for _ in range(rank)]
    m = [[sum(r[i] * r[j] for r in f) for j in range(d)] for i in range(d)]
    poly = charpoly.characteristic_polynomial(spark, m)
    assert poly == exact_polynomial(m)
    roots = charpoly.largest_roots(poly, 8)
    want = np.linalg.eigvalsh(np.array(m, float))[::-1][:rank]
    got = [float(r) for r, many in roots for _ in range(many)]
    assert np.allclose(got, want, rtol=1e-9)


def test_equal_roots_and_roots_on_whole_numbers():
    # (x - 3)^2 (x - 1) x
    assert charpoly.largest_roots([0, -9, 15, -7, 1], 8) == [(Fraction(3), 2), (Fraction(1), 1)]
    assert charpoly.largest_roots([0, -9, 15, -7, 1], 1) == [(Fraction(3), 1)]
    assert charpoly.largest_roots([0, 0, 1], 8) == [] and charpoly.largest_roots([1], 8) == []
    v = np.array(charpoly.null_vectors([[3, 0, 0], [0, 3, 0], [0, 0, 1]], Fraction(3), 2))
    assert np.allclose(v @ v.T, np.eye(2)) and np.allclose(v[:, 2], 0)


def test_near_roots_are_told_apart(spark):
    m = [[10**12, 1, 0], [1, 10**12, 0], [0, 0, 7]]
    roots = charpoly.largest_roots(charpoly.characteristic_polynomial(spark, m), 3)
    assert [r for r, _ in roots] == [10**12 + 1, 10**12 - 1, 7]
    for r, _ in roots[:2]:
        v = np.array(charpoly.null_vectors(m, r, 1)[0])
        assert np.allclose(np.abs(v), [2**-0.5, 2**-0.5, 0], atol=1e-15)


def test_primes():
    got = charpoly.primes_below(100, 20)
    assert got == [97, 89, 83, 79] and all(p < 1 << 31 for p in charpoly.primes_below(1 << 31, 100))


def vectors(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, label int, embedding {kind}")


def plain(rows):
    """vec_id -> (deviation, whitened by component), eigenvalues, from numpy and Python integers."""
    good = [(i, v) for i, _, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(0)
    dev = [int(sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))) for r in x]
    y = (x * n - s).astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(8, int((e > 1e-9 * e[0]).sum()))
    return [i for i, _ in good], n, dev, (y @ v[:, :k]) / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("d,n", [(5, 60), (12, 200), (3, 2)])
def test_whole_result(spark, d, n):
    rng = np.random.default_rng(d)
    basis = rng.normal(size=(d, d))
    rows = [(i, i % 3, (rng.normal(size=d) @ basis).tolist()) for i in range(n)]
    odd = [(n, 0, None), (n + 1, 0, [0.5] * (d - 1) + [float("nan")]), (n + 2, 0, [None] + [0.1] * (d - 1)), (n + 3, 0, [float("inf")] * d), (n + 4, 0, []), (n + 5, 0, [0.3] * (d + 1)), (0, 1, rows[0][2]), (None, 1, rows[1][2])]
    fine = rows + odd[-2:]
    ids, count, dev, whitened, explained = plain(fine)
    for df in (vectors(spark, rows + odd).repartition(3), clashing(vectors(spark, rows + odd))):
        got = charpoly.whiten(df).collect()
        k = whitened.shape[1]
        assert len(got) == k * len(ids) and sorted({r.component for r in got}) == list(range(1, k + 1))
        by_id = {}
        for r in got:
            by_id.setdefault(r.vec_id, []).append(r)
        sign = None
        for i, vec in enumerate(ids):
            mine = sorted(by_id[vec], key=lambda r: r.component)[:: 2 if vec == 0 else 1]
            w = np.array([r.whitened for r in mine])
            sign = np.sign(w * whitened[i]) if sign is None else sign
            assert np.allclose(w * sign, whitened[i], atol=1e-7)
            assert {r.deviation for r in mine} == {dev[i]} and {r.n for r in mine} == {count}
            assert np.allclose([r.explained for r in mine], explained, rtol=1e-6)
        assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_tables_without_two_different_vectors(spark):
    assert charpoly.whiten(vectors(spark, [])).collect() == []
    assert charpoly.whiten(vectors(spark, [(1, 0, None)])).collect() == []
    same = charpoly.whiten(vectors(spark, [(1, 0, [0.1, 0.2]), (2, 0, [0.1, 0.2])]))
    assert same.collect() == [] and set(COLUMNS) < set(same.columns)


def test_large_integers_stay_exact(spark):
    rows = [(i, 0, [float(2**40 + 3 * i), float(i * i), -1.5 * i]) for i in range(9)]
    got = charpoly.whiten(vectors(spark, rows, "array<double>")).collect()
    x = [[int(np.floor(1024 * c)) for c in v] for _, _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((9 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for i, r in enumerate(x)}
    assert {r.vec_id: r.deviation for r in got} == {i: v if v < 2**63 else None for i, v in want.items()}
