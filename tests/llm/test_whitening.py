"""Whitening against floating-point eigenvectors and exact determinants."""

from fractions import Fraction

import numpy as np
import pytest

from loomsift.llm import whitening as W
from loomsift.llm.suite import queries

SCHEMA = "vec_id long, embedding array<double>"


def gram_of(seed, d, n=40, low=-9, high=10):
    x = np.random.default_rng(seed).integers(low, high, (n, d))
    return [[int(v) for v in row] for row in x.T @ x]


def exact_polynomial(matrix):
    """Faddeev-LeVerrier in fractions, constant first."""
    d = len(matrix)
    a = [[Fraction(v) for v in row] for row in matrix]
    m = [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    out = [Fraction(1)]
    for k in range(1, d + 1):
        am = [[sum(a[i][t] * m[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c = -sum(am[i][i] for i in range(d)) / k
        out.append(c)
        m = [[am[i][j] + (c if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(v) for v in reversed(out)]


def polynomial(matrix):
    return W.from_residues([(p, W.polynomial_mod(matrix, p)) for p in W.primes_beyond(2 * W.coefficient_bound(matrix) + 1)])


@pytest.mark.parametrize("d", [1, 2, 3, 7, 10])
def test_polynomial_is_exact(d):
    assert polynomial(gram_of(d, d)) == exact_polynomial(gram_of(d, d))
    assert polynomial(gram_of(d, d, n=2)) == exact_polynomial(gram_of(d, d, n=2))  # singular


def test_polynomial_of_odd_matrices():
    for m in ([[0, 0], [0, 0]], [[5, 0, 0], [0, 5, 0], [0, 0, 7]], [[2, 0, 1], [0, 3, 0], [1, 0, 2]]):
        assert polynomial(m) == exact_polynomial(m)


def test_primes():
    assert [n for n in range(2, 60) if W.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert not W.is_prime(3215031751) and W.is_prime((1 << 31) - 1)
    found = W.primes_beyond(10**40)
    assert len(set(found)) == len(found) == 5 and all(map(W.is_prime, found))


def test_roots_with_multiplicity():
    poly = [1]
    for root in (0, 0, 3, 3, 3, 7, 1000):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0])]
    got = W.real_roots(poly, 99)
    assert [(Fraction(n, 1 << s), m) for n, s, m in got[:2]] == [(1000, 1), (7, 1)]
    n, s, m = got[2]
    assert m == 3 and abs(Fraction(n, 1 << s) - 3) <= Fraction(4, 1 << W.BITS) and len(got) == 3
    assert [m for _, _, m in W.real_roots(poly, 2)] == [1, 1]
    assert W.real_roots([0, 0, 1], 5) == []


def test_roots_meet_floating_point():
    m = gram_of(5, 12)
    e = np.linalg.eigvalsh(np.array(m, float))[::-1]
    assert np.allclose([n / (1 << s) for n, s, _ in W.real_roots(polynomial(m), 12)], e, rtol=1e-12)


def test_close_roots_part():
    # Eigenvalues that differ in the last digit of a double: 10**18 and 10**18 + 1.
    m = [[10**18, 0, 0], [0, 10**18 + 1, 0], [0, 0, 4]]
    roots = W.real_roots(polynomial(m), 3)
    assert [n >> s for n, s, _ in roots] == [10**18 + 1, 10**18, 4]
    assert np.allclose(np.abs([W.null_vectors(m, r)[0] for r in roots]), [[0, 1, 0], [1, 0, 0], [0, 0, 1]], atol=1e-15)


def test_shared_null_space_is_orthonormal():
    m = [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 2]]
    v = np.array(W.null_vectors(m, W.real_roots(polynomial(m), 4)[0]))
    assert v.shape == (3, 4) and np.allclose(v @ v.T, np.eye(3), atol=1e-15) and np.abs(v[:, 3]).max() < 1e-15


def check(rows, vectors, most=32, scale=64, offset=1_000_000):
    """Rows of the operator for these vectors (vec_id is the position)."""
    x = np.floor(scale * np.array(vectors)) + offset
    n, s = len(x), x.sum(0)
    y = x - x.mean(0)
    e = np.sort(np.linalg.eigvalsh(y.T @ y / n))[::-1][:most]
    e = e[e > 1e-9]
    assert len(rows) == n * len(e) and {r.n for r in rows} == {n}
    w = np.zeros((n, len(e)))
    for r in rows:
        w[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == int(sum(int(v) ** 2 for v in n * x[r.vec_id] - s))
        assert abs(r.explained / (e[r.component - 1] / (y ** 2).sum() * n) - 1) < 1e-9
    assert np.abs(w.T @ w / n - np.eye(len(e))).max() < 1e-9 and {r.identity_error < 1e-9 for r in rows} == {True}
    # Each column lies along one eigenvector: scaled back, it has the eigenvalue as variance.
    back = y @ (y.T @ w / n)
    assert np.allclose(back, w * e, atol=1e-7 * e.max())


def test_op13_whole_table(spark, sf):
    df = queries()["op13_whitening"](spark, sf)
    assert [f"{n} {t.replace('bigint', 'long').replace('int', 'int')}" for n, t in df.dtypes] == W.OUT.split(", ")
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    check(df.collect(), vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [[float(c) for c in rng.normal(size=5)] for _ in range(60)]
    good = [*good, good[0], good[0], [0.0] * 5]
    odd = [(70, None), (71, []), (72, [nan] * 5), (73, [1.0, inf, 0.0, 0.0, 0.0]), (74, [None, 1.0, 1.0, 1.0, 1.0]), (75, [1.0, 2.0]), (None, None)]
    rows = [*enumerate(good), *odd]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", n int, component int, x int")
    check(W.whiten(df).collect(), good)
    # Dependent columns: the rank decides how many components there are.
    flat = [[v[0], v[1], v[0], v[1], 2.0] for v in good]
    check(W.whiten(spark.createDataFrame(list(enumerate(flat)), SCHEMA)).collect(), flat)
    check(W.whiten(spark.createDataFrame(list(enumerate(good)), SCHEMA), components=2).collect(), good, 2)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        assert W.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_large_integers(spark):
    rng = np.random.default_rng(2)

    def table(size):
        rows = [[float(c) for c in rng.integers(-2, 3, 3) * size] for _ in range(50)]
        return rows, W.whiten(spark.createDataFrame(list(enumerate(rows)), SCHEMA), scale=1, offset=0)

    rows, df = table(1e7)
    check(df.collect(), rows, scale=1, offset=0)
    with pytest.raises(Exception, match="too large"):  # deviation does not fit a long
        table(1e9)[1].collect()
