"""Whitening against numpy, and its exact steps against other exact ways."""

import decimal
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from mediaops.llm import whitening as W
from mediaops.llm.common import prepare

NAN, INF = float("nan"), float("inf")


def run(spark, rows, tmp_path):
    prepare(spark)
    df = spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], "vec_id long, embedding array<float>, component int, n long, whitened double")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    return W.op13_embedding_whitening(spark, str(tmp_path)).collect()


def expected(rows):
    x = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(float)) + 100000
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1], u[:, ::-1]
    n, s = len(x), [int(t) for t in x.sum(0)]
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return e, c @ u, deviation


def test_against_numpy(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [(i, x.astype("float32").tolist()) for i, x in enumerate(r.normal(size=(300, 12)) * 0.2 + 0.1)]
    rows += [(7, rows[7][1]), (None, rows[8][1])]
    bad = [(900, None), (901, []), (902, [NAN] + [1.0] * 11), (903, [INF] * 12), (904, [None] * 12), (905, [1.0] * 5)]
    got = run(spark, rows + bad, tmp_path)
    e, z, deviation = expected(rows)
    assert len(got) == 302 * 8 and {g.n for g in got} == {302} and {g.identity_error < 1e-9 for g in got} == {True}
    by = {}
    for g in got:
        by.setdefault((g.vec_id, g.component), []).append(g)
    for k in range(8):
        want = z[:, k] / np.sqrt(e[k])
        sign = np.sign(want[0] * by[(0, k + 1)][0].whitened)
        for i, (name, _) in enumerate(rows):
            g = by[(name, k + 1)][0]
            assert g.whitened == pytest.approx(sign * want[i], abs=1e-9) and g.explained == pytest.approx(e[k] / e.sum(), rel=1e-9) and g.deviation == deviation[i]
    assert len(by[(7, 1)]) == 2


def test_small_rank(spark, tmp_path):
    """Two directions only, one of them with all its weight in one row, make two components."""
    rows = [(i, [0.25 * (i % 3), 0.25 * (i % 3), 1.0 * (i == 4), 0.0]) for i in range(9)]
    got = run(spark, rows, tmp_path)
    assert {g.component for g in got} == {1, 2} and len(got) == 18 and max(g.identity_error for g in got) < 1e-9
    assert sum({g.component: g.explained for g in got}.values()) == pytest.approx(1)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(5)]])
def test_without_components(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path) == []


def test_wide_entries_stay_exact(spark):
    prepare(spark)
    rows = [(i, [(1 << 45) + i * i, -i, 3]) for i in range(50)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, v array<long>")).collect()
    s = [sum(v[k] for _, v in rows) for k in range(3)]
    want = {i: sum((50 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in rows}
    assert {g.vec_id: int(g.deviation) for g in got} == want and {g.component for g in got} == {1, 2}


def faddeev(m):
    """det(x - m), lowest first, by the method of Faddeev and LeVerrier in whole numbers."""
    d, c = len(m), [1]
    one = np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
    a = np.zeros((d, d), object)
    for k in range(1, d + 1):
        a = m @ a + c[-1] * one
        c.append(-int(np.trace(m @ a)) // k)
    return c[::-1]


@pytest.mark.parametrize("kind", ["full", "low rank", "blocks", "zero"])
def test_polynomial_and_roots(spark, kind):
    r = np.random.default_rng(2)
    y = r.integers(-50, 50, (3 if kind == "low rank" else 20, 7)).astype(object)
    m = y.T @ y
    if kind == "blocks":  # eigenvalues 9, 9, 4, 4, 1, 1, 0 and many zero pivots
        m = np.diag([9, 4, 1, 9, 0, 4, 1]).astype(object)
    elif kind == "zero":
        m = np.zeros((7, 7), object)
    prepare(spark)
    q = W.characteristic_polynomial(spark, m)
    assert q == faddeev(m)
    with decimal.localcontext(decimal.Context(prec=W.DIGITS)):
        while len(q) > 1 and q[0] == 0:
            q = q[1:]
        got = [root for root, many in W.largest_roots(q, 7) for _ in range(many)] if len(q) > 1 else []
    want = [x for x in np.linalg.eigvalsh(m.astype(float))[::-1] if x > 1e-6]
    assert [float(x) for x in got] == pytest.approx(want, rel=1e-9)
    for (x, v), (y_, w) in [(a, b) for a in W.principal_components(spark, m, 7) for b in W.principal_components(spark, m, 7)]:
        assert max(abs(m.astype(float) @ v.astype(float) - float(x) * v.astype(float))) < 1e-9 * float(x)
        assert abs(float(v @ w)) < 1e-12 or (x, list(v)) == (y_, list(w)) or x == y_


def test_root_is_refined_beyond_doubles():
    """x^2 - 10 x + 23 has the roots 5 and 5 -+ sqrt(2)."""
    with decimal.localcontext(decimal.Context(prec=W.DIGITS)):
        (a, _), (b, _) = W.largest_roots([23, -10, 1], 2)
        assert abs(a - 5 - Decimal(2).sqrt()) < Decimal(10) ** -45 and abs(b - 5 + Decimal(2).sqrt()) < Decimal(10) ** -45
        assert Fraction(W.largest_roots([-6, 11, -6, 1], 1)[0][0]) - 3 < Fraction(1, 10**40)


def test_primes():
    small = [n for n in range(2000) if W.is_prime(n)]
    assert small == [n for n in range(2, 2000) if all(n % k for k in range(2, int(n**0.5) + 1))]
    assert not W.is_prime(25326001) and not W.is_prime(2047) and not W.is_prime(1373653)
