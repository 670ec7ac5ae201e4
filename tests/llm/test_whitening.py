import math
from fractions import Fraction

import numpy as np
import pytest

from daydigest.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, "own", "own") for i, v in rows], SCHEMA)


def brute(rows, size):
    """Mean, covariance and deviations in fractions, eigenvectors in double."""
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]
    n, sums = len(x), [sum(v[k] for _, v in x) for k in range(size)]
    centred = np.array([[Fraction(n * v[k] - sums[k], n) for k in range(size)] for _, v in x], object)
    cov = (centred.T @ centred / Fraction(n)).astype(np.float64)
    deviation = sorted((i, sum((n * v[k] - sums[k]) ** 2 for k in range(size))) for i, v in x)
    return n, cov, deviation, centred.astype(np.float64)


def test_query_rows_match_brute_force(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(40, 40)) * np.linspace(0.05, 3, 40)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(300, 40)) @ mix)]
    n, cov, deviation, centred = brute(rows, 40)
    got = whitening.whitened_rows(table_of(spark, rows)).collect()
    assert len(got) == 300 * 32 and {r["n"] for r in got} == {n}
    assert sorted({(r["vec_id"], r["deviation"]) for r in got}) == deviation
    white = np.zeros((300, 32))
    for r in got:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = centred @ vectors / np.sqrt(values)
    want *= np.sign((want * white).sum(axis=0))
    assert np.abs(white - want).max() < 1e-9
    share = {r["component"]: r["explained"] for r in got}
    assert np.allclose([share[k + 1] for k in range(32)], values / np.trace(cov), rtol=1e-9)
    error = np.abs(white.T @ white / n - np.outer(white.mean(0), white.mean(0)) - np.eye(32)).max()
    assert len({r["identity_error"] for r in got}) == 1 and abs(got[0]["identity_error"] - error) < 1e-11 and error < 1e-9


def residual(a, values, x):
    scale = np.abs(a).max()
    return max(np.abs(a @ x - x * values).max() / scale, np.abs(x.T @ x - np.eye(len(a))).max())


@pytest.mark.parametrize("gap", [1e-1, 1e-6, 1e-9, 1e-13, 0])
def test_clustered_eigenvalues(gap):
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(24, 24)))[0].astype(np.longdouble)
    for _ in range(3):  # orthonormal in extended precision
        basis = basis @ (1.5 * np.eye(24, dtype=np.longdouble) - 0.5 * basis.T @ basis)
    wanted = np.concatenate([3 + gap * np.arange(5), 1 + gap * np.arange(3), [1e-3, 1e-3 + gap], np.linspace(4, 9, 14)]).astype(np.longdouble)
    a = (basis * wanted) @ basis.T
    a = (a + a.T) / 2
    values, x = whitening.eigenvectors(a)
    assert residual(a, values, x) < 1e-16
    assert np.abs(values - np.sort(wanted)[::-1]).max() < 1e-16
    if gap >= 1e-9:
        # each vector of a cluster, not only the space they span; a double product would leave 1e-16 / gap
        order = np.argsort(-wanted)
        want = basis[:, order] * np.sign((x * basis[:, order]).sum(axis=0))
        assert np.abs(x - want).max() < 2e-18 / gap + 1e-16


def test_refinement_is_needed_and_works():
    rng = np.random.default_rng(3)
    a = np.cov(rng.normal(size=(64, 500))).astype(np.longdouble)
    single = np.linalg.eigh(a.astype(np.float32))
    values, x = whitening.eigenvectors(a)
    assert residual(a, single[0].astype(np.longdouble), single[1].astype(np.longdouble)) > 1e-8
    assert residual(a, values, x) < 1e-17


def test_hard_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.5, -0.25]), (None, [3.0, -7.0]), (2, [0.25, 0.125])]
    skipped = [(3, None), (4, []), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [1.0]), (8, [None, 1.0]), (9, [1e30, 0.0])]
    n, cov, deviation, _ = brute([(-1 if i is None else i, v) for i, v in rows], 2)
    got = whitening.whitened_rows(table_of(spark, rows + skipped)).collect()
    assert len(got) == 10 and {r["n"] for r in got} == {5} and got[0]["identity_error"] < 1e-12
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    columns = "vec_id component n deviation whitened explained identity_error".split()
    for none in ([], skipped[:4], [(1, [1.0, 2.0])] * 30):
        empty = whitening.whitened_rows(table_of(spark, none))
        assert empty.columns == columns and empty.collect() == []
    # one direction without variance is no component
    flat = [(i, [float(i), 5.0]) for i in range(20)]
    assert {r["component"] for r in whitening.whitened_rows(table_of(spark, flat)).collect()} == {1}


def test_entries_beyond_exact_floats(spark):
    rows = [(i, [float(2**24 * i), float(2**40) * (i % 3), float(-(2**54)) * (i % 2)]) for i in range(120)]
    n, cov, deviation, _ = brute(rows, 3)
    white, model = whitening.whiten(table_of(spark, rows))
    assert sorted((r["vec_id"], r["deviation"]) for r in white.collect()) == [(i, d if d < 1 << 63 else None) for i, d in deviation]
    assert model["sums"].tolist() == [sum(math.floor(64 * v[k]) + 1_000_000 for _, v in rows) for k in range(3)]
    assert np.isclose(model["total"], np.trace(cov), rtol=1e-12)
