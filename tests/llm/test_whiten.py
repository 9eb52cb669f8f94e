"""Operator 12 against dense eigendecompositions in numpy."""

import math

import numpy as np
import pytest

from quarry.llm import whiten

VECS = "vec_id long, embedding array<float>, label int, y int, n string, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, "n", 3) for i, e in rows], VECS)


def expected(rows, components=16):
    """(vec_id, component) -> (n, deviation, whitened, explained) with whole-number sums."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e]) for i, e in rows
            if e and all(c is not None and math.isfinite(c) for c in e)]
    fitted = sorted({tuple(x) for _, x in kept})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    gaps = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fitted])
    cov = gaps.T @ gaps / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        p = np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ vectors
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out += [(i, k + 1, n, dev, abs(p[k]) / math.sqrt(values[k]), values[k] / np.trace(cov))
                for k in range(min(components, int((values > 1e-9).sum())))]
    return out


def check(got, want):
    assert len(got) == len(want)
    for r, w in zip(sorted(got, key=lambda r: (r.vec_id is None, r.vec_id, r.component,
                                               abs(r.whitened))),
                    sorted(want, key=lambda w: (w[0] is None, w[0], w[1], w[4]))):
        assert (r.vec_id, r.component, r.n, r.deviation) == w[:4]
        assert abs(r.whitened) == pytest.approx(w[4], abs=1e-8)
        assert r.explained == pytest.approx(w[5], rel=1e-10)
        assert r.identity_error < 1e-9


def test_rank_one_updates_with_deflation():
    rng = np.random.default_rng(0)
    for _ in range(400):
        k = int(rng.integers(1, 20))
        d = np.sort(rng.choice([0, 0, 1, 1, 2, 5], k) + rng.random(k) * rng.choice([0, 1e-12, 1], k))
        u = np.linalg.qr(rng.normal(size=(k, k)))[0]
        v, rho = rng.normal(size=k) * rng.choice([0, 1e-9, 1, 1], k), rng.choice([0, 1e-6, 1, 1e3])
        whole = u @ np.diag(d) @ u.T + rho * np.outer(v, v)
        values, vectors = whiten.rank_one(d, u, v, rho)
        assert np.abs(vectors * values @ vectors.T - whole).max() <= 1e-12 * max(1, np.abs(whole).max())
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert (np.diff(values) >= 0).all()


def test_roots_lie_between_the_poles():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 40):
        d = np.sort(rng.random(k))
        z = rng.normal(size=k)
        z /= np.sqrt(z @ z)
        roots, diff = whiten.secular_roots(d, z, 0.7)
        assert (roots > d).all() and (roots[:-1] < d[1:]).all() and roots[-1] <= d[-1] + 0.7
        assert roots == pytest.approx(np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z)), abs=1e-14)
        assert diff == pytest.approx(d[None, :] - roots[:, None], abs=1e-15)


def test_merged_spectra_are_the_spectrum_of_all():
    y = np.random.default_rng(2).integers(-90, 90, (300, 9))
    s = whiten.Spectrum(9)
    for part in (y[:1], y[1:40], y[40:40], y[40:200], y[200:]):
        t = whiten.Spectrum(9)
        for row in part:
            t.add(row)
        s.merge(whiten.Spectrum.unpack(t.pack(), 9))
    assert s.n == 300 and (s.sums == y.sum(axis=0)).all()
    scatter = np.cov(y.T, bias=True) * 300
    assert np.abs(s.u * s.d @ s.u.T - scatter).max() < 1e-11 * np.abs(scatter).max()


def test_rows_against_numpy(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 20)) * np.linspace(0.2, 3, 20) + 5
    rows = [(int(i), [float(c) for c in e]) for i, e in enumerate(data)]
    rows += [(None, rows[3][1]), (7, rows[7][1]), (900, rows[9][1]), (901, None), (902, []),
             (903, [None] * 20), (904, [float("nan")] * 20), (905, [1.0] * 19 + [float("inf")])]
    check(whiten.whiten(table(spark, rows).repartition(40)).collect(), expected(rows))


def test_common_vectors_and_flat_dimensions(spark):
    """A third of the rows are equal, two dimensions are constant, one repeats another."""
    rng = np.random.default_rng(4)
    data = rng.normal(size=(60, 3))
    rows = [(i, [float(a), 0.5, float(b), float(b), -2.0, float(c)]) for i, (a, b, c) in
            enumerate(data)] + [(100 + i, [1.0, 0.5, 2.0, 2.0, -2.0, 0.0]) for i in range(30)]
    got = whiten.whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    check(got, expected(rows))


def test_lengths_apart_few_rows_and_empty_tables(spark):
    a = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, 7.0])]
    b = [(4, [1.0]), (5, [2.0])]
    check(whiten.whiten(table(spark, a + b)).collect(), expected(a) + expected(b))
    assert whiten.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten.whiten(table(spark, [(1, None)])).count() == 0
    assert whiten.whiten(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        whiten.whiten(table(spark, [(i, [0.5] * i) for i in range(1, 20)]))


def test_deviations_beyond_floats_are_exact():
    """Sums of squares are whole numbers up to 64 bits, and null beyond."""
    sums = np.array([10 ** 9, -3], np.int64)
    real, exact = whiten.centred(np.array([[7 * 10 ** 8, 5]]), 3, sums)
    assert exact.tolist() == [[11 * 10 ** 8, 18]] and real[0, 1] == 6
    assert whiten.centred(np.array([[2 ** 61, 1]]), 4, sums)[1] is None


def test_the_tables_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whiten.whiten(vectors).collect(),
          expected([(r.vec_id, r.embedding) for r in vectors.collect()]))
