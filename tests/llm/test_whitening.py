import numpy as np
import pytest

from kinlight.llm import whitening


def plain(vectors, components=16):
    """n, deviations, covariance, whitened by a plain computation over the whole matrix."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, sums = len(fit), fit.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1)
    centred = ((n * fit - sums) / n).astype(float)
    cov = centred.T @ centred / n
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    return n, deviation, values / np.trace(cov), ((n * x - sums) / n).astype(float) @ directions / np.sqrt(values)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, x string")


def test_against_the_whole_matrix(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (300, 20)) @ rng.normal(0, 1, (20, 20))
    vectors = [*base.tolist(), *base[:40].tolist(), *[base[0].tolist()] * 400]
    odd = [None, [None] * 20, [float("nan")] * 20, [float("inf"), *[0.0] * 19], []]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, v) for v in odd]
    got = whitening.whiten(table(spark, rows).repartition(7)).collect()
    n, deviation, explained, whitened = plain(vectors)
    assert len(got) == 16 * len(vectors) and {r.n for r in got} == {n}
    by = np.full((len(vectors), 16), np.nan)
    for r in got:
        by[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-8
    signs = np.sign((by * whitened).sum(0))
    assert np.allclose(by * signs, whitened, atol=1e-7)


def test_lengths_are_spaces_of_their_own(spark):
    rng = np.random.default_rng(4)
    short, long = rng.normal(0, 1, (50, 3)), rng.normal(0, 1, (60, 5))
    rows = [*enumerate(short.tolist()), *((i + 100, v) for i, v in enumerate(long.tolist()))]
    got = whitening.whiten(table(spark, rows, "double")).collect()
    assert {(r.vec_id < 100, r.n, r.component) for r in got} == {(True, 50, c) for c in (1, 2, 3)} | {(False, 60, c) for c in range(1, 6)}
    assert len(got) == 50 * 3 + 60 * 5


def test_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table(spark, [(1, []), (2, None)])).count() == 0
    got = whitening.whiten(table(spark, [(1, [1.0, 5.0, 0.0]), (2, [3.0, 5.0, 0.0]), (2, [3.0, 5.0, 0.0]), (3, [9.0, 5.0, 1.0])])).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 8 and {r.n for r in got} == {3}


def test_beyond_a_long(spark):
    rows = [(1, [1e15, 1.0]), (2, [-1e15, 2.0]), (3, [1e300, 3.0]), (4, [0.5, 4.0])]
    got = whitening.whiten(table(spark, rows, "double")).collect()
    assert {r.deviation for r in got} == {None} and np.isfinite([r.whitened for r in got]).all()
    small = whitening.Model(3, [3, 6], np.ones(1), np.ones((2, 1)), 1.0)
    assert small.deviations(np.array([[2, 2], [1 << 29, 0], [1 << 40, 0]])) == [9, (3 * (1 << 29) - 3) ** 2 + 36, None]


def test_merging_is_exact_for_sums_and_near_for_scatter():
    rng = np.random.default_rng(5)
    x = rng.integers(900_000, 1_100_000, (1000, 8))
    parts = [whitening.Moments.of(p) for p in np.array_split(x, [1, 5, 400])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merged(p)
    assert whole.n == 1000 and whole.sums == x.sum(0).tolist()
    assert np.allclose(whole.scatter / 1000, np.cov(x.T, bias=True), rtol=1e-12)
    huge = np.full((4, 1), (1 << 61) + 1)
    assert whitening.Moments.of(huge).sums == [4 * ((1 << 61) + 1)]
