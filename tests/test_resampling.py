"""Resampling by splines and preprocessing against dense versions on whole volumes."""

import numpy as np
import pytest

from quarrylake.operators import resampling as R

POLE = 3**0.5 - 2


def spline(s, at):
    """The interpolating cubic spline of s, continued by its edges, at a place: a plain sum over samples far beyond both ends."""
    far = np.pad(s, 80, mode="edge")
    j = np.arange(len(far))
    k = np.arange(int(np.floor(at)) - 1, int(np.floor(at)) + 3)
    t = np.abs(at - k)
    b = np.where(t < 1, 2 / 3 - t**2 + t**3 / 2, np.maximum(2 - t, 0) ** 3 / 6)
    c = (-6 * POLE / (1 - POLE**2) * POLE ** np.abs((k + 80)[:, None] - j)) @ far
    return b @ c


def line(s, m, order):
    n = len(s)
    if n == m:
        return s
    at = [(i + 0.5) * n / m - 0.5 for i in range(m)]
    if order == 0:
        return np.array([s[min((2 * i + 1) * n // (2 * m), n - 1)] for i in range(m)])
    if order == 1:
        return np.interp(at, np.arange(n), s)
    return np.array([spline(s, x) for x in at])


def dense(a, m, order, separate=None, order_z=0):
    axes = [k for k in range(3) if k != separate] + ([] if separate is None else [separate])
    out = a
    for k in axes:
        if k == separate:
            edge = tuple(x for x in range(3) if x != separate)
            out = np.clip(out, a.min(axis=edge, keepdims=True), a.max(axis=edge, keepdims=True))
        out = np.apply_along_axis(line, k, out, m[k], order_z if k == separate else order)
    return out if separate is not None else np.clip(out, a.min(), a.max())


def rows(case, a):
    return [(case, 0, *map(int, p), float(a[p])) for p in np.ndindex(a.shape)]


def as_array(found):
    out = np.full([max(r[a] for r in found) + 1 for a in "zyx"], np.nan)
    for r in found:
        out[r.z, r.y, r.x] = r[-1]
    return out


GRIDS = {"a": ((5, 9, 7), (8, 6, 7), None), "b": ((3, 12, 6), (5, 7, 9), 0), "c": ((6, 4, 11), (4, 9, 5), 1), "d": ((4, 4, 5), (7, 3, 8), 2), "e": ((1, 2, 600), (1, 3, 410), None)}


@pytest.mark.parametrize("order", [0, 1, 3])
def test_orders(spark, order):
    rng = np.random.default_rng(order)
    cases = {c: rng.normal(size=n) for c, (n, _, _) in GRIDS.items()}
    table = spark.createDataFrame([r for c, a in cases.items() for r in rows(c, a)], "case_id string, c int, z int, y int, x int, v double")
    grids = spark.createDataFrame([(c, list(n), list(m), s) for c, (n, m, s) in GRIDS.items()], "case_id string, n array<int>, m array<int>, separate int")
    by = {}
    for r in R.resampled_cases(table, grids, order).collect():
        by.setdefault(r.case_id, []).append(r)
    for c, (_, m, s) in GRIDS.items():
        got = as_array(by[c])
        assert got.shape == m and len(by[c]) == got.size
        assert np.abs(got - dense(cases[c], m, order, s)).max() < 1e-9


def test_labels(spark):
    rng = np.random.default_rng(4)
    cases = {c: rng.integers(-1, 3, size=n).repeat(2, axis=2) for c, (n, _, _) in list(GRIDS.items())[:4]}
    table = spark.createDataFrame([(c, *map(int, p), int(a[p])) for c, a in cases.items() for p in np.ndindex(a.shape)], "case_id string, z int, y int, x int, label int")
    grids = spark.createDataFrame([(c, list(cases[c].shape), list(GRIDS[c][1]), GRIDS[c][2]) for c in cases], "case_id string, n array<int>, m array<int>, separate int")
    for order in (1, 3):
        by = {}
        for r in R.resampled_labels(table, grids, order).collect():
            by.setdefault(r.case_id, []).append(r)
        for c, a in cases.items():
            want = np.zeros(GRIDS[c][1], int)
            for label in np.unique(a):
                want[dense((a == label).astype(float), GRIDS[c][1], order, GRIDS[c][2]) >= 0.5 - 1e-9] = label
            assert (as_array(by[c]) == want).all()


def test_cases_together_as_one_by_one(spark):
    rng = np.random.default_rng(8)
    shapes = {"a": (4, 9, 8), "b": (6, 5, 12), "c": (3, 14, 7)}
    spacing = {"a": [3.0, 1.0, 1.0], "b": [1.0, 1.0, 2.0], "c": [6.0, 1.0, 1.5]}
    volume, labels = [], []
    for c, shape in shapes.items():
        a = np.zeros(shape)
        a[1:, 1:-1, 2:] = rng.normal(size=a[1:, 1:-1, 2:].shape)
        volume += rows(c, a)
        labels += [(c, *map(int, p), int(a[p] > 0.5)) for p in np.ndindex(shape)]
    v = spark.createDataFrame(volume, "case_id string, c int, z int, y int, x int, v double")
    s = spark.createDataFrame(labels, "case_id string, z int, y int, x int, label int")
    sp = spark.createDataFrame(list(spacing.items()), "case_id string, spacing array<double>")
    both = [x.collect() for x in R.preprocessed_cases(v, s, sp, [0, 2, 1], [2.0, 1.0, 0.8])]
    for c, shape in shapes.items():
        one = [x.collect() for x in R.preprocessed_cases(*(x.where(f"case_id = '{c}'") for x in (v, s, sp)), [0, 2, 1], [2.0, 1.0, 0.8])]
        mine = [[r for r in x if r.case_id == c] for x in both]
        assert np.allclose(as_array(one[0]), as_array(mine[0]), atol=1e-12) and (as_array(one[1]) == as_array(mine[1])).all()
        crop = np.zeros(shape)
        for r in volume:
            if r[0] == c:
                crop[r[2:5]] = r[5]
        crop = crop[1:, 1:-1, 2:].transpose(0, 2, 1)
        n, old = crop.shape, [spacing[c][k] for k in (0, 2, 1)]
        m = tuple(int(round(o / t * k)) for o, t, k in zip(old, [2.0, 1.0, 0.8], n))
        most = max(old) / min(old) > 3
        want = dense((crop - crop.mean()) / crop.std(), m, 3, int(np.argmax(old)) if most else None)
        assert np.abs(as_array(mine[0]) - want).max() < 1e-9


def test_little(spark):
    empty = spark.createDataFrame([], "case_id string, c int, z int, y int, x int, v double")
    grids = spark.createDataFrame([("a", [1, 1, 1], [2, 2, 2], None)], "case_id string, n array<int>, m array<int>, separate int")
    assert R.resampled_cases(empty, grids).collect() == []
    one = spark.createDataFrame([("a", 0, 0, 0, 0, None), ("b", 0, 0, 0, 0, 1.0)], "case_id string, c int, z int, y int, x int, v double")
    assert {r.v for r in R.resampled_cases(one, grids).collect()} == {0.0}
    sizes = spark.createDataFrame([("a", [5, 8, 8], [9.0, 1.0, 1.0]), ("b", [5, 8, 8], [1.0, 4.0, 4.0]), ("c", [5, 8, 8], [1.0, 1.0, 1.0])], "case_id string, size array<int>, spacing array<double>")
    got = {r.case_id: (r.m, r.separate) for r in R.resampling_grid(sizes, [2.0, 2.0]).collect()}
    assert got == {"a": ([5, 4, 4], 0), "b": ([5, 16, 16], None), "c": ([5, 4, 4], None)}
