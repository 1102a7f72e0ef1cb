"""Whitening against plain Python numbers."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tesserae.llm import whitening
from tesserae.llm.whitening import Fit, Scatter, whiten

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, w int, dims int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA).repartition(parts)


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def plain(rows, shift=100_000):
    """Count, sums of x, covariance as fractions of whole numbers."""
    x = [[math.floor(1024 * c) + shift for c in v] for _, v in rows if good(v)]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = [[(n * sum(r[i] * r[j] for r in x) - s[i] * s[j]) / (n * n) for j in range(d)] for i in range(d)]
    return n, s, np.array(cov)


def made(seed, count, dims):
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(dims)]
    vector = lambda: [sum(r.gauss(0, 1.5**-k) * b[i] for k, b in enumerate(base)) for i in range(dims)]
    return [(i, vector()) for i in range(count)]


@pytest.mark.parametrize("dims", [12, 5])
def test_whiten(spark, dims):
    rows = made(dims, 300, dims)
    rows += [(900, None), (901, [float("nan")] * dims), (902, [None, *[1.0] * (dims - 1)]), (903, [float("inf")] * dims), (904, []), (None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1])]
    n, s, cov = plain(rows)
    got = whiten(frame(spark, rows)).collect()
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    k = min(8, dims)
    assert len(got) == n * k
    by = defaultdict(list)
    for r in got:
        assert r.n == n and abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-10 and r.identity_error < 1e-9
        by[r.vec_id].append(r)
    assert len(by[5]) == 3 * k and len(by[None]) == k and not {900, 901, 902, 903, 904} & set(by)
    w = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)] for i in range(300) if i != 5])
    for i in (0, 17, 299):
        x = [math.floor(1024 * c) + 100_000 for c in rows[i][1]]
        assert {r.deviation for r in by[i]} == {sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))}
    # rows come back from their components: the projections are those on unit eigenvectors
    x = np.array([[math.floor(1024 * c) + 100_000 for c in rows[i][1]] for i in range(300) if i != 5]) - np.array(s) / n
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    want = x @ axes / np.sqrt(values[:k])
    assert np.allclose(np.abs(w), np.abs(want), atol=1e-7)
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-7)


def test_empty_constant_and_mixed_lengths(spark):
    assert whiten(frame(spark, [], 1)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten(frame(spark, [], 1)).count() == 0
    one = whiten(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whiten(frame(spark, [(i, [float(i), 3.0 * i]) for i in range(4)])).collect()  # rank one
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9
    mixed = whiten(frame(spark, [(i, [float(i)] * (1 + i % 2)) for i in range(10)])).collect()
    assert {(r.vec_id % 2, r.n) for r in mixed} == {(0, 5), (1, 5)}


def test_exact_at_any_size(spark):
    """Entries near 2^62 and sums beyond 64 and 128 bits stay exact."""
    r = random.Random(1)
    big = np.array([[r.randrange(-(1 << 62), 1 << 62) for _ in range(3)] for _ in range(50)])
    s = Scatter(3)
    s.add(big[:20])
    s.add(big[20:])
    want = [[sum(int(a[i]) * int(a[j]) for a in big) for j in range(3)] for i in range(3)]
    back = np.zeros((3, 4), object)
    for i, limb, part in s.limbs():
        if i >= 0:
            back[i] += np.array([x << (whitening.LIMB * limb) for x in part], object)
    assert back[:, 1:].tolist() == want and back[:, 0].tolist() == [sum(int(a[i]) for a in big) for i in range(3)]
    rows = [(i, [float(x) * 2.0**k for x in (r.random(), r.random())]) for i, k in enumerate([0, 1, 40, 52, 70, 900] * 5)]
    got = whiten(frame(spark, rows)).collect()
    assert len(got) == 60 and all(r.deviation is None or r.deviation >= 0 for r in got) and any(r.deviation is None for r in got)


def test_deviation_paths():
    """Small sums as longs, larger ones as Python's numbers, beyond 64 bits none."""

    class R:
        def __init__(self, i, limb, part):
            self.i, self.limb, self.part = i, limb, part

    y = np.array([[0, 0], [1 << 20, 3], [1 << 28, -(1 << 28)], [(1 << 29) + 12345, 1], [1 << 40, 0]])
    s = Scatter(2)
    s.add(y)
    fit = Fit(2, [R(*x) for x in s.limbs()], 2)
    n, sums = 5, [int(x) for x in y.sum(axis=0)]
    want = [sum((n * int(a) - b) ** 2 for a, b in zip(row, sums, strict=True)) for row in y]
    assert fit.deviation(y) == [x if x < 2**63 else None for x in want]
    small = Fit(2, [R(*x) for x in _scatter(y[:4]).limbs()], 2)
    want = [sum((4 * int(a) - int(b)) ** 2 for a, b in zip(row, y[:4].sum(axis=0), strict=True)) for row in y[:4]]
    assert small.deviation(y[:4]) == [x if x < 2**63 else None for x in want]


def _scatter(y):
    s = Scatter(y.shape[1])
    s.add(y)
    return s
