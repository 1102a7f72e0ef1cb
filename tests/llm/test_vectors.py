"""Vector operators against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tesserae.llm import topk, vector_dedup
from tesserae.llm.common import connected_components

from .plain import components

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v string, cell string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, x, "i", "v", "c") for i, v, x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(9)
    base = r.standard_normal((30, 8))
    out = []
    for i in range(240):
        v = base[r.integers(0, 30)] + r.choice([0.02, 0.08, 0.5]) * r.standard_normal(8)
        v = v / np.linalg.norm(v)
        out.append((i, np.float32(v).tolist(), int(r.integers(0, 2))))
    out += [(240, out[3][1], out[3][2]), (241, out[3][1], out[3][2]), (242, out[4][1], None), (243, None, 1), (244, [0.0] * 8, 1),
            (245, [float("nan")] + [0.1] * 7, 1), (246, [None] + [0.1] * 7, 1), (247, [float("inf")] * 8, 1), (248, [0.5, 0.5], 1), (249, [], 0)]
    return out


def good(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_topk(spark, rows):
    queries = [r for r in rows if r[0] % 20 == 0]
    for k in (10, 500):
        got = {}
        for r in topk.exact_topk(table(spark, rows), table(spark, queries), k).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        quantised = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows if good(v)}
        for i, _, _ in queries:
            if i not in quantised:
                assert i not in got
                continue
            scores = sorted((-sum(a * b for a, b in zip(quantised[i], q, strict=True)), j) for j, q in quantised.items() if j != i and len(q) == len(quantised[i]))
            assert sorted(got.get(i, [])) == [(n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]


def test_topk_large_components(spark):
    """Scores beyond a double's integers are exact."""
    rows = [(i, [2.0**15 * (i + 1), 2.0**14 + i], 0) for i in range(5)]
    got = topk.exact_topk(table(spark, rows), table(spark, rows[:1]), 2).collect()
    q = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows}
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(n + 1, j, sum(a * b for a, b in zip(q[0], q[j], strict=True))) for n, j in enumerate((4, 3))]


def test_topk_in_blocks_of_queries(spark, rows, monkeypatch):
    """Several passes give what one gives; rows of one id and two vectors have their own ranks."""
    queries = [r for r in rows if r[0] % 20 == 0 and good(r[1])]
    one = sorted(map(tuple, topk.exact_topk(table(spark, rows), table(spark, queries), 3).collect()))
    monkeypatch.setattr(topk, "QUERIES", 5)
    assert sorted(map(tuple, topk.exact_topk(table(spark, rows), table(spark, queries), 3).collect())) == one
    twice = topk.exact_topk(table(spark, rows), table(spark, [(0, rows[0][1], 0), (0, rows[1][1], 0), (0, rows[1][1], 0)]), 3).collect()
    assert sorted(r["rank"] for r in twice) == [1, 1, 2, 2, 3, 3]


def test_cutoffs_spare_products():
    """Of vectors whose weight lies in few components most products of later runs are never made."""
    r = np.random.default_rng(4)
    weight = 1 / np.arange(1, 65)
    q, c = (np.floor(1024 * r.standard_normal((n, 64)) * weight) for n in (50, 4000))
    block = topk.Block(np.arange(50), q, np.arange(50))
    whole = q @ c.T
    low = np.sort(whole[:, ::8], axis=1)[:, -10]
    i, j, score, made = block.reaching(c, low)
    assert sorted(zip(i.tolist(), j.tolist(), score.tolist(), strict=True)) == sorted((a, b, whole[a, b]) for a, b in zip(*np.nonzero(whole >= low[:, None]), strict=True))
    assert made < 0.4 * whole.size * len(block.runs)


def linked(rows, threshold):
    ok = [(i, np.array(v, float), x) for i, v, x in rows if good(v) and x is not None and any(v)]
    pairs = [(a, b) for n, (a, u, x) in enumerate(ok) for b, w, y in ok[n + 1 :] if x == y and len(u) == len(w) and u @ w / np.sqrt((u @ u) * (w @ w)) >= threshold]
    return pairs


@pytest.mark.parametrize("block", [16_384, 16])
def test_vector_dedup(spark, rows, block, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    got = {r.vec_id: r for r in vector_dedup.near_vectors(table(spark, rows), 0.98).collect()}
    pairs = linked(rows, 0.98)
    want = components([r[0] for r in rows], pairs)
    links = {i: sum(i in p for p in pairs) for i in want}
    assert set(got) == set(want)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(links.values())
    for i, r in got.items():
        assert r.n_links <= links[i]
        assert r.kept == (r.component_id == i)
        assert want[r.component_id] == want[i]


def test_recall_near_the_threshold(spark):
    """Pairs planted just above the threshold are found."""
    r = np.random.default_rng(12)
    rows = []
    for i in range(300):
        a = r.standard_normal(64)
        a /= np.linalg.norm(a)
        n = r.standard_normal(64)
        n -= n @ a * a
        n /= np.linalg.norm(n)
        for j, v in ((2 * i, a), (2 * i + 1, 0.981 * a + math.sqrt(1 - 0.981**2) * n)):
            rows.append((j, np.float32(v).tolist(), i % 3))
    pairs = linked(rows, 0.98)
    got = vector_dedup.near_vectors(table(spark, rows), 0.98).collect()
    assert sum(r.n_links for r in got) >= 0.95 * 2 * len(pairs)


@pytest.mark.parametrize("primary", [1, 2, 8])
def test_recall_at_every_number_of_cell_projections(spark, primary, monkeypatch):
    """Cells by eight projections, as for labels of millions, find as many pairs at the threshold as cells by one."""
    monkeypatch.setattr(vector_dedup, "cell_projections", lambda largest: primary)
    r = np.random.default_rng(3)
    rows = []
    for i in range(700):
        a, n = r.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        n -= n @ a * a
        n /= np.linalg.norm(n)
        for j, v in ((2 * i, a), (2 * i + 1, 0.9801 * a + math.sqrt(1 - 0.9801**2) * n)):
            rows.append((j, np.float32(v).tolist(), i % 3))
    got = vector_dedup.near_vectors(table(spark, rows), 0.98).collect()
    assert sum(r.n_links for r in got) >= 0.978 * 2 * 700


@pytest.mark.parametrize("primary", [1, 3, 6])
def test_cells_hold_each_near_pair_once(primary):
    """Vectors whose cell projections lie within the window are compared in exactly one cell; a vector has 1.5 copies for each."""
    r = np.random.default_rng(primary)
    a = vector_dedup._unit(r.standard_normal((400, 32)))
    b = vector_dedup._unit(a + 0.1 * r.standard_normal((400, 32)) / math.sqrt(32))
    both = np.r_[a, b]
    row, cell, bits = vector_dedup.cells(both, primary, 0.2)
    at: dict = {}
    for i, c, x in zip(row.tolist(), map(tuple, cell.tolist()), bits.tolist(), strict=True):
        at.setdefault(i, {})[c] = x
    p = both @ vector_dedup.directions(32)[:, vector_dedup.PROJECTIONS :][:, :primary]
    near = (np.abs(p[:400] - p[400:]) <= vector_dedup.cell_window(primary) * 0.2).all(axis=1)
    assert near.sum() > 350
    for i in np.flatnonzero(near).tolist():
        assert sum(at[i][c] & at[i + 400][c] == 0 for c in at[i].keys() & at[i + 400].keys()) == 1
    assert len(row) / 800 < 1.6**primary


def test_tiny_and_huge_vectors(spark):
    """Squares that under- or overflow don't matter."""
    rows = [(1, [1e-200, 2e-200]), (2, [2e-200, 4e-200]), (3, [1e200, 2e200]), (4, [1e200, -2e200]), (5, [0.0, 0.0]), (6, [5e-324, 1e-323])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (0, 5), 6: (3, 1)}


def test_empty(spark):
    none = table(spark, [])
    assert topk.exact_topk(none, none).count() == 0
    assert vector_dedup.near_vectors(none).count() == 0


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(120)], [(5, i) for i in range(10, 80)], [(1, 1), (3, 2), (2, 3), (9, 7)], []])
def test_components(spark, edges):
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    ids = sorted({x for e in edges if e[0] != e[1] for x in e})
    assert got == components(ids, [e for e in edges if e[0] != e[1]])
