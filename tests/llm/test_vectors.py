"""The operators on vectors, and connected parts, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import vectors
from strandline.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, vector string, n long, component string"


def rows(count=300, width=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, width)).astype(np.float32)
    for i in range(0, count, 5):
        x[i + 1] = x[i] + rng.normal(size=width).astype(np.float32) * 0.05
    x[40:60] = x[40]
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(1000, None), (1001, [0.0] * width), (1002, [float("nan")] * width), (1003, [None, *[1.0] * (width - 1)]), (1004, [float("inf"), *[1.0] * (width - 1)]), (None, x[3].tolist()), (3, x[3].tolist()), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, []), (200, x[7].tolist())]
    return [(i, v, 0, 1, "v", 2, "c") for i, v in data]


def usable(v, zero=False):
    return v is not None and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v))


def test_near_duplicates(spark):
    data = [(r[0], r[1]) for r in rows()]
    good = [k for k, (_, v) in enumerate(data) if usable(v)]
    unit = {k: np.array(data[k][1], float) / np.linalg.norm(data[k][1]) for k in good}
    part, links = list(range(len(data))), [0] * len(data)
    for a in good:
        for b in good:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a] += 1
                links[b] += 1
                if part[a] != part[b]:
                    old, new = part[b], part[a]
                    part = [new if p == old else p for p in part]
    low = {p: min((data[k][0] for k in range(len(data)) if part[k] == p and data[k][0] is not None), default=None) for p in set(part)}
    want = sorted(((data[k][0], links[k], low[part[k]], data[k][0] == low[part[k]]) for k in range(len(data))), key=str)
    got = vectors.near_duplicates(spark.createDataFrame(rows(), SCHEMA).repartition(3), per_cell=40, limit=16, sigmas=4.0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_recall_of_displaced_vectors():
    """Pairs just above the threshold, in random directions: nearly all meet in a cell."""
    rng = np.random.default_rng(0)
    x = vectors.unit(rng.normal(size=(3000, 64)))
    d = rng.normal(size=x.shape)
    d = vectors.unit(d - (d * x).sum(1, keepdims=True) * x)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * d
    c = vectors.spherical_kmeans(x, 64)
    s, gaps = x @ c.T, np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
    visits = s.max(1)[:, None] - s <= np.sqrt(0.1) * 3 / 8 * gaps[s.argmax(1)]
    assert visits[np.arange(3000), (y @ c.T).argmax(1)].mean() > 0.99


def test_links_along_the_line_between_centres(spark):
    """Few effective dimensions: vectors on a great circle of 64 dimensions, whose partners lie in neighbouring cells and blocks."""
    rng = np.random.default_rng(4)
    at = rng.uniform(0, 2 * np.pi, 600)
    plane = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    x = np.stack([np.cos(at), np.sin(at)], axis=1) @ plane + rng.normal(size=(600, 64)) * 1e-3
    near = vectors.unit(x) @ vectors.unit(x).T >= 0.95
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in vectors.near_duplicates(df, per_cell=20, limit=64).collect()}
    assert [got[i].n_links for i in range(600)] == (near.sum(1) - 1).tolist()
    assert {r.component_id for r in got.values()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_forest(seed):
    rng = np.random.default_rng(seed)
    u, v = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    chain = np.arange(1000, 1400)

    def parts(links):
        low = {}
        for a, b in links:
            x, y = low.setdefault(a, {a}), low.setdefault(b, {b})
            if x is not y:
                x |= y
                for n in y:
                    low[n] = x
        return {frozenset(p) for p in low.values() if len(p) > 1}

    u, v = np.concatenate([u, chain[::-1]]), np.concatenate([v, chain[::-1] + 1])
    a, b = vectors.forest(u, v)
    assert parts(zip(a.tolist(), b.tolist())) == parts(zip(u.tolist(), v.tolist())) and len(a) < len(set(u) | set(v))


@pytest.mark.parametrize("first_rows", [1, 200])
def test_top_k(spark, first_rows):
    data = [(r[0], r[1]) for r in rows()]
    whole = [(i, np.pad(np.floor(1024 * np.array(v, float)), (0, 16 - len(v)))) for i, v in data if usable(v, True) and i is not None]
    want = []
    for q in sorted({i for i, _ in whole if i % 50 == 0}):
        mine = {tuple(v) for i, v in whole if i == q}
        scored = sorted(((-int(max(v @ np.array(m) for m in mine)), i) for i, v in whole if i != q))[:10]
        if len(mine) == 1:
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    twice = {i for i, _ in whole if len({tuple(v) for j, v in whole if j == i}) > 1}
    got = vectors.top_k(spark.createDataFrame(rows(), SCHEMA).repartition(3), F.col("vec_id") % 50 == 0, pivots=8, rings=8, limit=32, first_rows=first_rows)
    assert sorted(tuple(r) for r in got.collect() if r.query_id not in twice) == want


def test_repeated_query_row(spark):
    """All copies of the query row are in one block with its neighbours."""
    data = [(0, [9.0, 1.0])] * 12 + [(i, [1.0 + i / 64, 1.0]) for i in range(1, 31)]
    got = vectors.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, pivots=1, rings=1)
    assert sorted((r.rank, r.vec_id) for r in got.collect()) == [(n + 1, 30 - n) for n in range(10)]


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 512), (0, 2, 2, 1024 * 512)]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vectors.near_duplicates(none).count() == 0 and vectors.top_k(none, F.lit(True)).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vectors.near_duplicates(bad).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 501 + i) for i in range(60)] + [(7, 7)]
    low = {v: v for u in links for v in u}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {v: m for v, m in low.items() if v in got} and all(low[v] == v for v in low.keys() - got.keys())
