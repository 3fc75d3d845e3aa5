import math

import numpy as np
import pytest

from tallow.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score long, kind int"


def brute(rows, k):
    """Every row but the query's own is a candidate, rows with the same vec_id among them."""
    good = [(v, [math.floor(256 * x) for x in e]) for v, e in rows if v is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (q, own) in enumerate(good):
        if q % 50 == 0:
            scored = sorted((-max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(own, e, strict=True)))), v) for j, (v, e) in enumerate(good) if j != i and len(e) == len(own))
            out += [(q, r, v, -s) for r, (s, v) in enumerate(scored[:k], 1)]
    return sorted(out)


def got(spark, rows, k=5, **more):
    v = topk.vectors_of(spark.createDataFrame([(a, b, 1, 2) for a, b in rows], SCHEMA).repartition(3))
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(v.where("vec_id % 50 = 0"), v, k, **more).collect())


@pytest.mark.parametrize(("seed", "n", "dim", "block"), [(1, 700, 64, 4096), (2, 400, 7, 3), (3, 300, 1, 4096), (4, 900, 33, 5)])
def test_equals_brute_force(spark, seed, n, dim, block):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, (centres[i % 5] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(120)]  # ties
    rows += [(50, rows[3][1]), (2000, None), (2050, []), (2100, [float("nan")] * dim), (2150, [None] * dim), (2200, [math.inf] + [0.0] * (dim - 1)), (None, rows[1][1]), (2250, [1.0] * (dim + 1)), (2251, [0.5] * (dim + 1))]
    assert got(spark, rows, block=block) == brute(rows, 5)


def test_huge_components_stay_exact(spark):
    rows = [(i, [1e12 + i, -3.0 * i, 2.0**40]) for i in range(60)]
    with_big = [(v, [x / 2**18 for x in e]) for v, e in rows]
    assert got(spark, with_big) == brute(with_big, 5)
    far = rows + [(100, [-1e12, 0.0, -(2.0**40)])]
    assert got(spark, far) == brute(far, 5)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, x = np.floor(256 * rng.normal(size=(20, 64))), np.floor(256 * rng.normal(size=(50, 64)))
    exact, last = q @ x.T, None
    for n in topk.LEVELS:
        bound = topk.stretch_stats(q, n) @ topk.stretch_stats(x, n).T
        assert (bound >= exact - 1e-6).all() and (last is None or (bound <= last + 1e-6).all())
        last = bound


def test_few_and_none(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]


def test_repeated_rows_are_candidates_of_each_other(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.5, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.25, 1.0])]
    assert got(spark, rows) == brute(rows, 5)


@pytest.mark.parametrize("least", [8, 64])
def test_many_parts_and_a_hot_vector(spark, monkeypatch, least):
    monkeypatch.setattr(topk, "PART_LEAST", least)
    monkeypatch.setattr(topk, "PART_BYTES", least * 16 * 8)
    rng = np.random.default_rng(6)
    hot = rng.normal(size=16).tolist()
    rows = [(i, hot if i % 3 else rng.normal(size=16).tolist()) for i in range(900)]
    assert got(spark, rows, block=7) == brute(rows, 5)


def clustered(n, dim=64, clusters=40, noise=0.05, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + noise * rng.normal(size=(n, dim))
    return np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])


def test_bounds_leave_few_pairs_of_clustered_vectors():
    x = clustered(20_000)
    ids = np.arange(len(x))
    seeds = topk.Seeds([], [], None, 5)
    some = ids[:: topk.SEED_SHARE]
    seeds.parts[64] = topk.Part(some, some, x[some])
    seeds.centre[64] = np.median(topk.means_and_deviations(x[some], topk.SIGNS)[0], axis=0)
    order = np.argsort(seeds.cells(x), kind="stable")
    part = topk.Part(ids[order], ids[order], x[order])
    q = ids[::50]
    best = topk.Best(q, x[q], 5, seeds.floors(q, x[q]))
    part.search(best)
    assert best.pairs == len(q) * len(x) and best.scored < 0.2 * best.pairs
    scores = (x[q] @ x.T).astype(int)
    scores[np.arange(len(q)), q] = -(10**9)
    for i in range(0, len(q), 20):
        want = sorted((-s, j) for j, s in enumerate(scores[i].tolist()))[:5]
        assert [t[:2] for t in best.top[i]] == want


def test_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(topk, "PART_BYTES", 800 * 8)
    monkeypatch.setattr(topk, "PART_LEAST", 100)
    box = [[0.0]] * 3
    plan = topk.Plan([(c, 8, n, *box, 1.0) for c, n in enumerate([10, 20, 90, 350, 5, 95, 40])] + [(0, 3, 7, *box, 1.0)])
    held = {}
    for (c, dim), (first, n) in plan.where.items():
        for p in range(first, first + n):
            held.setdefault(p, []).append((c, dim))
    assert sorted(held) == list(range(plan.count)) and plan.where[3, 8][1] == 4
    sizes = dict(enumerate([10, 20, 90, 350, 5, 95, 40]))
    assert all(len({d for _, d in own}) == 1 and sum(sizes[c] // plan.where[c, 8][1] for c, d in own if d == 8) <= 100 for own in held.values())


def test_nothing_reaches_the_floor():
    x = np.array([[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * 30)
    part = topk.Part(np.arange(30), np.arange(30), x)
    best = topk.Best(np.array([99]), x[:1], 5, [(-92, 3)])
    part.search(best)
    assert best.top == [[]]
    best = topk.Best(np.array([99]), x[:1], 5, [(-91, 3)])
    part.search(best)
    assert [t[:2] for t in best.top[0]] == [(-91, 0), (-91, 1), (-91, 2), (-91, 3)]
