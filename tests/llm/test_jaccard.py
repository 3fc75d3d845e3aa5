import re

import numpy as np
import pytest

from tallow.llm import graph, jaccard
from tallow.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, k string, n long, region string"


def brute(rows, words, percent):
    """(doc_id, size, component) of every row, by comparing all pairs of sets of strings."""
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def got(spark, rows, words, percent, **more):
    df = spark.createDataFrame([(a, b, "x", 1, "y") for a, b in rows], SCHEMA).repartition(3)
    out = jaccard.join(df, words, percent, **more).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out)


def corpus(seed, families=6, copies=14, size=60, changes=4):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = list(rng.choice(vocab, 25))
    rows = []
    for f in range(families):
        base = list(rng.choice(vocab, int(size * (0.5 + rng.random()))))
        if f % 2:
            base = base[:10] + passage + base[10:]
        for c in range(copies):
            own = list(base)
            for _ in range(int(rng.integers(0, changes))):
                own[int(rng.integers(len(own)))] = str(rng.choice(vocab)).upper()
            if c % 5 == 4:
                base = own  # chains: later copies start from a changed one
            rows.append((len(rows), "\t".join(own) if c % 2 else " ".join(own)))
    return rows


EDGES = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "two words"), (906, "two  words\n"), (None, "two words"), (907, "a b c d e"), (907, "a b c d e"), (None, None), (908, "é É"), (909, "É É")]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 60)])
def test_equals_brute_force(spark, seed, words, percent):
    rows = corpus(seed) + EDGES
    assert got(spark, rows, words, percent) == brute(rows, words, percent)


def test_cells_across_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 8)
    rows = corpus(5, families=3, copies=40)
    assert got(spark, rows, 4, 85, region_shingles=400) == brute(rows, 4, 85)


@pytest.mark.parametrize("seed", range(4))
def test_cells_within_a_task(seed):
    rows = corpus(seed, families=5, copies=40)
    raw = "".join(t for _, t in rows).encode()
    offs = np.cumsum([0, *(len(t.encode()) for _, t in rows)])
    sets = {s.tobytes(): s for s in shingle_sets(np.frombuffer(raw, np.uint8), offs, 4)}
    region = jaccard.Region(sorted(sets), [sets[k] for k in sorted(sets)])
    rule = jaccard.Rule(85)

    def parts(edges):
        u = jaccard.Union(len(sets))
        for a, b in edges:
            u.join(a, b)
        return [u.find(i) for i in range(len(sets))]

    assert parts(jaccard.join_region(region, rule, leaf=6, pivots=5)) == parts(jaccard.join_region(region, rule, leaf=10**6))


def test_rule():
    rule = jaccard.Rule(85)
    for n in range(1, 400):
        assert rule.missing(n) == n - -(-85 * n // 100)
        assert all(rule.shared(m) >= rule.needed(n) for m in range(-(-85 * n // 100), 100 * n // 85 + 1))


def test_empty_table(spark):
    assert got(spark, [], 4, 85) == []


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    u = jaccard.Union(2000)
    for a, b in pairs:
        u.join(a, b)
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert out == {n: u.find(n) for a, b in pairs if a != b for n in (a, b)}


def families(n, size, words=120, changes=3, seed=0):
    """n families of `size` near copies of a text each, as sets by key."""
    rng = np.random.default_rng(seed)
    sets = {}
    for _ in range(n):
        base = rng.integers(0, 1 << 60, words).astype(np.uint64)
        for _ in range(size):
            own = base.copy()
            own[rng.integers(0, words, int(rng.integers(0, changes)))] = rng.integers(0, 1 << 60, 1).astype(np.uint64)
            s = np.unique(own)
            sets[s.tobytes()] = s
    keys = sorted(sets)
    return keys, [sets[k] for k in keys]


def test_cells_save_scans():
    rule = jaccard.Rule(85)
    keys, sets = families(40, 60)
    cells, flat = jaccard.Region(keys, sets, rule), jaccard.Region(keys, sets, rule)
    a, b = jaccard.join_region(cells, rule), jaccard.join_region(flat, rule, leaf=10**6)
    assert len(a) == len(b) == len(sets) - 40
    assert cells.scans < 200 < len(sets) - 100 < flat.scans


def test_a_large_family_costs_few_scans():
    rule = jaccard.Rule(85)
    keys, sets = families(1, 30_000, words=60)
    region = jaccard.Region(keys, sets, rule)
    assert len(jaccard.join_region(region, rule)) == len(sets) - 1 and region.scans < 10


def test_close_sets_without_links_are_left_out():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 60, 20).astype(np.uint64)])) for _ in range(500)]
    region = jaccard.Region([s.tobytes() for s in sets], sets, jaccard.Rule(85))
    assert not len(region.at) and jaccard.join_region(region, jaccard.Rule(85)) == [] and region.scans == 0


@pytest.mark.parametrize(("seed", "limit"), [(8, 300), (9, 700), (10, 1500)])
def test_families_and_chains_across_the_cluster(spark, monkeypatch, seed, limit):
    rows = corpus(seed, families=2, copies=60, size=50, changes=3)
    rows += [(1000 + i, t + f" own{i} words{i} here{i}") for i, (_, t) in enumerate(rows[:30])]
    assert got(spark, rows, 4, 85, region_shingles=limit) == brute(rows, 4, 85)


def test_stuck_regions_pair_what_is_left(spark):
    rule = jaccard.Rule(85)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 60, 60)]
    sets = {}
    for i in range(150):
        own = list(base)
        for _ in range(int(rng.integers(0, 9))):
            own[int(rng.integers(60))] = int(rng.integers(0, 1 << 60))
        s = np.unique(np.array(own, dtype=np.uint64))
        sets[f"{i:016d}".encode()] = s
    keys = sorted(sets)
    members = spark.createDataFrame([("r", bytearray(k), bytearray(sets[k].tobytes())) for k in keys], "region string, k binary, own binary")
    for limit in (600, 2000):
        u, v = jaccard.Union(len(keys)), jaccard.Union(len(keys))
        for r in jaccard._join_regions(members, rule, limit).collect():
            i, j = keys.index(bytes(r.u)), keys.index(bytes(r.v))
            c = len(np.intersect1d(sets[keys[i]], sets[keys[j]]))
            assert rule.links(c, len(sets[keys[i]]), len(sets[keys[j]]))
            u.join(i, j)
        for i in range(len(keys)):
            for j in range(i):
                if rule.links(len(np.intersect1d(sets[keys[i]], sets[keys[j]])), len(sets[keys[i]]), len(sets[keys[j]])):
                    v.join(i, j)
        assert [u.find(i) for i in range(len(keys))] == [v.find(i) for i in range(len(keys))]
