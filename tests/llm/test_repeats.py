import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallow.llm import repeats

SCHEMA = "doc_id long, text string, spans string, text_key int"


def brute(rows, length):
    """Cover by every string that starts in two places, string by string."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((-1 if d is None else d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(spark, rows, length, seed, **more):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA).repartition(3)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, length, seed, **more).collect())


def corpus(seed, n=60, size=300):
    rng = np.random.default_rng(seed)
    letters = list("abcdefé \n")

    def noise(k):
        return "".join(rng.choice(letters, k))

    shared = [noise(int(k)) for k in rng.integers(15, 90, 6)]
    rows = []
    for i in range(n):
        parts = [noise(int(rng.integers(0, size)))]
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(len(shared)))]
            a = int(rng.integers(0, len(s) // 2))
            parts += [s[a : a + int(rng.integers(10, 90))], noise(int(rng.integers(0, 40)))]
        rows.append((i, "".join(parts)))
    rows += [(n, "a" * 200), (n + 1, "ab" * 90), (n + 2, "a" * 70 + "b" + "a" * 80), (n + 3, rows[3][1]), (n + 4, rows[3][1]), (n + 5, ""), (n + 6, None), (None, rows[5][1][:120]), (n + 7, "abc" * 50 + noise(50) + "abc" * 40)]
    rows += [(n + 8, "x"), (n + 8, "x")]
    return rows


@pytest.mark.parametrize(("seed", "length", "part"), [(1, 40, 8), (2, 25, 10), (3, 60, 32), (4, 16, 16)])
def test_equals_brute_force(spark, seed, length, part):
    rows = corpus(seed)
    assert got(spark, rows, length, part) == brute(rows, length)


def test_hot_anchors_go_string_by_string(spark):
    rows = corpus(6)
    assert got(spark, rows, 30, 8, group=3) == brute(rows, 30)


def test_production_parameters(spark):
    rng = np.random.default_rng(9)
    words = np.array(["the", "of", "tion", "er", "und", "é", "ing."])
    base = " ".join(rng.choice(words, 400))
    rows = [(i, " ".join(rng.choice(words, 30)) + base[i : i + 150 + 12 * i] + " ".join(rng.choice(words, 60))) for i in range(40)]
    assert got(spark, rows, 200, 32) == brute(rows, 200)


def test_empty_table(spark):
    assert got(spark, [], 200, 32) == []


def test_intervals_hold_all_occurrences():
    text = b"mississippi"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0] + [next((k for k in range(20) if text[a : a + k + 1] != text[b : b + k + 1] or a + k >= 11 or b + k >= 11), 0) for a, b in zip(order, order[1:], strict=False)]
    found = {text[order[first] : order[first] + size]: sorted(order[first : last + 1]) for size, first, last in repeats.intervals(common)}
    assert found[b"issi"] == [1, 4] and found[b"i"] == [1, 4, 7, 10] and found[b"s"] == [2, 3, 5, 6]


def same_hashes(monkeypatch, keep):
    """Seeds whose hashes agree in all but `keep` bits, so that ties and near ties are everywhere."""
    whole = repeats.seed_hashes
    monkeypatch.setattr(repeats, "seed_hashes", lambda raw, seed: whole(raw, seed) & np.uint64(keep))


@pytest.mark.parametrize("keep", [0, 0x3, 0xFF, 0xF << 40, 0xFFFFF])
def test_an_anchor_depends_on_the_string_alone(monkeypatch, keep):
    same_hashes(monkeypatch, keep)
    rng = np.random.default_rng(3)
    own = rng.integers(97, 100, 40).astype(np.uint8)
    places = set()
    for before in (0, 1, 5, 63, 64, 1000, 70_000, 1 << 21):
        raw = np.concatenate([rng.integers(97, 100, before).astype(np.uint8), own, rng.integers(97, 100, before // 3).astype(np.uint8)])
        _, _, at, first, last = repeats.anchors(raw, np.array([0, len(raw)]), 40, 8)
        k = int(np.flatnonzero((first <= before) & (last >= before))[0])
        places.add(int(at[k]) - before)
    assert len(places) == 1


@pytest.mark.parametrize("keep", [0, 0x7, (1 << 64) - 1])
def test_long_texts_in_pieces(spark, monkeypatch, keep):
    same_hashes(monkeypatch, keep)
    monkeypatch.setattr(repeats, "SLICE", 170)
    rows = corpus(7, n=25)
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA).repartition(3)
    texts = repeats._long_texts(df, 30)
    seen = list(repeats.pieces(iter([pa.RecordBatch.from_pandas(texts.select("text", "text_key").toPandas())]), 30, 170, set()))
    assert max(len(raw) for raw, *_ in seen) <= 170 + 30 and any(int(begin[0]) for *_, begin in seen)
    batch = pa.RecordBatch.from_pandas(texts.select("text", "text_key").toPandas())
    found = [(k, int(a + b)) for raw, offs, keys, begin in repeats.pieces(iter([batch]), 30, 170, set()) for t, _, _, f, z in zip(*repeats.anchors(raw, offs, 30, 8)) for k, b in [(keys[t], begin[t] - offs[t])] for a in range(f, z + 1)]
    lengths = {r.text_key: len(r.text.encode()) for r in texts.collect()}
    assert sorted(found) == sorted((bytes(k), i) for k, n in lengths.items() for i in range(n - 29))


def test_hot_strings_are_many(spark):
    base = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 90))
    rows = [(i, f"{i:05d}" * 3 + base) for i in range(700)]
    assert got(spark, rows, 30, 8, group=20) == brute(rows, 30)


def test_a_text_of_many_megabytes(spark):
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 123, 6_000_000).astype(np.uint8)
    raw[5_000_000:5_001_000] = raw[1_000_000:1_001_000]
    rows = [(1, raw.tobytes().decode()), (2, raw[(1 << 21) - 300 : (1 << 21) + 300].tobytes().decode())]
    out = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (2600, 3), 2: (600, 1)}


def test_groups_are_maximal_and_hold_all_occurrences(spark):
    rows = [(1, "xx0123456789abcdefyy"), (2, "zz0123456789abcdefyy"), (3, "q0123456789ab"), (4, None), (5, "0123456789ab"), (6, "0123456789ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = {r.text_key: (r.text or "") for r in df.select("text", repeats._key().alias("text_key")).collect()}
    groups = {}
    for r in repeats.repeat_groups(df, 12, 8).collect():
        groups.setdefault(bytes(r.repeat), []).append((text[r.text_key][r.start : r.start + r.size], r.doc_id, r.start))
    by_string = {}
    for own in groups.values():
        assert len({s for s, _, _ in own}) == 1 and len(own) > 1
        by_string[own[0][0]] = sorted((d, s) for _, d, s in own)
    assert by_string["0123456789ab"] == [(1, 2), (2, 2), (3, 1), (5, 0)]
    longer = [s for s in by_string if len(s) > 12]
    assert longer and all(by_string[s] == [(1, 2 + "0123456789abcdefyy".index(s)), (2, 2 + "0123456789abcdefyy".index(s))] for s in longer)
    covered = {d: set() for d, _ in rows}
    for s, own in by_string.items():
        for d, at in own:
            covered[d] |= set(range(at, at + len(s)))
    assert covered[1] == set(range(2, 20)) and covered[3] == set(range(1, 13))


@pytest.mark.parametrize("hot", [3, 10**6])
def test_groups_cover_what_is_removed(spark, hot):
    rows = [r for r in corpus(11, n=30) if r[0] is not None and r[0] not in (33, 34, 38)]
    df = spark.createDataFrame(rows, "doc_id long, text string").dropDuplicates(["text"])
    cover = {}
    for r in repeats.repeat_groups(df, 25, 8, group=hot).collect():
        cover.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.size))
    own = repeats.remove_repeats(df, 25, 8, group=hot).collect()
    assert {r.doc_id: len(cover.get(r.doc_id, ())) for r in own} == {r.doc_id: r.n_removed for r in own}
