import numpy as np
import pytest

from tallow.llm import toxicity


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = ["ba", "lo", "mir", "ten", "sol", "ker", "you", "and", "the"]
    rows, labels = [], []
    for i in range(n):
        w = [str(x) for x in rng.choice(words, int(rng.integers(20, 120)))]
        toxic = i % 6 == 0
        if toxic:
            for k in rng.integers(0, len(w), 5):
                w[int(k)] = str(rng.choice(["grobnik", "IDIOT", "st*pid", "zork"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus(400, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), usable="doc_id % 4 <> 2")


def test_held_out_accuracy(spark, trained):
    rows, labels = corpus(300, 2)
    rows += [(900, None), (901, ""), (902, "ba " * 60_000), (902, "ba " * 60_000), (None, "you idiot, you utter moron, you are scum")]
    docs = spark.createDataFrame([(a, b, 7.0, "x") for a, b in rows], "doc_id long, text string, score double, predicted string")
    out = toxicity.score(docs, trained)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and dict(out.dtypes)["score"] == "double" and dict(out.dtypes)["predicted"] == "int"
    hits = sum((got[i].predicted == 1) == bool(t) for i, _, t in labels)
    assert hits >= 0.97 * len(labels)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[900].score == got[901].score and got[902].predicted == 0 and got[None].predicted == 1
    assert "grobnik" in trained.lexicon and toxicity.score(docs.limit(0), trained).count() == 0


def test_one_class_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels, level in (([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1), (None, 0), (1, None), (1, 0)], 1.0)):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.score(docs, model).collect()} == {level}


def test_sample_is_bounded(spark):
    rows, labels = corpus(100, 3)
    docs, own = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.labelled(docs, own, 30).count() == 30


def test_isotonic_and_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=500) > 0.5).astype(float)
    model = toxicity.fit(x, y)
    s = model.score(x)
    assert ((s >= 0.5) == (y == 1)).mean() > 0.9
    at, level = toxicity.isotonic(model.raw(x), y)
    assert (np.diff(at) > 0).all() and (np.diff(level) >= 0).all() and 0 <= level[0] and level[-1] <= 1


def test_units_say_different_things():
    found = [("trash", 50, 0, 4.0), ("tra*", 50, 0, 4.0), ("tras*", 50, 0, 4.0), ("achlicher", 16, 0, 2.7), ("achliche*", 35, 1, 3.5), ("achlich*", 66, 2, 3.9), ("zork", 9, 0, 2.0)]
    assert toxicity.choose_units(found, 10) == {"trash": 4.0, "achlich*": 3.9, "zork": 2.0}
    own = toxicity.Lexicon({"trash": 4.0, "achlich*": 3.9})
    assert [own.weight(w) for w in ("trash", "trashy", "achlichst", "achli", "x")] == [4.0, 0.0, 3.9, 0.0, 0.0]


def test_one_row_for_each_document(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "x")] + [(3, "same")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (3, 1), (9, 1)], "doc_id long, toxic int")
    rows = sorted((r.doc_id, r.toxic, r.text) for r in toxicity.labelled(docs, labels).collect())
    assert rows == [(1, 1, ""), (2, 0, "x"), (3, 1, "same")]


def test_a_fold_is_calibrated_by_a_lexicon_that_has_not_seen_it(spark):
    rows = [(i, f"word{'abcdefgh'[i % 8]} said here once" if i % 2 else "nothing at all", i % 2, i // 2 % 4) for i in range(400)]
    rows += [(1000 + i, "secretword in one fold", 1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int")
    whole, *apart = toxicity.learn_lexicons(df)
    assert any("secret" in u for u in whole) and any("secret" in u for u in apart[0]) and not any("secret" in u for u in apart[2])
    for k, own in enumerate(apart):
        alone, *_ = toxicity.learn_lexicons(df.where(f"fold <> {k}"))
        assert own == alone


def best_stump(x, y, ridge, least):
    """The split of the greatest second-order gain, by trying every one."""
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (0.0, None)
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            go = x[:, f] <= c
            if go.sum() < least or (~go).sum() < least:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (go, ~go)) - g.sum() ** 2 / (h.sum() + ridge)
            if gain > best[0] + 1e-12:
                best = (gain, go, [-g[s].sum() / (h[s].sum() + ridge) for s in (go, ~go)])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_a_tree_equals_exhaustive_search(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (40, 3)).astype(float)
    y = ((x[:, seed % 3] > 4) ^ (rng.random(40) < 0.1)).astype(float)
    model = toxicity.boost(x, y, trees=1, depth=1, rate=1.0, ridge=2.0, least=5)
    _, go, values = best_stump(x, y, 2.0, 5)
    want = model.start + np.where(go, values[0], values[1])
    assert np.allclose(model.raw(x), want)


@pytest.mark.parametrize("seed", range(6))
def test_isotonic_equals_its_definition(seed):
    """The fit at i is the greatest, over starts a <= i, of the least mean over ends b >= i."""
    rng = np.random.default_rng(seed)
    raw, y = np.sort(rng.normal(size=30)), rng.integers(0, 2, 30).astype(float)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    at, level = toxicity.isotonic(raw, y)
    inner = dict(zip(np.round(level[1:-1], 9), at[1:-1], strict=True))
    assert sorted(inner) == sorted(set(np.round(want, 9)))
    for v, place in inner.items():
        assert np.isclose(place, raw[np.isclose(want, v)].mean())


def plain_features(text):
    """Lexicon densities and shares, counted one by one."""
    import re

    words = re.findall(r"[^\W\d_]+", text.lower())
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in toxicity.INSULTS]
    near = sum(any(abs(i - j) <= 6 for j, v in enumerate(words) if v in toxicity.SECOND) for i in hits)
    letters = [c for c in text.encode() if chr(c).isalpha() and c < 128 or c >= 128]
    return {"lexicon": len(hits) / n, "lexicon_kinds": len({words[i] for i in hits}), "near_second": near / n, "second": sum(w in toxicity.SECOND for w in words) / n,
            "capitals": sum(65 <= c <= 90 for c in letters) / max(1, len(letters)), "exclaim": text.count("!") / max(1, len(text.encode())), "distinct": len(set(words)) / n}


def test_features_equal_plain_counts():
    rng = np.random.default_rng(3)
    words = ["you", "idiot", "Stupid!", "und", "du", "Trottel", "Baum", "été", "a1b", "WHY?", "x", "moron,"]
    for size in (0, 1, 5, 60, 400):
        text = " ".join(str(w) for w in rng.choice(words, size))
        got = dict(zip(toxicity.NAMES, toxicity.features(text, np.frombuffer(text.encode(), np.uint8), toxicity.Lexicon({})), strict=True))
        for name, v in plain_features(text).items():
            assert np.isclose(got[name], v), (name, text)
