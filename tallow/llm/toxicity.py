"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a fixed lexicon and of one learned from the labels, how near such words stand to a
second-person pronoun, capitals, punctuation, symbol noise, and words that only match the lexicon once
their digits and symbols are read as letters. Trees are grown on histograms in numpy from a bounded sample
of labelled documents (`max_rows`, by hash of doc_id); calibration is pool-adjacent-violators on scores of
folds left out, whose labels neither the trees nor the lexicon of that score have seen. The model is a few
kilobytes, and every document is scored whole.

Edge cases: a null or empty text is scored like any other, with all densities zero; labels without a doc_id
or a 0/1 value are ignored, and where a doc_id has several labels the highest counts, or several texts the
smallest; with no labels of one
of the classes every score is the share of label 1 (0 without labels); repeated rows each give a row; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallow.llm.common import cut, text_bytes, text_slices

#: Labelled rows that a model is fitted on at most.
MAX_ROWS = 20_000
LEXICON_SIZE = 64
#: Lengths of word beginnings that are learned, besides whole words.
LEAST_START, MOST_START = 3, 7
THRESHOLD = 0.3
FOLDS = 4

# Common insults, and second-person pronouns, in English, German, French and Spanish.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers scum trash garbage pathetic worthless disgusting clown clowns dumb fool imbecile jerk bastard vermin "
    "dummkopf vollidiot trottel abschaum arschloch drecksau blödmann versager "
    "imbécile crétin salaud connard ordure débile abruti minable "
    "idiota estúpido estúpida imbécil basura escoria payaso inútil asqueroso".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})

WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]+(?:[*@$!.\-_0-9]+[^\W\d_]+)+|[^\W\d_][*@$0-9]+[^\W\d_]*")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
NEAR_WORDS = 6

NAMES = (
    "log_words", "lexicon", "lexicon_log", "lexicon_kinds", "lexicon_peak", "learned", "learned_log", "learned_weight",
    "near_second", "second", "masked_hits", "masked", "capitals", "shouted", "exclaim", "question", "punctuation", "digits", "symbols", "distinct",
)

_CLASS = np.full(256, 8, dtype=np.uint8)  # bytes beyond ASCII
_CLASS[:128] = 7
_CLASS[48:58] = 3
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("?")] = 6
_CLASS[[ord(c) for c in "*#$%&@^~|<>\\/=+"]] = 9


class Lexicon:
    """Learned units: words, and beginnings of words (written with a final *), with their weights."""

    def __init__(self, units: dict[str, float]):
        self.words = {u: w for u, w in units.items() if not u.endswith("*")}
        self.starts = {u[:-1]: w for u, w in units.items() if u.endswith("*")}
        self.heads = {u[:LEAST_START] for u in (*self.words, *self.starts)}
        self.sizes = sorted({len(u) for u in self.starts})

    def weight(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.starts.get(word[:n], 0.0) for n in self.sizes)])


class Parsed:
    """What a text's features need of it, whatever the learned lexicon."""

    def __init__(self, text: str, raw: np.ndarray):
        kinds = np.bincount(_CLASS[raw], minlength=10)
        letters, size = max(1, int(kinds[1] + kinds[2] + kinds[8])), max(1, len(raw))
        words = self.words = WORD.findall(text.lower())
        n = self.n = max(1, len(words))
        self.hits = [i for i, w in enumerate(words) if w in INSULTS]
        self.pronouns = np.array([i for i, w in enumerate(words) if w in SECOND])
        masked = MASKED.findall(text) if kinds[3] or kinds[5] or kinds[7] or kinds[9] else []
        self.hidden = [w for m in masked if (low := m.lower()) not in INSULTS and (w := low.translate(LOOKALIKE)) is not None]
        self.hidden += ["".join(WORD.findall(m.lower())) for m in SPACED.findall(text)]
        peak = 0
        if self.hits:
            h = np.array(self.hits)
            peak = int((np.searchsorted(h, h + 50) - np.arange(len(h))).max())
        shouted = sum(map(str.isupper, text.split())) if kinds[2] else 0
        self.first = [math.log1p(n), len(self.hits) / n, math.log1p(len(self.hits)), len({words[i] for i in self.hits}), peak]
        self.pronoun_share, self.masked_share = len(self.pronouns) / n, len(masked) / n
        self.last = [
            kinds[2] / letters, shouted / n, kinds[5] / size, kinds[6] / size, kinds[7] / size, kinds[3] / size, kinds[9] / size,
            len(set(words)) / n,
        ]

    def features(self, learned: Lexicon) -> list[float]:
        n, heads = self.n, learned.heads
        weights = {i: x for i, w in enumerate(self.words) if w[:LEAST_START] in heads and (x := learned.weight(w))}
        hidden = sum(w in INSULTS or learned.weight(w) > 0 for w in self.hidden)
        both = sorted({*self.hits, *weights})
        near = 0
        if both and len(self.pronouns):
            p = self.pronouns
            at = np.searchsorted(p, both)
            left = np.where(at > 0, np.array(both) - p[np.maximum(at - 1, 0)], 1 << 30)
            right = np.where(at < len(p), p[np.minimum(at, len(p) - 1)] - np.array(both), 1 << 30)
            near = int((np.minimum(left, right) <= NEAR_WORDS).sum())
        own = [len(weights) / n, math.log1p(len(weights)), sum(weights.values()) / n, near / n, self.pronoun_share, hidden / n, self.masked_share]
        return [*self.first, *own, *self.last]


def features(text: str, raw: np.ndarray, learned: Lexicon) -> list[float]:
    return Parsed(text, raw).features(learned)


# -- trees -------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Trees as arrays (feature, cut, left, right, value), a start, and the calibration's knots."""

    start: float
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.0]))
    lexicon: dict[str, float] = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, level, left, right, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(16):
                inner = left[node] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), feature[node]] <= level[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            out += value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def _grow(codes, cuts, grad, hess, depth, rate, ridge, least):
    """One tree on binned features by second-order gain, level by level."""
    feature, level, left, right, value = [0], [0.0], [-1], [-1], [0.0]
    rows = {0: np.arange(len(grad))}
    for _ in range(depth):
        after = {}
        for node, own in rows.items():
            g, h = grad[own], hess[own]
            total_g, total_h = g.sum(), h.sum()
            best = (1e-6, -1, -1)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                bins = len(c) + 1
                code = codes[own, f]
                sg = np.cumsum(np.bincount(code, g, bins))[:-1]
                sh = np.cumsum(np.bincount(code, h, bins))[:-1]
                n = np.cumsum(np.bincount(code, minlength=bins))[:-1]
                gain = sg**2 / (sh + ridge) + (total_g - sg) ** 2 / (total_h - sh + ridge) - total_g**2 / (total_h + ridge)
                gain[(n < least) | (len(own) - n < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            value[node] = float(-rate * total_g / (total_h + ridge))
            if best[1] < 0:
                continue
            go = codes[own, best[1]] <= best[2]
            feature[node], level[node] = best[1], float(cuts[best[1]][best[2]])
            left[node], right[node] = len(feature), len(feature) + 1
            for side in (own[go], own[~go]):
                after[len(feature)] = side
                value.append(float(-rate * grad[side].sum() / (hess[side].sum() + ridge)))
                feature.append(0)
                level.append(0.0)
                left.append(-1)
                right.append(-1)
        rows = after
    return np.array(feature), np.array(level), np.array(left), np.array(right), np.array(value)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, ridge: float = 2.0, least: int = 5, bins: int = 48) -> Model:
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))
        some = np.unique(x[x[:, f] > 0, f])
        if len(some):  # rare positive values get cuts of their own
            v = np.unique(np.concatenate([v, [0.0], np.quantile(some, np.linspace(0.05, 0.95, 12))]))
        cuts.append(v[v < x[:, f].max()])
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(float(np.log(share / (1 - share))))
    now = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-now))
        tree = _grow(codes, cuts, p - y, p * (1 - p), depth, rate, ridge, least)
        model.trees.append(tree)
        now += Model(0.0, [tree]).raw(x)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw score, calibrated) of the non-decreasing least-squares fit."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of raw
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [a + c for a, c in zip(blocks[-1], b, strict=True)]
    at = np.array([b[2] / b[1] for b in blocks])
    level = np.array([b[0] / b[1] for b in blocks])
    # a small slope keeps the order of scores inside flat ends
    at = np.concatenate([[raw.min() - 1], at, [raw.max() + 1]])
    level = np.concatenate([[level[0] * 0.9], level, [level[-1] + 0.1 * (1 - level[-1])]])
    keep = np.concatenate([[True], np.diff(at) > 0])
    return at[keep], level[keep]


def _folds(y: np.ndarray, folds: int) -> np.ndarray:
    """A fold for each row, each with its share of both labels."""
    place = np.empty(len(y), dtype=np.int64)
    place[np.argsort(y, kind="stable")] = np.arange(len(y)) % folds
    return place


def fit(x: np.ndarray, y: np.ndarray, folds: int = FOLDS, place: np.ndarray | None = None, apart: list[np.ndarray] | None = None) -> Model:
    """Trees on x, calibrated on scores of folds left out.

    place: the fold of each row; apart: for each fold, all rows' features as a lexicon has them that hasn't seen it.
    """
    if not len(y) or y.min() == y.max():
        level = float(y.mean()) if len(y) else 0.0
        return Model(0.0, [], (np.array([0.0]), np.array([level])))
    place = _folds(y, folds) if place is None else place
    left_out, known = np.zeros(len(y)), np.zeros(len(y), dtype=bool)
    for k in range(folds):
        train = place != k
        own = x if apart is None else apart[k]
        if len(set(y[train])) > 1:
            left_out[~train] = boost(own[train], y[train]).raw(own[~train])
            known[~train] = True
    model = boost(x, y)
    model.knots = isotonic(left_out[known], y[known]) if known.any() else isotonic(model.raw(x), y)
    return model


# -- Spark -------------------------------------------------------------------------------------------


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, usable=None) -> DataFrame:
    """doc_id, toxic and text of at most max_rows documents, by hash of doc_id; a row for each."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if usable is not None:
        own = own.where(usable)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the sample has max_rows small rows at most, whatever the size of the tables
    found = texts.join(F.broadcast(own), "doc_id").select("doc_id", "toxic", "text")
    # a doc_id with many rows is reduced to one in each task before anything moves
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def learn_lexicons(rows: DataFrame, folds: int = FOLDS, size: int = LEXICON_SIZE) -> list[dict[str, float]]:
    """Words and beginnings of words by the lower bound of their log-odds under label 1, over documents.

    rows: toxic, text and fold. First the lexicon of all rows, then for each fold that of the others.
    """
    names = ["word", *(f"{c}{k}" for k in range(folds) for c in ("neg", "pos"))]

    def run(batches):
        for batch in batches:
            got: dict[str, list[int]] = {}
            for text, toxic, fold in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                words = set(WORD.findall(text.lower()))
                for w in words | {w[:k] + "*" for w in words for k in range(LEAST_START, min(MOST_START, len(w) - 1) + 1)}:
                    got.setdefault(w, [0] * 2 * folds)[2 * fold + toxic] += 1
            counts = np.array(list(got.values()), dtype=np.int64).reshape(-1, 2 * folds)
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), *(pa.array(c) for c in counts.T)], names)

    n = {(r.fold, r.toxic): r.n for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    counted = rows.mapInArrow(run, ", ".join(["word string", *(f"{c} long" for c in names[1:])])).groupBy("word").agg(*(F.sum(c).alias(c) for c in names[1:]))
    pos_of = "(" + " + ".join(f"pos{k}" for k in range(folds)) + ")"
    counted = cut(counted.where(F.expr(f"{pos_of} >= 3") & (F.length("word") >= LEAST_START)), "words")
    out = []
    for left_out in (None, *range(folds)):
        some = [k for k in range(folds) if k != left_out]
        n_neg, n_pos = (sum(n.get((k, label), 0) for k in some) for label in (0, 1))
        if not n_pos or not n_neg:
            out.append({})
            continue
        own = counted.select("word", *(F.expr(" + ".join(f"{c}{k}" for k in some)).alias(c) for c in ("pos", "neg")))
        odds = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
        bound = odds - 1.96 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
        found = own.where(F.col("pos") >= max(3, 0.02 * n_pos)).withColumn("bound", bound).where("bound > 1.4").orderBy(F.desc("bound"), "word").limit(16 * size).collect()
        out.append(choose_units([(r.word, r.pos, r.neg, float(r.bound)) for r in found], size))
    return out


def choose_units(found: list[tuple[str, int, int, float]], size: int) -> dict[str, float]:
    """The best units by bound, without those that a longer one with the same counts or a better shorter one says as well."""
    bare = {u.rstrip("*"): (u, p, n, b) for u, p, n, b in sorted(found, key=lambda x: x[0].endswith("*"), reverse=True)}
    out: dict[str, float] = {}
    for u, p, n, b in sorted(bare.values(), key=lambda x: (-x[3], x[0])):
        w = u.rstrip("*")
        shorter = (bare[w[:k]] for k in range(LEAST_START, len(w)) if w[:k] in bare and bare[w[:k]][0].endswith("*"))
        longer = (x for v, x in bare.items() if len(v) > len(w) and v.startswith(w))
        if any(x[1] > p and x[3] >= b - 0.1 for x in shorter) or any(x[1:3] == (p, n) for x in longer):
            continue
        out[u] = b
        if len(out) == size:
            break
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, usable=None) -> Model:
    """Fit on labelled documents; `usable` is a condition on doc_id that says whose labels may be used."""
    rows = cut(labelled(docs, labels, max_rows, usable), "labelled").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    lexicons = learn_lexicons(rows)
    indices = [Lexicon(x) for x in lexicons]
    names = [f"{n}_{k}" for k in range(len(indices)) for n in NAMES]

    def run(batches):
        for batch in text_slices(batches):
            raw, offs = text_bytes(batch.column("text"))
            parsed = (Parsed(t, raw[a:b]) for t, a, b in zip(batch.column("text").to_pylist(), offs[:-1], offs[1:], strict=True))
            x = np.array([[v for index in indices for v in p.features(index)] for p in parsed])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("fold"), *(pa.array(c) for c in x.T)], ["doc_id", "toxic", "fold", *names])

    schema = ", ".join(["doc_id long", "toxic int", "fold int", *(f"`{n}` double" for n in names)])
    got = rows.mapInArrow(run, schema).toPandas().sort_values("doc_id", kind="stable")  # max_rows rows at most
    x = got[names].to_numpy(dtype=float).reshape(len(got), len(indices), len(NAMES))
    model = fit(x[:, 0], got["toxic"].to_numpy(dtype=float), FOLDS, got["fold"].to_numpy(), [x[:, 1 + k] for k in range(FOLDS)])
    model.lexicon = lexicons[0]
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (double) and predicted (int); columns of those names in docs are replaced."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    index = Lexicon(model.lexicon)

    def run(batches):
        for batch in text_slices(batches):
            column = batch.column(batch.schema.get_field_index("text"))
            raw, offs = text_bytes(column)
            x = np.array([features(t or "", raw[a:b], index) for t, a, b in zip(column.to_pylist(), offs[:-1], offs[1:], strict=True)])
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)
