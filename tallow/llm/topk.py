"""Exact top-k inner products by multi-resolution segment statistics.

A vector's stretch of L components with mean m and deviation s satisfies, against a query's,
sum q x <= L mq mx + L sq sx; summed over stretches this bounds the score from above (and, the norms being
known, the distance from below). Bounds run from coarse to fine:

* cells: candidates whose first-level means lie on the same sides of a centre. A cell's box (least and greatest
  mean and greatest deviation of each stretch) bounds all its candidates at once. There are at most 2 ** SIGNS
  cells, so their boxes are collected;
* chunks of a part's candidates, by their boxes in the same way;
* single candidates, by few stretches and then by many; survivors are scored exactly.

What a bound must reach is the query's floor. It starts from a bounded sample of candidates that every query is
scored against, so it is known before any candidate moves. Candidates are dealt once into parts of bounded size, by
cell; a query goes to those parts only that hold a cell whose bound reaches its floor. A task holds one part and
streams queries past it, giving out nothing below the floor.

Edge cases: vectors that are null, empty, or hold a null or non-finite component, and rows without a vec_id, take
no part; rows that repeat a vec_id, or vector, are rows of their own: each is a candidate of the others, and a query
if it is among the queries; vectors of another length than the query's are not its candidates; ties go to the smaller
vec_id; scores are exact, and those beyond a long's range count as its nearest end; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.common import cut

SCALE = 256
#: Queries that are scored together, at most.
BLOCK = 1024
#: Stretches of the cells' statistics, and of single candidates'.
SIGNS, LEVELS = 12, (4, 16, 32)
#: Bytes of vectors of a part, and fewest candidates worth a part of their own.
PART_BYTES, PART_LEAST = 64 << 20, 2048
CHUNK = 512
#: The sample that floors start from: one of so many candidates, and at most this many bytes.
SEED_SHARE, SEED_BYTES = 16, 8 << 20
#: Share of a chunk's pairs left above which its survivors' rows and columns are multiplied as matrices.
DENSE = 0.05
#: A long's range.
LEAST, MOST = -(2**63), 2**63 - 1


def _stretches(dim: int, parts: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), min(parts, dim))


def means_and_deviations(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(L) mean and sqrt(L) deviation of every vector's stretches, L being a stretch's length."""
    mean, dev = [], []
    for s in _stretches(x.shape[1], parts):
        own = x[:, s]
        m = own.mean(axis=1)
        mean.append(np.sqrt(len(s)) * m)
        dev.append(np.sqrt(np.maximum(0, (own * own).sum(axis=1) - len(s) * m * m)))
    return np.stack(mean, axis=1), np.stack(dev, axis=1)


def stretch_stats(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows of [sqrt(L) mean..., sqrt(L) deviation...] whose inner products are the bounds."""
    return np.concatenate(means_and_deviations(x, parts), axis=1)


class Boxes:
    """Bounds of groups of vectors of one length: least and greatest means, greatest deviations, greatest component."""

    def __init__(self, low: np.ndarray, high: np.ndarray, dev: np.ndarray, peak: np.ndarray):
        self.low, self.high, self.dev, self.peak = low, high, dev, peak

    @staticmethod
    def of(x: np.ndarray, begin: np.ndarray) -> Boxes:
        """Boxes of the runs of rows of x that start at begin."""
        m, s = means_and_deviations(x, SIGNS)
        at = np.minimum.reduceat, np.maximum.reduceat
        return Boxes(at[0](m, begin), at[1](m, begin), at[1](s, begin), at[1](np.abs(x).max(axis=1), begin))

    def one(self, i: int) -> Boxes:
        return Boxes(*(v[i : i + 1] for v in (self.low, self.high, self.dev, self.peak)))

    def reach(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Which of the groups (columns) may hold a score of at least the floor of each query (rows)."""
        m, s = means_and_deviations(q, SIGNS)
        bound = np.maximum(m, 0) @ self.high.T + np.minimum(m, 0) @ self.low.T + s @ self.dev.T
        return ~(bound < floor[:, None] - slack(q.shape[1], np.abs(q).max(axis=1)[:, None], self.peak[None, :]))


def slack(dim: int, a, b):
    """More than the rounding of a bound."""
    return 1 + 1e-9 * dim * a * b


class Best:
    """The k best of each query of a block so far, for vectors of one length: (-score, vec_id, row_id) in order.

    `floors` are the (-score, vec_id) that a candidate must not come behind; `pairs` and `scored` count what was met
    and what was scored.
    """

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, k: int, floors: list[tuple[int, int] | None] | None = None):
        self.rows, self.q, self.k = rows, vectors, k
        self.stats = [stretch_stats(vectors, n) for n in LEVELS if n < vectors.shape[1]]
        self.top: list[list[tuple[int, int, int]]] = [[] for _ in rows]
        self.last = floors or [None] * len(rows)
        self.floor = np.array([-np.inf if f is None or -f[0] <= LEAST else float(-f[0]) for f in self.last])
        self.pairs = self.scored = 0

    def feed(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, stats: list[np.ndarray], some: np.ndarray | None = None) -> None:
        """Take candidates (vec_ids, row_ids, vectors and their statistics) past the queries `some`, by default all."""
        some = np.arange(len(self.rows)) if some is None else some
        self.pairs += len(self.rows) * len(x)
        if not len(some):
            return
        limit = self.floor[some] - slack(x.shape[1], np.abs(self.q[some]).max(), np.abs(x).max())
        alive = np.ones((len(some), len(x)), dtype=bool)
        for n, own in enumerate(self.stats[: len(stats)]):
            own = own[some]
            if n == 0 or alive.mean() > DENSE:
                alive &= ~(own @ stats[n].T < limit[:, None])
            else:
                i, j = np.nonzero(alive)
                alive[i, j] = ~(np.einsum("ij,ij->i", own[i], stats[n][j]) < limit[i])
        self.scored += int(alive.sum())
        if alive.any():
            self._exact(ids, rows, x, some, alive)

    def _exact(self, ids, rows, x, some, alive) -> None:
        if x.shape[1] * max(np.abs(self.q).max(), 1) * max(np.abs(x).max(), 1) >= 2.0**52:  # beyond what doubles hold exactly
            qi, xi = ([[int(v) for v in row] for row in m.tolist()] for m in (self.q, x))
            found: dict[int, list] = {}
            for i, j in zip(*(v.tolist() for v in np.nonzero(alive)), strict=True):
                i = int(some[i])
                exact = sum(a * b for a, b in zip(qi[i], xi[j], strict=True))
                found.setdefault(i, []).append((-max(LEAST, min(MOST, exact)), int(ids[j]), int(rows[j])))
            for i, own in found.items():
                self._merge(i, own)
            return
        if alive.mean() > DENSE:
            a, b = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            scores = self.q[some[a]] @ x[b].T
            i, j = np.nonzero(alive[np.ix_(a, b)] & (scores >= self.floor[some[a]][:, None]))
            got = scores[i, j]
            i, j = some[a[i]], b[j]
        else:
            i, j = np.nonzero(alive)
            i = some[i]
            got = np.einsum("ij,ij->i", self.q[i], x[j])
            near = got >= self.floor[i]
            i, j, got = i[near], j[near], got[near]
        if not len(i):
            return
        order = np.lexsort((rows[j], ids[j], -got, i))
        i, j, got = i[order], j[order], got[order]
        begin = np.flatnonzero(np.diff(i, prepend=-1))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(i)], strict=True):
            b = min(b, a + self.k + 1)  # the query itself may be among them
            self._merge(int(i[a]), [(-int(s), int(v), int(r)) for s, v, r in zip(got[a:b], ids[j[a:b]], rows[j[a:b]], strict=True)])

    def _merge(self, i: int, new: list[tuple[int, int, int]]) -> None:
        own, last = int(self.rows[i]), self.last[i]
        self.top[i] = sorted([*self.top[i], *(p for p in new if p[2] != own and (last is None or p[:2] <= last))])[: self.k]
        if len(self.top[i]) == self.k:
            self.last[i] = self.top[i][-1][:2]
            worst = -self.last[i][0]
            self.floor[i] = float(worst) if worst > LEAST else -np.inf


class Part:
    """Candidates of one length that a task holds, in chunks with boxes and statistics."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.chunks = [(ids[i : i + CHUNK], rows[i : i + CHUNK], x[i : i + CHUNK]) for i in range(0, len(ids), CHUNK)]
        self.stats = [[stretch_stats(c[2], n) for n in LEVELS if n < x.shape[1]] for c in self.chunks]
        self.boxes = Boxes.of(x, np.arange(0, len(ids), CHUNK))

    def search(self, best: Best) -> None:
        """Take all chunks past the queries, those that most queries may reach first."""
        reach = self.boxes.reach(best.q, best.floor)
        for c in np.argsort(-reach.sum(axis=0), kind="stable").tolist():
            some = np.flatnonzero(reach[:, c])
            some = some[self.boxes.one(c).reach(best.q[some], best.floor[some])[:, 0]] if len(some) else some
            best.feed(*self.chunks[c], self.stats[c], some)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length in a column of float lists, and their vectors as whole numbers."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    begin = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        yield own, flat[begin[own][:, None] + np.arange(dim)]


class Seeds:
    """The sample, with the floors it gives, and the centre that cells are cut at."""

    def __init__(self, ids: list[int], rows: list[int], vectors: pa.Array, k: int):
        self.k, self.parts, self.centre = k, {}, {}
        ids, rows = np.array(ids, dtype=np.int64), np.array(rows, dtype=np.int64)
        for own, x in matrices(vectors) if len(ids) else ():
            self.parts[x.shape[1]] = Part(ids[own], rows[own], x)
            self.centre[x.shape[1]] = np.median(means_and_deviations(x, SIGNS)[0], axis=0)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell of each vector: on which sides of the centre its means lie."""
        m = means_and_deviations(x, SIGNS)[0]
        return ((m > self.centre.get(x.shape[1], 0.0)) << np.arange(m.shape[1])).sum(axis=1)

    def floors(self, rows: np.ndarray, q: np.ndarray) -> list[tuple[int, int] | None]:
        best = Best(rows, q, self.k)
        if q.shape[1] in self.parts:
            self.parts[q.shape[1]].search(best)
        return best.last


_BOX = "cell int, dim int, n long, low array<double>, high array<double>, dev array<double>, peak double"


def _merged_boxes(rows: list[tuple]) -> dict[tuple[int, int], list]:
    out: dict[tuple[int, int], list] = {}
    for cell, dim, n, low, high, dev, peak in rows:
        own = out.get((cell, dim))
        if own is None:
            out[cell, dim] = [n, np.array(low), np.array(high), np.array(dev), peak]
        else:
            own[0] += n
            own[1:] = [np.minimum(own[1], low), np.maximum(own[2], high), np.maximum(own[3], dev), max(own[4], peak)]
    return out


def _box_batch(boxes: dict[tuple[int, int], list]) -> pa.RecordBatch:
    rows = [(c, d, n, low.tolist(), high.tolist(), dev.tolist(), float(peak)) for (c, d), (n, low, high, dev, peak) in boxes.items()]
    types = (pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["cell", "dim", "n", "low", "high", "dev", "peak"])


def _survey(vectors: DataFrame, seeds) -> list[tuple]:
    """Count and box of every cell: 2 ** SIGNS rows at most for vectors of one length."""

    def run(batches):
        boxes: dict[tuple[int, int], list] = {}
        for batch in batches:
            rows = []
            for _, x in matrices(batch.column("embedding")):
                cell = seeds.value.cells(x)
                order = np.argsort(cell, kind="stable")
                names, begin, n = np.unique(cell[order], return_index=True, return_counts=True)
                b = Boxes.of(x[order], begin)
                rows += [(int(c), x.shape[1], int(m), b.low[i], b.high[i], b.dev[i], b.peak[i]) for i, (c, m) in enumerate(zip(names, n, strict=True))]
            boxes = _merged_boxes([*((c, d, *v) for (c, d), v in boxes.items()), *rows])
        yield _box_batch(boxes)

    def merge(batches):
        boxes: dict[tuple[int, int], list] = {}
        for batch in batches:
            boxes = _merged_boxes([*((c, d, *v) for (c, d), v in boxes.items()), *zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)])
        yield _box_batch(boxes)

    return [tuple(r) for r in vectors.select("embedding").mapInArrow(run, _BOX).repartition("cell", "dim").mapInArrow(merge, _BOX).collect()]


class Plan:
    """Parts of bounded size made of whole cells, or of salts of a large one."""

    def __init__(self, boxes: list[tuple]):
        self.where: dict[tuple[int, int], tuple[int, int]] = {}  # first part and number of parts
        self.boxes: dict[int, tuple[Boxes, list[tuple[int, int]]]] = {}
        self.count, room, last = 0, 0, None
        for cell, dim, n, *_ in sorted(boxes, key=lambda b: (b[1], b[0])):
            most = max(PART_LEAST, PART_BYTES // (8 * dim))
            if n > most:
                self.where[cell, dim], room = (self.count, -(-n // most)), 0
                self.count += self.where[cell, dim][1]
                continue
            if room < n or last != dim:
                self.count, room, last = self.count + 1, min(most, max(PART_LEAST, n)), dim
            room -= n
            self.where[cell, dim] = (self.count - 1, 1)
        for dim in {b[1] for b in boxes}:
            own = [b for b in boxes if b[1] == dim]
            self.boxes[dim] = (Boxes(*(np.array([b[i] for b in own]) for i in (3, 4, 5, 6))), [self.where[b[0], dim] for b in own])

    def targets(self, q: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Parts and the queries that may find something there."""
        if q.shape[1] not in self.boxes:
            return
        boxes, where = self.boxes[q.shape[1]]
        reach = boxes.reach(q, floor)
        parts: dict[int, np.ndarray] = {}
        for c, (first, n) in enumerate(where):
            for part in range(first, first + n):
                parts[part] = parts[part] | reach[:, c] if part in parts else reach[:, c]
        for part, some in parts.items():
            if some.any():
                yield part, np.flatnonzero(some)


_MOVED = "part int, kind int, cell int, row_id long, vec_id long, embedding array<double>, floor_score long, floor_id long"
_MOVED_NAMES = [c.split()[0] for c in _MOVED.split(", ")]
SCHEMA = "query_row long, query_id long, vec_id long, row_id long, score long"


def vectors_of(df: DataFrame) -> DataFrame:
    """row_id, vec_id and embedding (array<double>) of the rows that take part, written once so that row_ids stay."""
    good = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    own = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(good)
    return cut(own.select(F.monotonically_increasing_id().alias("row_id"), "vec_id", "embedding"), "vectors")


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, its own row left out.

    Both sides as `vectors_of` gives them: row_id, vec_id and embedding (array<double>).
    """
    context = queries.sparkSession.sparkContext
    size = candidates.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    most = max(k + 1, min(size.n // SEED_SHARE, SEED_BYTES // (8 * (size.dim or 1))))
    spread = F.xxhash64(F.lit(7), "row_id")
    few = candidates.where(spread <= F.lit(int(min(1.0, 4 * most / max(1, size.n)) * (2**63 - 1) * 2 - 2**63))) if 4 * most < size.n else candidates
    sample = few.orderBy(spread, "row_id").limit(most).collect()  # a bounded number of bytes
    seeds = context.broadcast(Seeds([r.vec_id for r in sample], [r.row_id for r in sample], pa.array([r.embedding for r in sample], pa.list_(pa.float64())), k))
    plan = context.broadcast(Plan(_survey(candidates, seeds)))

    def place(batches):
        for batch in batches:
            part, cell = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows, dtype=np.int32)
            for own, x in matrices(batch.column("embedding")):
                cell[own] = seeds.value.cells(x)
                first, n = np.array([plan.value.where[c, x.shape[1]] for c in cell[own].tolist()]).T
                part[own] = first + batch.column("row_id").to_numpy()[own] % n
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros_like(part)), pa.array(cell), batch.column("row_id"), batch.column("vec_id"), batch.column("embedding"), none, none], _MOVED_NAMES)

    def send(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                rows = batch.column("row_id").to_numpy()
                for own, q in matrices(batch.column("embedding")):
                    last = seeds.value.floors(rows[own], q)
                    floor = Best(rows[own], q, k, last).floor
                    for part, some in plan.value.targets(q, floor):
                        mine = batch.take(pa.array(own[some]))
                        floors = [last[i] for i in some.tolist()]
                        n = len(some)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, part, np.int32)), pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int32)), mine.column("row_id"), mine.column("vec_id"), mine.column("embedding"),
                             pa.array([-f[0] if f else None for f in floors], pa.int64()), pa.array([f[1] if f else None for f in floors], pa.int64())], _MOVED_NAMES)

    def run(batches):
        group, held, parts = None, [], None
        for batch in batches:
            names = batch.column("part").to_numpy().astype(np.int64) << 1 | batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if names[a] >> 1 != group:
                    group, held, parts = names[a] >> 1, [], None
                if not names[a] & 1:
                    held.append(own.select(["row_id", "vec_id", "embedding"]))
                    continue
                if parts is None:
                    parts = _parts_of(held)
                    held = []
                for i in range(0, own.num_rows, block):
                    yield from _answers(own.slice(i, block), parts, k)

    moved = candidates.select("row_id", "vec_id", "embedding").mapInArrow(place, _MOVED).unionByName(queries.select("row_id", "vec_id", "embedding").mapInArrow(send, _MOVED))
    near = moved.repartition(max(1, min(plan.value.count, 1 << 16)), "part").sortWithinPartitions("part", "kind", "cell", "row_id").mapInArrow(run, SCHEMA)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _parts_of(held: list[pa.RecordBatch]) -> dict[int, Part]:
    if not held:
        return {}
    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    ids, rows = whole.column("vec_id").to_numpy(), whole.column("row_id").to_numpy()
    return {x.shape[1]: Part(ids[own], rows[own], x) for own, x in matrices(whole.column("embedding"))}


def _answers(queries: pa.RecordBatch, parts: dict[int, Part], k: int) -> Iterator[pa.RecordBatch]:
    ids, rows = queries.column("vec_id").to_numpy(), queries.column("row_id").to_numpy()
    floors = [None if s is None else (-s, v) for s, v in zip(queries.column("floor_score").to_pylist(), queries.column("floor_id").to_pylist(), strict=True)]
    out = []
    for own, q in matrices(queries.column("embedding")):
        if q.shape[1] in parts:
            best = Best(rows[own], q, k, [floors[i] for i in own.tolist()])
            parts[q.shape[1]].search(best)
            out += [(int(rows[i]), int(ids[i]), v, r, -s) for i, top in zip(own.tolist(), best.top, strict=True) for s, v, r in top]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(5)], ["query_row", "query_id", "vec_id", "row_id", "score"])
