"""Exact Jaccard join of documents' word-shingle sets, as a join in a metric space.

1 - |A and B| / |A or B| is a metric, so regions around pivots can be joined on their own if documents near a
region's edge are also put into its neighbour. Three kinds of pivots are used, coarse to fine:

* single shingles. Of a set of n, at most e = n - ceil(threshold n) shingles are missing from a linked one. With
  shingles in one fixed order, linked sets share k of their first e + k, so each set goes to the regions of these
  pivots only, and a set too few of whose pivots are shared has no link. The order puts frequent shingles last, by
  a sketch of fixed size counted over all documents; it only steers the work, any order is exact;
* the empty set, whose distance is a set's size: linked sizes differ by the threshold at most, so sizes form bands,
  and each set is also put into the band below its own;
* documents. What hangs together within a band is a region; a region is cut into Voronoi cells of pivot
  documents, a document going to its nearest pivot's cell and to each cell whose pivot is at most twice the link
  distance farther, and those beyond `FAR` of all pivots to an outer cell, with those less than the link
  distance inside of it. What lies within the link distance of a pivot is linked to it, and needs no comparing
  among itself: a cell that hangs together by such links is done, so a family of n near copies costs about n.
  Cells are cut again, with an index of their own, until they are small or stop shrinking; what is then left
  unjoined is compared. A set with too few shingles that others of its cell have too can't link there and goes.
  Regions too large for one task take this step across the cluster. Of one that won't shrink, the sets that don't
  hang with its largest ball are paired, in blocks, with each other and with the ball.

Equal sets are one class throughout. Links between classes make the components.

Edge cases: texts without words (null and empty ones included) have empty sets, which link with nothing, not with
each other; rows with a null doc_id can link, but a component's id is the smallest doc_id it has; repeated rows and
doc_ids each give a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.common import cut, text_bytes, text_slices
from tallow.llm.graph import components
from tallow.llm.shingles import set_key, shingle_sets

SKETCH_BITS = 18
SKETCH_PART = 1024
#: Sets whose keys a task remembers, so that copies are not emitted again and again.
SEEN_KEYS = 1 << 20
FAR = 0.7
#: Documents that are joined in full without further cells.
LEAF = 8
#: Shingles of a region that one task may hold; beyond, cells are cut across the cluster.
REGION_SHINGLES = 6_000_000
PIVOTS = 12
#: Pivots of a cell within a task: one for so many documents, this many at most.
PIVOT_EVERY, MOST_PIVOTS = 16, 64
#: A cell with more than this share of its region's documents is not cut again, and no cell this often.
STUCK, MAX_DEPTH = 0.4, 12
EDGES = "u binary, v binary"


class Rule:
    """Integer link rule 100 * intersection >= percent * union, and what follows from it."""

    def __init__(self, percent: int):
        if not 50 < percent <= 100:
            raise ValueError("percent must be above 50 and at most 100")
        self.percent, self.far = percent, 1 - percent / 100

    def missing(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100

    def shared(self, n: int) -> int:
        return self.missing(n) // 2 + 1

    def prefix(self, n: int) -> int:
        return min(n, self.missing(n) + self.shared(n))

    def needed(self, n: int) -> int:
        """Pivots that a set of n has in common with any linked one, at least: as many as the smallest of those asks."""
        return self.shared((self.percent * n + 99) // 100)

    def links(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)


# -- one pass for classes and the sketch ----------------------------------------------------------------


def _key(own: np.ndarray) -> bytes:
    a, b = set_key(own)
    return a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True)


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """Rows of documents (doc_id, n, k) and, with part set, rows of shingle counts by sketch part."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        seen: set[bytes] = set()
        for batch in text_slices(batches):
            sets = list(shingle_sets(*text_bytes(batch.column("text")), words))
            keys = [_key(s) for s in sets]
            fresh = []
            for s, k in zip(sets, keys, strict=True):
                if k not in seen:
                    seen.add(k)
                    fresh.append(s)
            if len(seen) > SEEN_KEYS:
                seen.clear()
            if fresh:
                counts += np.bincount((np.concatenate(fresh) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "n", "k", "part", "counts"])
        if counts.any():
            rows = counts.reshape(-1, SKETCH_PART)
            m = len(rows)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(range(m), pa.int32()), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())], ["doc_id", "n", "k", "part", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, k binary, part int, counts binary")


def _levels(survey: DataFrame) -> np.ndarray:
    """How frequent a sketch cell's shingles are: 0, or by powers of two above the usual count. A fixed number of bytes."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(raw, "<i8")
                sums[part] = sums[part] + own if part in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["part", "counts"])

    sketch = survey.where("part IS NOT NULL").select("part", "counts").repartition("part").mapInArrow(run, "part int, counts binary")
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PART * SKETCH_PART, dtype=np.int64).reshape(-1, SKETCH_PART)
    for r in sketch.collect():  # as many rows as the sketch has parts
        total[r.part] += np.frombuffer(r.counts, "<i8")
    total = total.ravel()
    usual = total.mean()
    high = usual + 8 * math.sqrt(usual) + 32
    return np.where(total > high, 1 + np.log2(np.maximum(total, 1) / high).astype(np.int64), 0).astype(np.int8)


def _pivot_rows(docs: DataFrame, levels: np.ndarray, rule: Rule, words: int) -> DataFrame:
    """sh, k, n: every set's first pivots, once per set and task."""
    levels = docs.sparkSession.sparkContext.broadcast(levels)  # a fixed 2 ** SKETCH_BITS bytes

    def run(batches):
        level = levels.value
        seen: set[bytes] = set()
        for batch in text_slices(batches):
            pivots, keys, sizes = [], [], []
            for own in shingle_sets(*text_bytes(batch.column("text")), words):
                if not len(own):
                    continue
                k = _key(own)
                if k in seen:
                    continue
                seen.add(k)
                n = rule.prefix(len(own))
                rank = level[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                pivots.append(own[:n] if not rank[:n].any() else own[np.argsort(rank, kind="stable")[:n]])
                keys += [k] * n
                sizes.append(np.full(n, len(own)))
            if len(seen) > SEEN_KEYS:
                seen.clear()
            if pivots:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pivots).view(np.int64)), pa.array(keys, pa.binary()), pa.array(np.concatenate(sizes).astype(np.int32))], ["sh", "k", "n"])

    return docs.select("text").mapInArrow(run, "sh long, k binary, n int")


def _shared_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows of the pivots that more than one set has, streamed in pivot order."""

    def run(batches):
        held, known = None, False  # the last row so far, and whether another set has its pivot
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            sh = both.column("sh").to_numpy()
            k = both.column("k").combine_chunks()
            again = (sh[1:] == sh[:-1]) & pc.equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)
            single = np.append(True, ~again)
            both, sh = both.filter(pa.array(single)), sh[single]
            same = sh[1:] == sh[:-1]
            shared = np.append(False, same) | np.append(same, False)
            shared[0] |= known
            known = bool(shared[-1])
            yield from both.slice(0, len(sh) - 1).filter(pa.array(shared[:-1])).to_batches()
            held = both.slice(len(sh) - 1).to_batches()[0]
        if known:
            yield held

    return rows.sortWithinPartitions("sh", "k").mapInArrow(run, rows.schema)


def _candidates(rows: DataFrame, rule: Rule) -> DataFrame:
    """Pivot rows of sets that share enough pivots for a link."""

    def least(n: str) -> str:
        return f"(({rule.percent} * {n} + 99) div 100)"

    partner = least("cast(n as bigint)")
    needed = f"({partner} - {least(partner)}) div 2 + 1"  # Rule.needed
    for _ in range(2):  # fewer sets leave fewer shared pivots
        rows = cut(_shared_rows(rows.repartition("sh")), "shared")
        enough = rows.groupBy("k", "n").agg(F.count("*").alias("hits")).where(F.expr(f"hits >= {needed}")).select("k")
        rows = rows.join(enough, "k", "left_semi").select(*rows.columns)
    return _shared_rows(rows.repartition("sh"))


# -- regions --------------------------------------------------------------------------------------------


class Region:
    """Distinct sets with an inverted index over the shingles that at least two of them have.

    `at` numbers the sets within the outermost region. With a rule, sets with too few shared shingles for any link are
    left out. `scans` counts the index scans that joining the region took.
    """

    def __init__(self, keys: list[bytes], sets: list[np.ndarray], rule: Rule | None = None):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.keys, self.scans = keys, 0
        self._index(rule, np.arange(len(sets)), sizes, np.repeat(np.arange(len(sets)), sizes), flat)

    def _index(self, rule: Rule | None, at: np.ndarray, sizes: np.ndarray, owner: np.ndarray, code: np.ndarray) -> None:
        _, code, count = np.unique(code, return_inverse=True, return_counts=True)
        many = count[code] > 1
        enough = np.bincount(owner[many], minlength=len(at)) * 100 >= (rule.percent if rule else 0) * sizes
        enough &= sizes > 0
        many &= enough[owner]
        place = np.cumsum(enough) - 1
        self.rule, self.at, self.sizes = rule, at[enough], sizes[enough]
        self.code, owner = code[many], place[owner[many]]
        order = np.argsort(self.code, kind="stable")
        self.post = owner[order]
        self.begin = np.searchsorted(self.code[order], np.arange(len(count) + 1))
        self.owner, self.first = owner, np.searchsorted(owner, np.arange(len(self.at) + 1))

    def cell(self, members: np.ndarray) -> Region:
        """The region of some of the sets, with an index of its own."""
        place = np.full(len(self.at), -1)
        place[members] = np.arange(len(members))
        own = place[self.owner]
        inside = own >= 0
        out = Region.__new__(Region)
        out._index(self.rule, self.at[members], self.sizes[members], own[inside], self.code[inside])
        return out

    def common(self, i: int) -> np.ndarray:
        """Sizes of i's intersections with all other sets."""
        own = self.code[self.first[i] : self.first[i + 1]]
        a, n = self.begin[own], self.begin[own + 1] - self.begin[own]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        return np.bincount(self.post[at], minlength=len(self.sizes))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def voronoi(distances: np.ndarray, link: float) -> list[np.ndarray]:
    """Members of each pivot's cell (rows of distances: pivots) and, last, of the outer cell.

    Linked documents always meet in one of the cells.
    """
    slack = 1e-9
    nearest = distances.min(axis=0)
    inner = nearest <= FAR
    cells = [np.flatnonzero(inner & (d <= nearest + 2 * link + slack)) for d in distances]
    return [*cells, np.flatnonzero(nearest > FAR - link - slack)]


class Joined:
    """Edges found so far in a region, and a label for every set: equal ones hang together."""

    def __init__(self, rule: Rule, label: np.ndarray):
        self.rule, self.label = rule, label
        self.edges: list[tuple[int, int]] = []
        self.scans = 0

    def single(self, region: Region) -> bool:
        own = self.label[region.at]
        return len(own) < 2 or bool((own == own[0]).all())

    def scan(self, region: Region, i: int) -> np.ndarray:
        """Distances of set i to all; what links with it gets its label."""
        self.scans += 1
        common = region.common(i)
        size = region.sizes[i]
        near = np.flatnonzero((common > 0) & self.rule.links(common, region.sizes, size))
        own = region.at[near]
        mine = int(region.at[i])
        found, where = np.unique(self.label[own], return_index=True)
        other = found != self.label[mine]
        if other.any():
            self.edges += [(mine, j) for j in own[where[other]].tolist()]
            self.label[np.isin(self.label, found[other])] = self.label[mine]
        d = 1 - common / (region.sizes + size - common)
        d[i] = 0
        return d


def join_region(region: Region, rule: Rule, leaf: int = LEAF, pivots: int = PIVOTS, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect what links connect, by cells within cells; label: sets known to hang together."""
    done = Joined(rule, np.arange(int(region.at.max(initial=-1)) + 1) if label is None else label)
    stack = [region]
    while stack:
        cell = stack.pop()
        n = len(cell.at)
        if done.single(cell):
            continue
        if n > leaf:
            d, nearest, labels = [], np.ones(n), []
            for _ in range(min(MOST_PIVOTS, max(pivots, n // PIVOT_EVERY))):
                # the farthest from all pivots among what hangs with none of them
                free = ~np.isin(done.label[cell.at], labels)
                if not free.any():
                    break
                i = int(np.argmax(np.where(free, nearest, -1))) if d else n // 2
                d.append(done.scan(cell, i))
                nearest = np.minimum(nearest, d[-1])
                labels = np.unique([*(done.label[j] for j in labels), done.label[cell.at[i]]]).tolist()
            if done.single(cell):
                continue
            cells = voronoi(np.stack(d), rule.far)
            if max(map(len, cells)) <= 0.9 * n and sum(map(len, cells)) <= 3 * n:
                stack += [cell.cell(c) for c in cells if len(c) > 1]
                continue
        for i in range(n):
            if done.single(cell):
                break
            done.scan(cell, i)
    region.scans = done.scans
    return done.edges


def _stream_groups(batches, column: str):
    """(group, rows) of contiguous groups; rows as (k, set, extra columns...)."""
    group, rows = None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in batch.schema.names]
        at = batch.schema.names.index(column)
        for r in zip(*cols, strict=True):
            if r[at] != group:
                if rows:
                    yield group, rows
                group, rows = r[at], []
            rows.append(dict(zip(batch.schema.names, r, strict=True)))
    if rows:
        yield group, rows


def _join_task(rule: Rule):
    def run(batches):
        for _, rows in _stream_groups(batches, "region"):
            own = {r["k"]: (np.frombuffer(r["own"], "<u8"), r["label"]) for r in rows}
            keys = sorted(own)
            if len(keys) < 2:
                continue
            names: dict[bytes, int] = {}
            label = np.array([i if own[k][1] is None else names.setdefault(own[k][1], i) for i, k in enumerate(keys)])
            edges = join_region(Region(keys, [own[k][0] for k in keys], rule), rule, label=label)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in edges], pa.binary()), pa.array([keys[j] for _, j in edges], pa.binary())], ["u", "v"])

    return run


class Pivots:
    """Pivots of a large region: distances of sets to all of them, and which of them hang together."""

    def __init__(self, rule: Rule, keys: list[bytes], sets: list[np.ndarray]):
        self.rule, self.keys, self.sizes = rule, keys, np.array([len(s) for s in sets], dtype=np.int64)
        self.all, code = np.unique(np.concatenate(sets), return_inverse=True)
        self.holds = np.zeros((len(self.all), len(sets)), dtype=np.int32)
        self.holds[code, np.repeat(np.arange(len(sets)), self.sizes)] = 1
        union = Union(len(sets))
        self.links = [(i, j) for i, s in enumerate(sets) for j in np.flatnonzero(rule.links(self.common(s), self.sizes, len(s))).tolist() if union.join(i, j)]
        self.group = np.array([union.find(i) for i in range(len(sets))])

    def common(self, own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.all, own), len(self.all) - 1)
        return self.holds[at[self.all[at] == own]].sum(axis=0)


def _split_task(rule: Rule):
    """Members of large regions to the cells of the pivots that come first in each (region, salt); links to pivots.

    A row without a region is the link (k, label). Else label names a set that k is known to hang together with.
    """

    def run(batches):
        group, held, pivots = None, [], None
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])

            def add(*row, rows=rows):
                for column, v in zip(rows, row, strict=True):
                    column.append(v)

            for region, salt, kind, k, raw, members, label in zip(*(batch.column(c).to_pylist() for c in ("region", "salt", "kind", "k", "own", "members", "label")), strict=True):
                if (region, salt) != group:
                    group, held, pivots = (region, salt), [], None
                own = np.frombuffer(raw, "<u8")
                if kind == 0:
                    held.append((k, own))
                    continue
                if pivots is None:
                    pivots = Pivots(rule, *map(list, zip(*held, strict=True)))
                    for i, j in pivots.links:
                        add(None, pivots.keys[i], None, None, pivots.keys[j])
                common = pivots.common(own)
                d = 1 - common / (pivots.sizes + len(own) - common)
                near = np.flatnonzero(rule.links(common, pivots.sizes, len(own)))
                if len(near):
                    for _, i in sorted({int(g): int(i) for i, g in zip(near[::-1], pivots.group[near[::-1]], strict=True)}.items()):
                        if pivots.keys[i] != k:
                            add(None, k, None, None, pivots.keys[i])
                    label = pivots.keys[int(pivots.group[near[0]])]
                for j, cell in enumerate(voronoi(d[:, None], rule.far)):
                    if len(cell):
                        add(f"{region}/{j}", k, raw, members, label)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["region", "k", "own", "above", "label"])

    return run


def _join_regions(members: DataFrame, rule: Rule, limit: int) -> DataFrame:
    """Edges (u, v) within regions: members have region, k, own (the set's bytes)."""
    found = []
    left = members.select("region", "k", "own", F.lit(None).cast("long").alias("above"), F.lit(None).cast("binary").alias("label"))
    for depth in range(MAX_DEPTH + 1):
        left = cut(left, "regions")
        if depth:
            found.append(left.where("region IS NULL").select(F.col("k").alias("u"), F.col("label").alias("v")))
            left = left.where("region IS NOT NULL")
        sizes = left.groupBy("region").agg(
            F.sum(F.expr("octet_length(own) div 8")).alias("size"), F.count("*").alias("members"), F.max("above").alias("above"),
            F.min("label").alias("low"), F.max("label").alias("high"), F.count("label").alias("labelled"), F.mode("label").alias("main"),
        )
        done = F.coalesce((F.col("low") == F.col("high")) & (F.col("labelled") == F.col("members")), F.lit(False)) | (F.col("members") < 2)
        sizes = cut(sizes.withColumn("done", done), "sizes")
        large = sizes.where((F.col("size") > limit) | F.col("done"))
        fits = left.join(large.select("region"), "region", "left_anti")
        found.append(fits.repartition("region").sortWithinPartitions("region").mapInArrow(_join_task(rule), EDGES))
        large = large.where(~F.col("done"))
        if large.isEmpty():
            break
        wide = left.drop("above").join(large, "region")
        stuck = F.lit(depth == MAX_DEPTH) | (F.coalesce(F.col("above"), F.lit(1 << 40)) * STUCK < F.col("members"))
        found.append(_block_pairs(wide.where(stuck), rule, limit))
        if depth == MAX_DEPTH:
            break
        salts = (F.ceil(F.col("size") / limit) * 2).cast("int")
        go = wide.where(~stuck).withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int")).withColumn("h", F.xxhash64("k", F.lit(depth)))
        own = Window.partitionBy("region", "salt").orderBy("h", "k")
        pivots = (
            go.withColumn("at", F.row_number().over(own)).where(F.col("at") <= PIVOTS)
            .groupBy("region", "salts").agg(F.expr(f"slice(array_sort(collect_list(struct(h, k, own))), 1, {PIVOTS})").alias("p"))
            .select("region", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), "p")
            .select("region", "salt", F.explode("p").alias("p")).select("region", "salt", F.lit(0).alias("kind"), "p.k", "p.own", F.lit(0).cast("long").alias("members"), F.lit(None).cast("binary").alias("label"))
        )
        both = pivots.unionByName(go.select("region", "salt", F.lit(1).alias("kind"), "k", "own", "members", "label"))
        left = both.repartition("region", "salt").sortWithinPartitions("region", "salt", "kind", "k").mapInArrow(_split_task(rule), "region string, k binary, own binary, above long, label binary")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def _block_pairs(members: DataFrame, rule: Rule, limit: int) -> DataFrame:
    """Pairs of a region's blocks, each block bounded, as regions of their own.

    Sets that hang with the region's main label are known to be connected: their blocks meet the others', not each other.
    """
    own = members.select("region", "k", "own", "label", F.coalesce(F.col("label") == F.col("main"), F.lit(False)).alias("ball"))
    blocks = F.greatest(F.lit(1), F.ceil(F.sum(F.expr("octet_length(own) div 8")) * 2 / limit)).cast("int")
    sizes = own.groupBy("region", "ball").agg(blocks.alias("blocks"))
    sizes = sizes.groupBy("region").agg(F.coalesce(F.max(F.when(F.col("ball"), F.col("blocks"))), F.lit(0)).alias("balls"), F.coalesce(F.max(F.when(~F.col("ball"), F.col("blocks"))), F.lit(0)).alias("rests"))
    own = own.join(cut(sizes, "blocks"), "region").withColumn("block", F.pmod(F.xxhash64("k"), F.when(F.col("ball"), F.col("balls")).otherwise(F.col("rests"))).cast("int"))
    among = "transform(sequence(0, rests - 1), i -> concat_ws(':', 'r', least(block, i), greatest(block, i)))"
    across = "if(balls = 0, array(), transform(sequence(0, balls - 1), i -> concat_ws(':', 'b', i, block)))"
    meets = "if(rests = 0, array(), transform(sequence(0, rests - 1), i -> concat_ws(':', 'b', block, i)))"
    named = own.withColumn("pair", F.explode(F.expr(f"if(ball, {meets}, concat({among}, {across}))")))
    named = named.select(F.concat_ws(":", "region", "pair").alias("region"), "k", "own", "label")
    return named.repartition("region").sortWithinPartitions("region").mapInArrow(_join_task(rule), EDGES)


def _sets_of(docs: DataFrame, words: int) -> DataFrame:
    """k and own (ascending hashes, 8 bytes each) of texts."""

    def run(batches):
        for batch in text_slices(batches):
            sets = list(shingle_sets(*text_bytes(batch.column("text")), words))
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["k", "own"])

    return docs.select("text").mapInArrow(run, "k binary, own binary")


def join(docs: DataFrame, words: int = 5, percent: int = 80, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, and class_size (documents with an equal set) of every row of docs."""
    rule = Rule(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = cut(_survey(texts, words), "survey")
    signed = survey.where("part IS NULL").select("doc_id", "n", "k")
    rows = cut(_candidates(_pivot_rows(texts, _levels(survey), rule, words), rule), "candidates")
    step = math.log(100 / percent) + 1e-6 if percent < 100 else 1.0
    level = F.floor(F.log(F.col("n").cast("double")) / step).cast("int") if percent < 100 else F.col("n")
    placed = rows.withColumn("band", F.explode(F.array(level, level - 1)))
    # what hangs together in a band: every set of a pivot with the pivot's smallest
    tag = F.expr("unhex(lpad(hex(band + 1), 8, '0'))")
    node = F.concat("k", tag)
    least = placed.groupBy("sh", "band").agg(F.min("k").alias("least"))
    hang = placed.join(least, ["sh", "band"]).where("k <> least").select(node.alias("u"), F.concat("least", tag).alias("v"))
    roots = components(hang)
    # one document per candidate set brings its text
    wanted = roots.select(F.substring("node", 1, 16).alias("k"), F.hex("root").alias("region"))
    carrier = signed.join(wanted.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("d")).select("k", "d.doc_id")
    keyed = texts.where("doc_id IS NOT NULL").join(carrier.where("doc_id IS NOT NULL").select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    nameless = texts.where("doc_id IS NULL")
    sets = _sets_of(keyed.unionByName(nameless), words).dropDuplicates(["k"])
    members = wanted.join(sets, "k").select("region", "k", "own")
    links = components(_join_regions(members, rule, region_shingles))
    grouped = signed.groupBy("k", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size"))
    named = grouped.join(links.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    roof = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(roof, "root").select("k", "component_id", "class_size")
    linked = signed.where("n > 0").join(classes, "k").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size")
    alone = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return linked.unionByName(alone)
