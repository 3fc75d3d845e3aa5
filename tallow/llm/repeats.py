"""Removal of repeated byte strings by common-prefix interval trees over suffixes.

Every string of `length` bytes that starts in two places, in one text or in two, is removed wherever it stands.

A string's anchor is its `seed`-byte part with the smallest hash (the leftmost of equals), which depends on the
string alone, so equal strings have the same anchor at the same place. Each text thus falls into anchors, one for
every stretch of string starts. The suffixes that start at equal anchors are brought together and sorted: adjacent
common prefixes make the enhanced suffix array, and a scan with a stack makes the tree of its common-prefix
intervals. An interval holds all suffixes that agree on so many bytes; sorting its members by what stands before
the anchor shows how far each one's left extension agrees with another's, that is where the extension is no longer
diverse. Both together give each occurrence its repeated starts, with all other members, not just neighbours.

Anchors that occur once are left out early by a filter of fixed size, which may let some through but loses none. An
anchor with more than GROUP occurrences is not gathered in a task: its strings are counted one by one by hash, which
is another method that gives the same result. `repeat_groups` gives the tree's own output, groups of occurrences.
Equal texts of at least `length` bytes are removed whole, and stand in the suffixes once.

Edge cases: a null text counts as empty; texts shorter than `length` lose nothing; repeated rows are equal texts;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import cut, semi_join, text_bytes, text_slices
from tallow.llm.shingles import mix

LENGTH, SEED = 200, 32
#: Occurrences of one anchor that a task gathers.
GROUP = 100_000
#: The filter of repeated anchors: bits per anchor, and the least and most bits, as powers of two.
FILTER_PER, FILTER_LEAST, FILTER_MOST = 16, 20, 28
PART_BYTES = 1 << 16
SEEN_TEXTS = 1 << 20
#: Text bytes whose anchors are sought at a time; that takes about a hundred bytes of memory each.
SLICE = 1 << 21
#: Low bits of an anchor's hash that give way to its position; more than SLICE and a string need.
PLACE_BITS = 22

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
SPANS = "text_key binary, start long, stop long"


# -- anchors --------------------------------------------------------------------------------------------


def seed_hashes(raw: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the `seed` bytes from every position; zeros fill in past the end."""
    n = len(raw)
    low = np.zeros(n + seed + 8, dtype=np.uint8)
    low[:n] = raw
    eight = np.ndarray(shape=(n + seed,), dtype="<u8", buffer=low, strides=(1,))
    h = np.zeros(n, dtype=np.uint64)
    for k in range(0, seed - 7, 8):
        h = (h ^ (h >> np.uint64(29))) * _K[1] + eight[k : k + n] * _K[k // 8 % 4]
    if seed % 8:
        h = (h ^ (h >> np.uint64(29))) * _K[1] + eight[seed - 8 : seed - 8 + n] * _K[2]
    return mix(h)


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Per anchor: text, hash, position, and the first and last start of the strings it stands for (positions in raw).

    Hashes are ordered by their upper 64 - PLACE_BITS bits and then by position. How many bits count never depends on
    the bytes around a string, so neither does its anchor.
    """
    n, w = len(raw), length - seed + 1
    if n >> PLACE_BITS:
        raise ValueError(f"more than {1 << PLACE_BITS} bytes at a time")
    sizes = np.diff(offsets)
    counts = np.maximum(0, sizes - length + 1)
    total = int(counts.sum())
    if not total:
        e = np.zeros(0, np.int64)
        return e, np.zeros(0, np.uint64), e, e, e
    h = seed_hashes(raw, seed)
    low = np.uint64((1 << PLACE_BITS) - 1)
    rows = -(-n // w)
    padded = np.full(rows * w + w, ~np.uint64(0), dtype=np.uint64)
    padded[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    grid = padded.reshape(rows + 1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    text = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    at = (np.minimum(behind[start], ahead[start + w - 1]) & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], total) - 1
    return text[new], h[at[new]], at[new], start[new], start[last]


def pieces(batches, length: int, size: int, seen: set[bytes]):
    """Texts that the task hasn't met, laid end to end: bytes, offsets, keys, and each one's start in its text.

    A text longer than `size` comes in pieces that overlap by length - 1 bytes, so that each string starts in one of
    them; memory is bounded by `size`, whatever a text's length. An anchor whose starts fall into two pieces is then
    met in both, each with its own starts.
    """
    for batch in text_slices(batches, size=size):
        own, keys = _texts(batch, seen)
        if not keys:
            continue
        raw, offs = text_bytes(own.column("text"))
        if len(keys) > 1 or len(raw) <= size + length:
            yield raw, offs, keys, np.zeros(len(keys), np.int64)
            continue
        for a in range(0, len(raw) - length + 1, size):
            part = raw[a : a + size + length - 1]
            yield part, np.array([0, len(part)]), keys, np.array([a])


def _texts(batch: pa.RecordBatch, seen: set[bytes]) -> tuple[pa.RecordBatch, list[bytes]]:
    """The batch's rows with texts that the task hasn't met, and their keys."""
    keep, keys = [], []
    for i, k in enumerate(batch.column("text_key").to_pylist()):
        if k not in seen:
            seen.add(k)
            keep.append(i)
            keys.append(k)
    if len(seen) > SEEN_TEXTS:
        seen.clear()
    return (batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))), keys


def _counted(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """h and n (occurrences) of anchors that stand in more than one place."""

    def run(batches):
        seen: set[bytes] = set()
        for raw, offs, keys, begin in pieces(batches, length, SLICE, seen):
            text, h, at, _, _ = anchors(raw, offs, length, seed)
            base = np.array([int.from_bytes(k[:8], "little") for k in keys], dtype=np.uint64)
            place = mix(base[text] + (at - offs[text] + begin[text]).astype(np.uint64) * _K[0])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(place.view(np.int64))], ["h", "place"])

    rows = texts.mapInArrow(run, "h long, place long")
    return rows.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count("*").alias("n")).where("a <> b").select("h", "n")


class Filter:
    """A Bloom filter of two bits a hash."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros((1 << bits) // 8, dtype=np.uint8) if data is None else data

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return (mix(h) >> shift).astype(np.int64), (mix(h ^ _K[3]) >> shift).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        for p in self.places(h):
            np.bitwise_or.at(self.data, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = ((self.data[p >> 3] >> (p & 7)) & 1 for p in self.places(h))
        return (a & b).astype(bool)


def _filter_of(hashes: DataFrame, count: int) -> Filter:
    """A filter of bounded size over the column h, put together part by part on the executors."""
    bits = min(FILTER_MOST, max(FILTER_LEAST, int(count * FILTER_PER).bit_length()))
    size = (1 << bits) // 8

    def make(batches):
        own = Filter(bits)
        for batch in batches:
            own.add(batch.column("h").to_numpy().view(np.uint64))
        for i in range(0, size, PART_BYTES):
            part = own.data[i : i + PART_BYTES]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["part", "bits"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint8)
                sums[i] = sums[i] | own if i in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["part", "bits"])

    schema = "part long, bits binary"
    whole = Filter(bits)
    for r in hashes.select("h").mapInArrow(make, schema).repartition("part").mapInArrow(merge, schema).collect():  # a bounded number of bytes
        whole.data[r.part : r.part + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    return whole


# -- suffixes -------------------------------------------------------------------------------------------

_SUFFIXES = "h long, kind int, text_key binary, at long, low int, high int, ahead binary, back binary"
_NAMES = [c.split()[0] for c in _SUFFIXES.split(", ")]
SUFFIX, FOUND, STRING = 0, 1, 2


def _suffixes(texts: DataFrame, repeated: Filter, hot: Filter | None, length: int, seed: int, merge: bool = True) -> DataFrame:
    """One row per repeated anchor: the bytes from it on, and those before it from right to left.

    kind FOUND (with merge): starts low..high at the anchor are known to be repeated; kind STRING: one string of a hot anchor.
    """
    context = texts.sparkSession.sparkContext
    wanted = context.broadcast((repeated.bits, repeated.data.tobytes()))  # of bounded size, both
    frequent = context.broadcast((hot.bits, hot.data.tobytes())) if hot is not None else None

    def run(batches):
        keep = Filter(wanted.value[0], np.frombuffer(wanted.value[1], np.uint8))
        often = Filter(frequent.value[0], np.frombuffer(frequent.value[1], np.uint8)) if frequent is not None else None
        seen: set[bytes] = set()
        for raw, offs, keys, begin in pieces(batches, length, SLICE, seen):
            text, h, at, first, last = anchors(raw, offs, length, seed)
            some = keep.has(h)
            text, h, at, first, last = text[some], h[some], at[some], first[some], last[some]
            whole, turned, n = raw.tobytes(), raw[::-1].tobytes(), len(raw)
            rows: tuple[list, ...] = tuple([] for _ in _NAMES)
            base = offs[text] - begin[text]
            hot_here = often.has(h) if often is not None else np.zeros(len(h), dtype=bool)
            _, code, times = np.unique(h, return_inverse=True, return_counts=True)
            again = (times[code] > 1).tolist()
            known: dict[tuple[int, bytes], list] = {}
            for t, s, p, a, b, o, twice, much in zip(text.tolist(), h.view(np.int64).tolist(), at.tolist(), first.tolist(), last.tolist(), base.tolist(), again, hot_here.tolist(), strict=True):
                if much:
                    for x in range(a, b + 1):
                        d = hashlib.blake2b(whole[x : x + length], digest_size=16).digest()
                        for column, v in zip(rows, (int.from_bytes(d[:8], "little", signed=True), STRING, keys[t], x - o, 0, 0, d, None), strict=True):
                            column.append(v)
                    continue
                row = (s, SUFFIX, keys[t], p - o, a - p, b - p, whole[p : b + length], turned[n - p : n - a])
                if twice and merge:
                    equal = (s, whole[a : b + length])
                    before = known.get(equal)
                    if before is not None and before[5] == b - p:
                        # equal surroundings: all these starts are repeated, and one row stands for both
                        found = [row] if before[-1] else [row, before[0]]
                        before[-1] = True
                        for r in found:
                            for column, v in zip(rows, (int.from_bytes(r[2][:8], "little", signed=True), FOUND, *r[2:6], None, None), strict=True):
                                column.append(v)
                        continue
                    known[equal] = [row, *row[1:6], False]
                for column, v in zip(rows, row, strict=True):
                    column.append(v)
            types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], _NAMES)

    return texts.mapInArrow(run, _SUFFIXES)


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as rows of equal width, and the lengths."""
    raw, offs = _binary(column)
    sizes = np.diff(offs)
    width = int(sizes.max(initial=0))
    if not width:
        return np.zeros((len(sizes), 1), np.uint8), sizes
    place = np.minimum(offs[:-1, None] + np.arange(width)[None, :], max(0, len(raw) - 1))
    grid = raw[place]
    grid[np.arange(width)[None, :] >= sizes[:, None]] = 0
    return grid, sizes


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    blob = pc.fill_null(column, b"").cast(pa.large_binary())
    _, offs, data = blob.buffers()
    offsets = np.frombuffer(offs, np.int64, len(blob) + 1, blob.offset * 8)
    start, stop = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, stop - start, start) if stop > start else np.zeros(0, np.uint8)
    return raw, offsets - start


def neighbours(grid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common prefix of each row and the one before it; 0 for the first."""
    out = np.zeros(len(sizes), dtype=np.int64)
    if len(sizes) > 1:
        differ = grid[1:] != grid[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), grid.shape[1])
        out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def intervals(common: list[int]):
    """(length, first, last) of every common-prefix interval of a suffix array, by a scan with a stack."""
    stack: list[tuple[int, int]] = []
    n = len(common)
    for i in range(1, n + 1):
        now = common[i] if i < n else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            size, first = stack.pop()
            yield size, first, i - 1
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def solve(common: np.ndarray, back: np.ndarray, back_sizes: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(member, first, last) starts, relative to the anchor, that another member repeats; members in suffix order."""
    n = len(common)
    order = np.lexsort((back_sizes, *back.T[::-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    table = [neighbours(back[order], back_sizes[order])]
    while 2 << (len(table) - 1) < n:
        step = 1 << (len(table) - 1)
        t = table[-1].copy()
        t[:-step] = np.minimum(t[:-step], t[step:])
        table.append(t)
    levels = np.stack(table)
    out = []
    for size, first, last in intervals(common.tolist()):
        top = size - length
        if top < low[first : last + 1].min():
            continue
        own = np.argsort(rank[first : last + 1], kind="stable")
        r = rank[first : last + 1][own]
        span = r[1:] - r[:-1]
        lev = np.frexp(span)[1] - 1
        gap = np.minimum(levels[lev, r[:-1] + 1], levels[lev, r[1:] + 1 - (1 << lev)])
        best = np.zeros(len(r), dtype=np.int64)
        best[:-1] = gap
        best[1:] = np.maximum(best[1:], gap)
        member = own + first
        a, b = np.maximum(low[member], -best), np.minimum(high[member], top)
        ok = a <= b
        out += zip(member[ok].tolist(), a[ok].tolist(), b[ok].tolist(), strict=True)
    return out


def _solve_rows(rows: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Spans of whole groups of suffixes, sorted by (h, ahead, back)."""
    h, low, high = rows.column("h").to_numpy(), rows.column("low").to_numpy().astype(np.int64), rows.column("high").to_numpy().astype(np.int64)
    ahead, ahead_sizes = padded(rows.column("ahead"))
    back, back_sizes = padded(rows.column("back"))
    same = np.append(False, h[1:] == h[:-1])
    common = np.where(same, neighbours(ahead, ahead_sizes), 0)
    left = np.where(same, neighbours(back, back_sizes), 0)
    equal = same & (common == ahead_sizes) & (left == back_sizes)
    equal[1:] &= (ahead_sizes[1:] == ahead_sizes[:-1]) & (back_sizes[1:] == back_sizes[:-1])
    whole = equal.copy()
    whole[:-1] |= equal[1:]
    found = [(np.flatnonzero(whole), low[whole], high[whole])]
    single = np.flatnonzero(~equal)  # one row for each distinct surrounding
    first = np.flatnonzero(~same[single])
    sizes = np.diff(np.append(first, len(single)))
    two = first[sizes == 2]
    for one, other in ((two, two + 1), (two + 1, two)):
        i = single[one]
        seam = single[np.maximum(one, other)]
        a, b = np.maximum(low[i], -left[seam]), np.minimum(high[i], common[seam] - length)
        ok = a <= b
        found.append((i[ok], a[ok], b[ok]))
    for f, m in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        own = single[f : f + m]
        got = solve(np.append(0, common[own[1:]]), back[own], back_sizes[own], low[own], high[own], length)
        if got:
            member, a, b = (np.array(c, dtype=np.int64) for c in zip(*got, strict=True))
            found.append((own[member], a, b))
    index, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    at = rows.column("at").to_numpy()[index]
    return pa.RecordBatch.from_arrays([rows.column("text_key").take(pa.array(index)), pa.array(at + a), pa.array(at + b + length)], ["text_key", "start", "stop"])


def _whole_anchors(batches):
    """Batches that hold whole groups of equal h, from batches in order of h."""
    held: list[pa.RecordBatch] = []  # rows of a group that may go on
    for rows in batches:
        if not rows.num_rows:
            continue
        h = rows.column("h").to_numpy()
        if held and held[-1].column("h")[0].as_py() != h[0]:
            yield _joined(held)
            held = []
        cuts = np.flatnonzero(h[1:] != h[:-1])
        if not len(cuts):
            held.append(rows)
            continue
        end = int(cuts[-1]) + 1
        yield _joined([*held, rows.slice(0, end)])
        held = [rows.slice(end)]
    if held:
        yield _joined(held)


def _spans(suffixes: DataFrame, length: int) -> DataFrame:
    def run(batches):
        known: list[pa.RecordBatch] = []

        def unknown():
            for batch in batches:
                kind = batch.column("kind").to_numpy()
                found = batch.filter(pa.array(kind == FOUND))
                if found.num_rows:
                    at = found.column("at").to_numpy()
                    known.append(pa.RecordBatch.from_arrays([found.column("text_key"), pa.array(at + found.column("low").to_numpy()), pa.array(at + found.column("high").to_numpy() + length)], ["text_key", "start", "stop"]))
                yield batch.filter(pa.array(kind == SUFFIX))

        for own in _whole_anchors(unknown()):
            yield _solve_rows(own, length)
            yield from known
            known.clear()
        yield from known

    return suffixes.repartition("h").sortWithinPartitions("kind", "h", "ahead", "back").mapInArrow(run, SPANS)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _merged(spans: DataFrame) -> DataFrame:
    """text_key and spans: maximal runs as (start, stop) pairs of 64-bit integers."""

    def run(batches):
        key, runs = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([np.array(runs, "<i8").tobytes()], pa.binary())], ["text_key", "spans"])

        for batch in batches:
            for k, a, b in zip(batch.column("text_key").to_pylist(), batch.column("start").to_pylist(), batch.column("stop").to_pylist(), strict=True):
                if k != key:
                    if runs:
                        yield out()
                    key, runs = k, []
                if runs and a <= runs[-1][1]:
                    if b > runs[-1][1]:
                        runs[-1] = (runs[-1][0], b)
                else:
                    runs.append((a, b))
        if runs:
            yield out()

    return spans.repartition("text_key").sortWithinPartitions("text_key", "start").mapInArrow(run, "text_key binary, spans binary")


def _long_texts(docs: DataFrame, length: int) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text")).where(F.expr(f"octet_length(text) >= {length}")).withColumn("text_key", _key())


def _anchors_of(texts: DataFrame, length: int, seed: int, group: int) -> tuple[DataFrame, Filter, Filter | None]:
    """Repeated anchors, the filter that holds them, and that of the hot ones if there are any."""
    counted = cut(_counted(texts, length, seed), "anchors")
    n = counted.agg(F.count("*").alias("n"), F.count_if(F.col("n") > group).alias("hot")).first()
    return counted, _filter_of(counted, n.n), _filter_of(counted.where(F.col("n") > group), n.hot) if n.hot else None


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """text_key (MD5 of the text) and spans (pairs of 64-bit start and stop, in bytes) of texts with repeats."""
    if not 8 <= seed <= length:
        raise ValueError("seed must be from 8 to length")
    texts = _long_texts(docs, length)
    _, repeated, hot = _anchors_of(texts, length, seed, group)
    rows = _suffixes(texts, repeated, hot, length, seed)
    spans = _spans(rows.where(F.col("kind") != STRING), length)
    if hot is not None:
        strings, many = _hot_strings(rows)
        spans = spans.unionByName(semi_join(strings, many, "string", strings.count()).select("text_key", F.col("at").alias("start"), (F.col("at") + length).alias("stop")))
    copies = texts.select("text_key", F.expr("cast(octet_length(text) as bigint)").alias("stop")).groupBy("text_key", "stop").agg(F.count("*").alias("n")).where("n > 1")
    return _merged(spans.unionByName(copies.select("text_key", F.lit(0).cast("long").alias("start"), "stop")))


def _hot_strings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places of the strings of hot anchors (string: 128 bits, text_key, at), and the strings in two places or more with n."""
    strings = cut(rows.where(F.col("kind") == STRING).select(F.col("ahead").alias("string"), "text_key", "at").distinct(), "strings")
    return strings, cut(strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1"), "many")


def repeat_groups(docs: DataFrame, length: int = LENGTH, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """repeat (binary), size, text_key, doc_id and start of every occurrence of every maximal repeat group.

    A group is one string of at least `length` bytes with all the places where it stands; a longer string stands in
    fewer of them, both to its right (its interval has no other members) and to its left (their left extensions
    differ). Groups reach as far as the strings of one anchor do, so a very long repeat comes as several that
    overlap; strings of hot anchors come `length` bytes long. Equal texts stand for one place, with the smallest
    doc_id; copies are in text_key.
    """
    texts = _long_texts(docs, length)
    _, repeated, hot = _anchors_of(texts, length, seed, group)
    rows = _suffixes(texts, repeated, hot, length, seed, merge=False)

    def run(batches):
        for own in _whole_anchors(batches):
            yield from _groups_of(own, length)

    schema = "repeat binary, size long, text_key binary, start long"
    found = rows.where(F.col("kind") == SUFFIX).repartition("h").sortWithinPartitions("h", "ahead", "back").mapInArrow(run, schema)
    if hot is not None:
        strings, many = _hot_strings(rows)
        found = found.unionByName(semi_join(strings, many, "string", strings.count()).select(F.col("string").alias("repeat"), F.lit(length).cast("long").alias("size"), "text_key", F.col("at").alias("start")))
    names = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.expr(f"octet_length(text) >= {length}")).groupBy(_key().alias("text_key")).agg(F.min("doc_id").alias("doc_id"))
    return found.distinct().join(names, "text_key").select("repeat", "size", "text_key", "doc_id", "start")


def _groups_of(rows: pa.RecordBatch, length: int):
    """Maximal repeat groups of whole anchors' suffixes, sorted by (h, ahead, back)."""
    h, at, keys = rows.column("h").to_numpy(), rows.column("at").to_numpy(), rows.column("text_key").to_pylist()
    ahead, ahead_sizes = padded(rows.column("ahead"))
    back, back_sizes = padded(rows.column("back"))
    cuts = [0, *(np.flatnonzero(np.diff(h)) + 1).tolist(), len(h)]
    out: tuple[list, ...] = ([], [], [], [])
    for i, j in zip(cuts, cuts[1:], strict=False):
        common = neighbours(ahead[i:j], ahead_sizes[i:j])
        for size, first, last in intervals(common.tolist()):
            members = np.arange(i + first, i + last + 1)
            order = np.lexsort((back_sizes[members], *back[members].T[::-1]))
            left = neighbours(back[members][order], back_sizes[members][order])
            both = list(intervals(left.tolist()))
            if not any(n == 0 or (a == 0 and b == len(members) - 1) for n, a, b in both):
                both.append((0, 0, len(members) - 1))  # all of them, with nothing in common to the left
            for more, a, b in both:
                if more + size < length:
                    continue
                own = np.sort(members[order[a : b + 1]])
                if int(common[own[0] - i + 1 : own[-1] - i + 1].min()) > size:
                    continue  # a longer string has the same members
                p = own[0]
                name = hashlib.blake2b(back[p, :more][::-1].tobytes() + ahead[p, :size].tobytes(), digest_size=16).digest()
                for m in own.tolist():
                    for column, v in zip(out, (name, size + more, keys[m], int(at[m]) - more), strict=True):
                        column.append(v)
        if len(out[0]) > 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _GROUP_TYPES, strict=True)], _GROUP_NAMES)
            out = ([], [], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _GROUP_TYPES, strict=True)], _GROUP_NAMES)


_GROUP_NAMES = ["repeat", "size", "text_key", "start"]
_GROUP_TYPES = (pa.binary(), pa.int64(), pa.binary(), pa.int64())


def _key():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text adds the kept bytes as `kept` (binary)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(own, length, seed, group)
    # a text's spans are one small row; hashing them spares a sort of the texts. Short texts have none: their keys spread them
    both = own.withColumn("text_key", F.when(F.expr(f"octet_length(text) >= {length}"), _key()).otherwise(F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary"))))).join(spans.hint("shuffle_hash"), "text_key", "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches):
        for batch in text_slices(batches):
            raw, offs = text_bytes(batch.column("text"))
            rows = []
            for a, b, s in zip(offs[:-1].tolist(), offs[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
                runs = np.frombuffer(s, "<i8").reshape(-1, 2).tolist() if s else []
                parts, at = [], a
                for x, y in runs:
                    parts.append(raw[at : a + x])
                    at = a + y
                parts.append(raw[at:b])
                digest = hashlib.sha256()
                for part in parts:
                    digest.update(part)
                rows.append((b - a, sum(y - x for x, y in runs), len(runs), digest.hexdigest(), b"".join(parts) if with_text else None))
            n_bytes, gone, n_spans, sha, kept = zip(*rows, strict=True)
            columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(gone, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if with_text else []), names)

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
