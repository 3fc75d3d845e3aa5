"""Lossless WebP (VP8L): reader for every transform and code, writer for grey samples.

`decode` reads any lossless still image: prefix codes, back-references, colour cache, meta prefix groups,
and the predictor, cross-colour, subtract-green and palette transforms, undone in reverse order.
`encode_grey` writes 8-bit samples as grey images: the palette transform for up to 16 values, else subtract-green,
after the predictor transform where that makes the file smaller; back-references at any distance, near ones by their
place in the plane; canonical prefix codes. Grey samples leave nothing to cross-colour once green is subtracted, nor to
a colour cache, whose codes would cost what a literal costs: the writer uses neither, the reader takes both.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

#: Fixed values of the format: the order in which code lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Multiplier of the colour cache's hash.
CACHE_MULTIPLIER = 0x1E35A7BD
SIGNATURE = 0x2F
MAX_SIDE = 16384
LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3

#: Near offsets (dx, dy) by code: closest first, then by |dx|, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))

#: Longest green code that the writer makes, and the shortest copy.
GREEN_BITS, SHORTEST = 12, 8
#: Fewest samples that a predictor is tried on: below, there is little to save.
TRIED = 256
ROW = 64
#: Samples of one image: longer payloads become several images.
TILE = ROW * 256


class BadImage(ValueError):
    """Bytes that are not a lossless WebP image."""


class Bits:
    """Little-endian bit reader over bytes."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos, self.size = data, pos, len(data) * 8

    def read(self, n: int) -> int:
        if not n:
            return 0
        p = self.pos
        if p + n > self.size:
            raise BadImage("the image ends early")
        first = p >> 3
        out = int.from_bytes(self.data[first : first + 8], "little") >> (p & 7)
        self.pos = p + n
        return out & ((1 << n) - 1)

    def peek(self) -> int:
        """At least 24 bits; zeros past the end."""
        first = self.pos >> 3
        return int.from_bytes(self.data[first : first + 5], "little") >> (self.pos & 7)


# -- prefix codes ------------------------------------------------------------------------------------


def canonical(lengths) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, length), for lengths by symbol."""
    return canonical_of({s: n for s, n in enumerate(lengths) if n})


def canonical_of(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """canonical, for the lengths of the symbols in use."""
    out, code, last = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[symbol] = (int(_reversed(n)[code]) if n <= GREEN_BITS else int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    return out


def code_lengths(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Lengths of an optimal prefix code with none above `limit`; a lone symbol has length 1."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    least = 1
    while True:
        heap = [(max(c, least), i, s) for i, (s, c) in enumerate(sorted(counts.items()))]
        heapq.heapify(heap)
        parent: dict = {}
        n = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            node = ("n", n)
            parent[a[2]] = parent[b[2]] = node
            heapq.heappush(heap, (a[0] + b[0], n, node))
            n += 1
        depth = {heap[0][2]: 0}
        for node in reversed(parent):
            depth[node] = depth[parent[node]] + 1
        if max(depth[s] for s in counts) <= limit:
            return {s: depth[s] for s in counts}
        least = least * 2 if least > 1 else max(2, sum(counts.values()) >> limit)


@lru_cache(maxsize=16)
def _reversed(n: int) -> np.ndarray:
    """All numbers of n bits, each with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


class Prefix:
    """Decoder of one prefix code."""

    __slots__ = ("lone", "bits", "table", "lengths")

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            used = [0]
        self.lengths = lengths
        self.lone = used[0] if len(used) == 1 else None
        self.bits = 0
        self.table = None
        if self.lone is None:
            self.bits = max(lengths)
            kraft = sum(1 << (self.bits - lengths[s]) for s in used)
            if kraft != 1 << self.bits:
                raise BadImage("a prefix code is not complete")

    def lut(self) -> np.ndarray:
        """By the next `bits` bits: symbol << 4 | length."""
        if self.lone is not None:
            return np.array([self.lone << 4])
        lengths = np.array(self.lengths)
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        n = lengths[order]
        return np.repeat(order << 4 | n, 1 << (self.bits - n))[_reversed(self.bits)]

    def read(self, bits: Bits) -> int:
        if self.lone is not None:
            return self.lone
        if self.table is None:
            self.table = self.lut().tolist()
        found = self.table[bits.peek() & ((1 << self.bits) - 1)]
        bits.pos += found & 15
        if bits.pos > bits.size:
            raise BadImage("the image ends early")
        return found >> 4


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)]
        if two:
            symbols.append(bits.read(8))
        for s in symbols:
            if s >= alphabet:
                raise BadImage("a symbol is outside its alphabet")
            lengths[s] = 1
        return Prefix(lengths)
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    code = Prefix(own)
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    i, last = 0, 8
    while i < alphabet and left > 0:
        left -= 1
        k = code.read(bits)
        if k < 16:
            lengths[i] = k
            last = k or last
            i += 1
            continue
        value, n = (last, 3 + bits.read(2)) if k == 16 else (0, 3 + bits.read(3)) if k == 17 else (0, 11 + bits.read(7))
        if i + n > alphabet:
            raise BadImage("code lengths run over")
        lengths[i : i + n] = [value] * n
        i += n
    return Prefix(lengths)


def read_group(bits: Bits, cache_bits: int) -> list[Prefix]:
    """Codes of green, lengths and cache; red; blue; alpha; distance."""
    green = LITERALS + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0)
    return [read_prefix(bits, n) for n in (green, 256, 256, 256, DISTANCE_CODES)]


def read_value(bits: Bits, code: int) -> int:
    """Length or distance from its prefix symbol and extra bits."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def value_code(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + ((v >> extra) & 1), v & ((1 << extra) - 1), extra


# -- reader ------------------------------------------------------------------------------------------


def _ceil(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _back(code: int, width: int) -> int:
    """How many pixels back a distance code points."""
    if code > len(NEAR):
        return code - len(NEAR)
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


@lru_cache(maxsize=64)
def _near_backs(width: int) -> np.ndarray:
    return np.array([_back(code, width) for code in range(1, len(NEAR) + 1)])


#: By length or distance symbol: the least value and the number of extra bits.
_EXTRA = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(DISTANCE_CODES)])
_LEAST = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(DISTANCE_CODES)])
#: Bits of the longest token: length and distance with their extra bits.
_LONGEST = 15 + 10 + 15 + 18


def _green_only(bits: Bits, width: int, n: int, green: Prefix, distance: Prefix) -> np.ndarray:
    """Green of n pixels whose other components are the same everywhere and take no bits.

    The token that would begin at each bit is read for all bits at once; the tokens that are meant are then the chain
    from the first bit, which is followed in steps of 8.
    """
    if green.lone is not None:
        if green.lone >= LITERALS:
            raise BadImage("a back-reference points outside the image")
        return np.full(n, green.lone, np.uint8)
    base = bits.pos & ~7
    raw = np.frombuffer(bits.data[base >> 3 : (base >> 3) + n * _LONGEST // 8 + 8] + bytes(16), np.uint8).astype(np.int64)
    m = len(raw) - 8
    words = raw[:m] | raw[1 : m + 1] << 8 | raw[2 : m + 2] << 16 | raw[3 : m + 3] << 24 | raw[4 : m + 4] << 32
    window = (words[:, None] >> np.arange(8)).ravel()
    stop = len(window) - 1
    found = green.lut().take(window & ((1 << green.bits) - 1))
    step = found & 15
    copies = np.flatnonzero(found >= LITERALS << 4)
    kind = (found[copies] >> 4) - LITERALS
    at = copies + step[copies]
    length = _LEAST[kind] + (window[np.minimum(at, stop)] & ((1 << _EXTRA[kind]) - 1))
    at += _EXTRA[kind]
    far = distance.lut()[window[np.minimum(at, stop)] & ((1 << distance.bits) - 1)]
    at += far & 15
    far >>= 4
    code = _LEAST[far] + (window[np.minimum(at, stop)] & ((1 << _EXTRA[far]) - 1))
    step[copies] = at + _EXTRA[far] - copies
    step += np.arange(stop + 1)
    jump = [np.minimum(step, stop, out=step)]
    for _ in range(3):
        jump.append(jump[-1].take(jump[-1]))
    seen, a, leap = [], bits.pos - base, jump[3]
    while a < stop and len(seen) * 8 < n:
        seen.append(a)
        a = int(leap[a])
    token = np.array(seen, np.int64)
    for j in (2, 1, 0):
        token = np.stack([token, jump[j][token]], axis=-1).ravel()
    token = token[token < stop]
    own = found[token] >> 4
    copied = own >= LITERALS
    which = np.searchsorted(copies, token[copied])
    size = np.ones(len(token), np.int64)
    size[copied] = length[which]
    end = np.cumsum(size)
    last = int(np.searchsorted(end, n))
    if last == len(end):
        raise BadImage("the image ends early")
    bits.pos = base + int(jump[0][token[last]])
    if bits.pos > bits.size:
        raise BadImage("the image ends early")
    if end[last] != n:
        raise BadImage("a back-reference points outside the image")
    begin, copied = (end - size)[: last + 1], copied[: last + 1]
    out = np.zeros(n, np.uint8)
    out[begin[~copied]] = own[: last + 1][~copied]
    begin = begin[copied]
    which = which[: len(begin)]
    near = _near_backs(width)
    code = code[which]
    back = np.where(code > len(NEAR), code - len(NEAR), near[np.minimum(code, len(NEAR)) - 1])
    if (back > begin).any():
        raise BadImage("a back-reference points outside the image")
    filled = bytearray(out.tobytes())
    for p, k, d in zip(begin.tolist(), length[which].tolist(), back.tolist(), strict=True):
        filled[p : p + k] = filled[p - d : p - d + k] if d >= k else (filled[p - d : p] * (k // d + 1))[:k]
    return np.frombuffer(filled, np.uint8)


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("the colour cache is too large")
    groups_of, tile = None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        meta = _entropy_image(bits, _ceil(width, tile), _ceil(height, tile), False)
        groups_of = ((meta >> 8) & 0xFFFF).reshape(_ceil(height, tile), _ceil(width, tile))
    groups = [read_group(bits, cache_bits) for _ in range(int(groups_of.max()) + 1 if groups_of is not None else 1)]
    n = width * height
    g, r, b, a, d = groups[0]
    if groups_of is None and not cache_bits and None not in (r.lone, b.lone, a.lone):
        rest = np.uint32(a.lone << 24 | r.lone << 16 | b.lone)
        return _green_only(bits, width, n, g, d).astype(np.uint32) << 8 | rest
    out = [0] * n
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    i = kept = 0
    while i < n:
        g, r, b, a, d = groups[groups_of[(i // width) >> tile, (i % width) >> tile] if groups_of is not None else 0]
        s = g.read(bits)
        if s < LITERALS:
            red = r.read(bits)
            blue = b.read(bits)
            out[i] = a.read(bits) << 24 | red << 16 | s << 8 | blue
            i += 1
        elif s < LITERALS + LENGTH_CODES:
            length = read_value(bits, s - LITERALS)
            back = _back(read_value(bits, d.read(bits)), width)
            if back > i or i + length > n:
                raise BadImage("a back-reference points outside the image")
            for k in range(i, i + length):
                out[k] = out[k - back]
            i += length
        else:
            while kept < i:
                cache[(CACHE_MULTIPLIER * out[kept] & 0xFFFFFFFF) >> shift] = out[kept]
                kept += 1
            out[i] = cache[s - LITERALS - LENGTH_CODES]
            i += 1
    return np.array(out, dtype=np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """ARGB values as rows of four int32 components: alpha, red, green, blue."""
    return np.stack([(pixels >> s & 0xFF).astype(np.int32) for s in (24, 16, 8, 0)], axis=-1)


def _pack(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _half(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def predict(mode: int, left, top, right, corner) -> list[int]:
    """The predicted pixel from its left, top, top-right and top-left neighbours, by component."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _half(_half(left, right), top)
    if mode == 6:
        return _half(left, corner)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(corner, top)
    if mode == 9:
        return _half(top, right)
    if mode == 10:
        return _half(_half(left, corner), _half(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [_clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        mid = _half(left, top)
        return [_clamp(m + int((m - c) / 2)) for m, c in zip(mid, corner, strict=True)]
    return [255, 0, 0, 0]


def walk_predictions(residual: np.ndarray, modes: np.ndarray, size: int, width: int, height: int, forward: bool) -> np.ndarray:
    """Undo (or, with forward, apply) the predictor transform; pixels are flat rows of four components."""
    mode = int(modes.flat[0])
    if not forward and mode in (1, 2) and (modes == mode).all():
        c = residual.reshape(height, width, 4).astype(np.int64)
        c[0, 0, 0] += 255
        across, down = (slice(None), 0) if mode == 1 else (0, slice(None)), 0 if mode == 1 else 1
        c[across] = np.cumsum(c[across], axis=0)  # the edge that the other neighbour predicts
        return (np.cumsum(c, axis=1 - down) & 255).reshape(-1, 4).astype(np.int32)
    src = residual.tolist()
    done = src if forward else [None] * len(src)
    out: list = [None] * len(src)
    sign = -1 if forward else 1
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not i:
                guess = [255, 0, 0, 0]
            elif not y:
                guess = done[i - 1]
            elif not x:
                guess = done[i - width]
            else:
                guess = predict(int(modes[y >> size, x >> size]), done[i - 1], done[i - width], done[i - width + 1], done[i - width - 1])
            out[i] = [(v + sign * g) & 255 for v, g in zip(src[i], guess, strict=True)]
            if not forward:
                done[i] = out[i]
    return np.array(out, dtype=np.int32)


def _signed(v: np.ndarray) -> np.ndarray:
    return ((v & 0xFF) ^ 0x80) - 0x80


def cross_colour(c: np.ndarray, marks: np.ndarray, size: int, width: int, height: int, forward: bool) -> np.ndarray:
    """Undo (or apply) the cross-colour transform; marks: alpha, red-to-blue, green-to-blue, green-to-red by block."""
    y, x = np.divmod(np.arange(width * height), width)
    m = _signed(marks[y >> size, x >> size])
    c = c.copy()
    green, sign = _signed(c[:, 2]), -1 if forward else 1
    old_red = c[:, 1].copy()
    c[:, 1] = (c[:, 1] + sign * (m[:, 3] * green >> 5)) & 255
    true_red = _signed(old_red if forward else c[:, 1])
    c[:, 3] = (c[:, 3] + sign * ((m[:, 2] * green >> 5) + (m[:, 1] * true_red >> 5))) & 255
    return c


def read_header(data: bytes, start: int = 0) -> tuple[int, bytes]:
    """End of the RIFF file that begins at `start`, and its VP8L chunk."""
    if data[start : start + 4] != b"RIFF" or data[start + 8 : start + 16] != b"WEBPVP8L":
        raise BadImage("not a lossless WebP file")
    size = int.from_bytes(data[start + 16 : start + 20], "little")
    end = start + 8 + int.from_bytes(data[start + 4 : start + 8], "little")
    chunk = data[start + 20 : start + 20 + size]
    if len(chunk) != size or end > len(data) or end < start + 20 + size:
        raise BadImage("the file ends early")
    return end, chunk


def _read_start(chunk: bytes) -> tuple[Bits, int, int]:
    bits = Bits(chunk)
    if bits.read(8) != SIGNATURE:
        raise BadImage("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadImage("unknown version")
    return bits, width, height


def _read_transforms(bits: Bits, width: int, height: int) -> tuple[list[tuple], int]:
    """Transforms as read, and the width of what is coded."""
    steps, seen = [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            shape = (_ceil(height, size), _ceil(width, size))
            data = _entropy_image(bits, shape[1], shape[0], False)
            steps.append((kind, size, _channels(data).reshape(*shape, 4), width))
        elif kind == SUBTRACT_GREEN:
            steps.append((kind, 0, None, width))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(_entropy_image(bits, n, 1, False)), axis=0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, pack, _pack(table), width))
            width = _ceil(width, pack)
    return steps, width


def _undo(pixels: np.ndarray, steps: list[tuple], height: int) -> np.ndarray:
    for kind, size, data, width in reversed(steps):
        if kind == PALETTE:
            table = np.zeros(256, dtype=np.uint32)
            table[: len(data)] = data
            index = (pixels >> 8 & 0xFF).reshape(height, -1)
            if size:
                each = 8 >> size
                parts = [(index >> (each * k)) & ((1 << each) - 1) for k in range(1 << size)]
                index = np.stack(parts, axis=-1).reshape(height, -1)[:, :width]
            pixels = table[index.ravel()]
            continue
        c = _channels(pixels)
        if kind == SUBTRACT_GREEN:
            c[:, 1] = (c[:, 1] + c[:, 2]) & 255
            c[:, 3] = (c[:, 3] + c[:, 2]) & 255
        elif kind == CROSS_COLOUR:
            c = cross_colour(c, data, size, width, height, False)
        else:
            c = walk_predictions(c, data[..., 2], size, width, height, False)
        pixels = _pack(c)
    return pixels


def decode(chunk: bytes) -> np.ndarray:
    """Pixels of a VP8L chunk as a (height, width) array of ARGB values."""
    bits, width, height = _read_start(chunk)
    steps, coded = _read_transforms(bits, width, height)
    pixels = _entropy_image(bits, coded, height, True)
    return _undo(pixels, steps, height).reshape(height, width)


def decode_grey(chunks: list[bytes]) -> list[np.ndarray]:
    """Green samples of each VP8L chunk, flat, row by row."""
    return [(decode(c).ravel() >> 8 & 0xFF).astype(np.uint8) for c in chunks]


# -- writer ------------------------------------------------------------------------------------------


class BitsOut:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def flags(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.n]


def put_prefix(out: BitsOut, lengths: dict[int, int], alphabet: int) -> dict[int, tuple[int, int]]:
    """Write a code by its lengths; symbol -> (code, length) as the reader takes them."""
    used = sorted(lengths)
    if len(used) <= 2 and (not used or used[-1] < 256):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    out.put(0, 1)
    runs: list[tuple[int, int, int]] = []  # symbol, extra, its bits
    next_one = 0
    for s in [*used, alphabet]:
        zeros = s - next_one
        while zeros >= 3:
            n = min(zeros, 138)
            runs.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
            zeros -= n
        runs += [(0, 0, 0)] * zeros
        if s < alphabet:
            runs.append((lengths[s], 0, 0))
        next_one = s + 1
    counts: dict[int, int] = {}
    for s, _, _ in runs:
        counts[s] = counts.get(s, 0) + 1
    own = code_lengths(counts, 7)
    most = max(i for i, s in enumerate(LENGTH_ORDER) if s in own) + 1
    most = max(most, 4)
    out.put(most - 4, 4)
    for s in LENGTH_ORDER[:most]:
        out.put(own.get(s, 0), 3)
    out.put(0, 1)
    codes = canonical_of(own)
    for s, extra, n in runs:
        if len(own) > 1:
            out.put(*codes[s])
        out.put(extra, n)
    return canonical_of(lengths) if len(used) > 1 else {used[0]: (0, 0)}


def riff(vp8l: bytes) -> bytes:
    body = b"WEBPVP8L" + len(vp8l).to_bytes(4, "little") + vp8l + bytes(len(vp8l) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


@lru_cache(maxsize=64)
def _near_codes(width: int) -> np.ndarray:
    """Distance code by distance, 0 where no near offset of a plane of that width has it."""
    out = np.zeros(8 + 7 * width + 1, np.int64)
    for code in range(len(NEAR), 0, -1):
        out[_back(code, width)] = code
    return out


def value_codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """value_code of many values."""
    v = values.astype(np.int64) - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    extra = np.maximum(top - 1, 0)
    small = v < 4
    return np.where(small, v, 2 * top + (v >> extra & 1)), np.where(small, 0, v & ((1 << extra) - 1)), np.where(small, 0, extra)


def copies_of(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of copies that don't overlap, each of the nearest place that holds the same samples.

    Places where the last SHORTEST samples came before are taken by sorting; stretches of places with the same
    distance are copies.
    """
    n = len(samples) - SHORTEST + 1
    if n < 2:
        return []
    key = np.ndarray(n, "<u8", np.ascontiguousarray(samples), strides=(1,)).copy()
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    distance = np.zeros(n, np.int64)
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    edge = np.flatnonzero(np.diff(distance)) + 1
    begin, end = np.concatenate([[0], edge]), np.append(edge, n)
    take = distance[begin] > 0
    out, free = [], 0
    for s, e, d in zip(begin[take].tolist(), end[take].tolist(), distance[begin[take]].tolist(), strict=True):
        s, e = max(s, free), e + SHORTEST - 1
        if e - s < SHORTEST:
            continue
        free = e
        for at in range(s, e, 4096):
            out.append((at, min(4096, e - at), d))
    return out


def _put_codes(out: BitsOut, counts: np.ndarray, alphabet: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Write the code of symbols counted; code and length by symbol."""
    used = np.flatnonzero(counts)
    code, size = np.zeros(alphabet, np.uint64), np.zeros(alphabet, np.int64)
    lengths = code_lengths(dict(zip(used.tolist(), counts[used].tolist(), strict=True)), limit) if len(used) else {0: 1}
    for s, (c, n) in put_prefix(out, lengths, alphabet).items():
        code[s], size[s] = c, n
    return code, size


def _put_green(out: BitsOut, samples: np.ndarray, width: int, alpha: int) -> np.ndarray:
    """Write the codes of pixels whose other components are 0, 0 and alpha; the pixels as bits to follow."""
    copies = np.array(copies_of(samples), np.int64).reshape(-1, 3)
    keep = np.ones(len(samples), bool)
    inner = np.zeros(len(samples) + 1, np.int64)
    np.add.at(inner, copies[:, 0], 1)
    np.add.at(inner, copies[:, 0] + copies[:, 1], -1)
    keep[np.cumsum(inner[:-1]) > 0] = False
    lit = np.flatnonzero(keep)
    near = _near_codes(width)
    back = copies[:, 2]
    close = near[np.minimum(back, len(near) - 1)] * (back < len(near))
    length, extra, n_extra = value_codes(copies[:, 1])
    far, far_extra, n_far = value_codes(np.where(close > 0, close, back + len(NEAR)))
    order = np.argsort(np.concatenate([lit, copies[:, 0]]), kind="stable")
    symbols = np.concatenate([samples[lit].astype(np.int64), LITERALS + length])
    out.put(0, 2)  # no colour cache, one prefix group
    green, green_size = _put_codes(out, np.bincount(symbols), LITERALS + LENGTH_CODES, GREEN_BITS)
    for lone in (0, 0, alpha):
        put_prefix(out, {lone: 1}, 256)
    dist, dist_size = _put_codes(out, np.bincount(far), DISTANCE_CODES, 15)
    value, size = green[symbols], green_size[symbols]
    tail, k = slice(len(lit), None), np.uint64
    for bits, width_of in ((extra, n_extra), (dist[far], dist_size[far]), (far_extra, n_far)):
        value[tail] |= bits.astype(k) << size[tail].astype(k)
        size[tail] += width_of
    value, size = value[order], size[order]
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    return (np.repeat(value, size) >> place.astype(k) & k(1)).astype(np.uint8)


def residual(samples: np.ndarray, width: int, mode: int) -> np.ndarray:
    """Grey samples less their left (mode 1) or upper (mode 2) neighbour; edges by the only neighbour they have."""
    own = samples.reshape(-1, width)
    out = own.copy()
    if mode == 1:
        out[:, 1:] -= own[:, :-1]
        out[1:, 0] -= own[:-1, 0]
    else:
        out[1:] -= own[:-1]
        out[0, 1:] -= own[0, :-1]
    return out.ravel()


def _cost(samples: np.ndarray) -> float:
    """Bits of the samples by their frequencies alone."""
    n = np.bincount(samples, minlength=256)
    n = n[n > 0]
    return float((n * np.log2(len(samples) / n)).sum())


def _start(width: int, height: int) -> BitsOut:
    out = BitsOut()
    for v, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 4)):
        out.put(v, n)
    return out


def _finish(out: BitsOut, coded: np.ndarray, width: int, alpha: int) -> bytes:
    flags = _put_green(out, coded, width, alpha)
    return np.packbits(np.concatenate([out.flags(), flags]), bitorder="little").tobytes()


def _with_palette(samples: np.ndarray, values: np.ndarray, width: int) -> bytes:
    height = len(samples) // width
    out = _start(width, height)
    out.put(1 | PALETTE << 1, 3)
    out.put(len(values) - 1, 8)
    step = np.diff(values, prepend=0)
    out.put(0, 1)  # no colour cache
    seen: dict[int, int] = {}
    for s in step.tolist():
        seen[s] = seen.get(s, 0) + 1
    codes = put_prefix(out, code_lengths(seen, 15), LITERALS + LENGTH_CODES)
    put_prefix(out, code_lengths(seen, 15), 256)
    put_prefix(out, code_lengths(seen, 15), 256)
    put_prefix(out, {255: 1, 0: 1} if len(values) > 1 else {255: 1}, 256)
    put_prefix(out, {0: 1}, DISTANCE_CODES)
    for k, s in enumerate(step.tolist()):
        for _ in range(3):
            out.put(*codes[s])
        if len(values) > 1:
            out.put(*((1, 1) if k == 0 else (0, 1)))
    out.put(0, 1)  # no more transforms
    pack = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
    place = np.zeros(256, dtype=np.uint8)
    place[values] = np.arange(len(values))
    index = place[samples].reshape(height, -1)
    index = np.pad(index, ((0, 0), (0, -width % (1 << pack)))).reshape(height, -1, 1 << pack).astype(np.uint32)
    coded = (index << (np.arange(1 << pack, dtype=np.uint32) * (8 >> pack))).sum(axis=2).astype(np.uint8)
    return _finish(out, coded.ravel(), coded.shape[1], 255)


def _with_predictor(samples: np.ndarray, width: int, mode: int) -> bytes:
    """Mode 0: as it is."""
    out = _start(width, len(samples) // width)
    if mode:
        out.put(1 | PREDICTOR << 1, 3)
        out.put(7, 3)  # blocks of 512
        out.put(0, 1)  # no colour cache; the same mode for every block takes codes and no bits
        for lone in (mode, 0, 0, 255):
            put_prefix(out, {lone: 1}, 256)
        put_prefix(out, {0: 1}, DISTANCE_CODES)
    out.put(1 | SUBTRACT_GREEN << 1, 3)
    out.put(0, 1)  # no more transforms
    return _finish(out, residual(samples, width, mode) if mode else samples, width, 0 if mode else 255)


def encode_grey(samples: np.ndarray, width: int = ROW) -> bytes:
    """A lossless WebP file of grey samples (0 to 255) in rows of `width`.

    A predictor is tried on TRIED samples and more, where frequencies alone say that it may pay, and kept where the file
    is smaller.
    """
    height = len(samples) // width
    if not height or height * width != len(samples) or max(width, height) > MAX_SIDE:
        raise ValueError("samples must fill rows of the width")
    samples = samples.astype(np.uint8)
    values = np.flatnonzero(np.bincount(samples, minlength=256))
    if len(values) <= 16:
        return riff(_with_palette(samples, values, width))
    files = [_with_predictor(samples, width, 0)]
    plain = _cost(samples)
    if len(samples) >= TRIED:
        files += [_with_predictor(samples, width, m) for m in (1, 2) if _cost(residual(samples, width, m)) < plain]
    return riff(min(files, key=len))
