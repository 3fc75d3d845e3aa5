import hashlib
import zlib

import numpy as np
import pytest

from tallow.llm import media, webp


def put_image(out, pixels, cache_bits=0, copies=(), groups=None, meta=None):
    """Write pixels (ARGB, flat) with fixed eight-bit codes; test-side writer for what encode_grey doesn't use.

    copies: {index: (length, distance code)}; groups: how often the codes are written (meta groups).
    """
    if cache_bits:
        out.put(1, 1)
        out.put(cache_bits, 4)
    else:
        out.put(0, 1)
    if meta is not None:
        out.put(*meta[:2])
        if meta[2] is not None:
            put_image(out, meta[2])
    size = 280 + ((1 << cache_bits) if cache_bits else 0)
    n = size.bit_length()
    short = (1 << n) - size  # lengths n - 1 for these and n for the rest: a complete code
    lengths = {s: n - 1 if s < short else n for s in range(size)}
    for _ in range(groups or 1):
        green = webp.put_prefix(out, lengths, size)
        flat = [webp.put_prefix(out, dict.fromkeys(range(256), 8), 256) for _ in range(3)]
        dist = webp.put_prefix(out, {s: 5 if s < 24 else 6 for s in range(40)}, 40)
    cache = {}
    i, copies = 0, dict(copies)
    px = pixels.tolist()
    while i < len(px):
        v = px[i]
        key = (webp.CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if i in copies:
            length, code = copies[i]
            s, extra, n = webp.value_code(length)
            out.put(*green[256 + s])
            out.put(extra, n)
            s, extra, n = webp.value_code(code)
            out.put(*dist[s])
            out.put(extra, n)
            for v in px[i : i + length]:
                if cache_bits:
                    cache[(webp.CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
            i += length
            continue
        if cache_bits and cache.get(key) == v:
            out.put(*green[280 + key])
        else:
            out.put(*green[v >> 8 & 255])
            out.put(*flat[0][v >> 16 & 255])
            out.put(*flat[1][v & 255])
            out.put(*flat[2][v >> 24])
        if cache_bits:
            cache[key] = v
        i += 1


def start(width, height):
    out = webp.BitsOut()
    for v, n in ((webp.SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    return out


def done(out):
    return out.value.to_bytes((out.n + 7) // 8, "little")


@pytest.fixture
def pixels():
    return np.random.default_rng(3).integers(0, 1 << 32, 21 * 13, dtype=np.uint32)


def test_colour_cache_and_copies(pixels):
    pixels[50:70] = pixels[29:49]  # a row above: dx 0, dy 1
    pixels[150:170] = pixels[150]
    out = start(21, 13)
    out.put(0, 1)
    put_image(out, pixels, 6, {50: (20, 1), 151: (19, 2)}, meta=(0, 1, None))
    assert (webp.decode(done(out)).ravel() == pixels).all()


def test_far_copy_and_meta_groups(pixels):
    pixels[200:210] = pixels[10:20]
    out = start(21, 13)
    out.put(0, 1)
    tiles = np.array([((i % 2) << 8) for i in range(6 * 4)], dtype=np.uint32)
    put_image(out, pixels, 0, {200: (10, 190 + 120)}, groups=2, meta=(1 | 0 << 1, 4, tiles))
    assert (webp.decode(done(out)).ravel() == pixels).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor(pixels, mode):
    out = start(21, 13)
    out.put(1 | webp.PREDICTOR << 1, 3)
    out.put(0, 3)
    modes = np.full((4, 6), mode)
    put_image(out, np.full(24, mode << 8, dtype=np.uint32))
    out.put(0, 1)
    coded = webp._pack(webp.walk_predictions(webp._channels(pixels), modes, 2, 21, 13, True))
    put_image(out, coded, meta=(0, 1, None))
    assert (webp.decode(done(out)).ravel() == pixels).all()


def test_select_and_clamps_by_hand():
    assert webp.predict(11, [0, 10, 0, 0], [0, 90, 0, 0], None, [0, 80, 0, 0]) == [0, 10, 0, 0]
    assert webp.predict(11, [0, 10, 0, 0], [0, 90, 0, 0], None, [0, 20, 0, 0]) == [0, 90, 0, 0]
    assert webp.predict(12, [200] * 4, [100] * 4, None, [10] * 4) == [255] * 4
    assert webp.predict(13, [10] * 4, [20] * 4, None, [18] * 4) == [14] * 4
    assert webp.predict(10, [10] * 4, [20] * 4, [31] * 4, [12] * 4) == [18] * 4


def test_cross_colour_then_subtract_green(pixels):
    out = start(21, 13)
    marks = np.random.default_rng(5).integers(0, 1 << 24, 24, dtype=np.uint32) | np.uint32(0xFF000000)
    out.put(1 | webp.CROSS_COLOUR << 1, 3)
    out.put(0, 3)
    put_image(out, marks)
    out.put(1 | webp.SUBTRACT_GREEN << 1, 3)
    out.put(0, 1)
    c = webp.cross_colour(webp._channels(pixels), webp._channels(marks).reshape(4, 6, 4), 2, 21, 13, True)
    c[:, 1] = (c[:, 1] - c[:, 2]) & 255
    c[:, 3] = (c[:, 3] - c[:, 2]) & 255
    put_image(out, webp._pack(c), meta=(0, 1, None))
    assert (webp.decode(done(out)).ravel() == pixels).all()


def test_near_offsets():
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert webp.NEAR[-5:] == [(8, 5), (7, 7), (-7, 7), (8, 6), (8, 7)]
    assert len(webp.NEAR) == 120


@pytest.mark.parametrize("seed", range(6))
def test_grey_round_trip(seed):
    rng = np.random.default_rng(seed)
    many = [rng.integers(0, top, 64 * rows).astype(np.uint8) for top, rows in ((1, 1), (2, 5), (4, 5), (16, 9), (17, 3), (256, 200), (40, 256))]
    many += [np.repeat(rng.integers(0, 60, 64), 100).astype(np.uint8), np.minimum(rng.geometric(0.5, 6400), 255).astype(np.uint8)]
    files = [webp.encode_grey(m) for m in many]
    chunks = [webp.read_header(f)[1] for f in files]
    for m, c, back in zip(many, chunks, webp.decode_grey(chunks), strict=True):
        assert (back == m).all()
        assert (webp.decode(c).ravel() == m.astype(np.uint32) * 0x10101 + 0xFF000000).all()


@pytest.mark.parametrize("cut", [3, 25, 60])
def test_bad_images(cut):
    whole = webp.encode_grey(np.arange(128, dtype=np.uint8))
    with pytest.raises(webp.BadImage):
        webp.decode(webp.read_header(whole[:cut])[1])


def test_digests(spark):
    texts = [None, "", "a" * 64, "é" * 33, "word " * 9000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.round_trip_digests(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pay = media.payload_of(raw)
        assert len(pay) % 64 == 0 and len(pay) >= 64
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert got[5].media_sha256 == got[6].media_sha256 and got[5].feature == got[6].feature
    stored = {r.doc_id: r.media for r in media.store(docs).collect()}
    assert all(len(stored[i]) == got[i].media_bytes and hashlib.sha256(stored[i]).hexdigest() == got[i].media_sha256 for i in stored)
    pixels = {r.doc_id: r for r in media.read_pixels(media.store(docs)).collect()}
    assert (pixels[2].width, pixels[2].height, pixels[2].pixels) == (64, 1, [0xFF616161] * 64)
    assert media.round_trip_digests(docs.limit(0)).count() == 0


def test_pixels_of_every_image(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(2 * webp.TILE + 1000))
    docs = spark.createDataFrame([(1, text), (2, "a" * webp.TILE), (3, "b" * (webp.TILE + 1)), (4, "")], "doc_id long, text string")
    stored = media.store(docs).select("doc_id", "media").union(spark.createDataFrame([(5, None), (6, bytearray())], "doc_id long, media binary"))
    rows = sorted(media.read_pixels(stored).collect(), key=lambda r: (r.doc_id, r.image or 0))
    assert [(r.doc_id, r.image, r.width, r.height) for r in rows] == [(1, 0, 64, 256), (1, 1, 64, 256), (1, 2, 64, 16), (2, 0, 64, 256), (3, 0, 64, 256), (3, 1, 64, 1), (4, 0, 64, 1), (5, None, None, None), (6, None, None, None)]
    for i, t in ((1, text), (3, "b" * (webp.TILE + 1))):
        samples = bytes(p & 255 for r in rows if r.doc_id == i for p in r.pixels)
        assert samples == media.payload_of(t.encode()) and len(samples) > webp.TILE
    assert rows[-1].pixels is None and rows[-2].pixels is None


def kinds(file):
    bits, width, height = webp._read_start(webp.read_header(file)[1])
    return [step[0] for step in webp._read_transforms(bits, width, height)[0]]


@pytest.mark.parametrize("mode", [1, 2])
def test_predictor_is_written_where_it_pays(mode):
    rng = np.random.default_rng(mode)
    small = rng.integers(-2, 3, (90, 64))
    own = (np.cumsum(small, axis=1 if mode == 1 else 0) + 128).astype(np.uint8).ravel()
    file = webp.encode_grey(own)
    assert kinds(file) == [webp.PREDICTOR, webp.SUBTRACT_GREEN]
    assert len(file) < 0.6 * len(webp.riff(webp._with_predictor(own, 64, 0)))
    assert (webp.decode_grey([webp.read_header(file)[1]])[0] == own).all()


@pytest.mark.parametrize("mode", [1, 2])
def test_sums_equal_the_walk(pixels, mode):
    c = webp._channels(pixels)
    modes = np.full((4, 6), mode)
    one_other = modes.copy()
    one_other[3, 5] = 4 if mode == 1 else 3
    coded = webp.walk_predictions(c, modes, 2, 21, 13, True)
    assert (webp.walk_predictions(coded, modes, 2, 21, 13, False) == c).all()
    mixed = webp.walk_predictions(c, one_other, 2, 21, 13, True)
    assert (webp.walk_predictions(mixed, one_other, 2, 21, 13, False) == c).all()


def test_copies_hold_what_they_copy():
    rng = np.random.default_rng(11)
    words = [rng.integers(97, 123, int(n)).astype(np.uint8) for n in rng.integers(3, 40, 30)]
    own = np.concatenate([words[i] for i in rng.integers(0, 30, 900)])
    own = np.concatenate([own, np.full(9000, 65, np.uint8)])
    end, out = 0, own.copy()
    for at, n, back in webp.copies_of(own):
        assert at >= end and 1 <= back <= at and 1 <= n <= 4096
        for k in range(at, at + n):
            assert own[k] == own[k - back]
        end = at + n
    assert any(back > 64 for _, _, back in webp.copies_of(own)) and any(back == 1 for _, _, back in webp.copies_of(own))
    assert webp.copies_of(out[:7]) == []


@pytest.mark.parametrize("width", [64, 32, 8])
def test_near_and_far_copies_round_trip(width):
    rng = np.random.default_rng(width)
    line = rng.integers(0, 200, width * 3).astype(np.uint8)
    far = rng.integers(0, 200, width * 40).astype(np.uint8)
    own = np.concatenate([line, line, far, line[1:], line[:1], far[5:], line[: width + 5]])
    file = webp.encode_grey(own, width)
    assert (webp.decode_grey([webp.read_header(file)[1]])[0] == own).all()
    assert len(file) < 0.7 * len(own)
    near = webp._near_codes(width)
    for d in range(1, len(near)):
        assert not near[d] or webp._back(int(near[d]), width) == d
    assert near[width] == 1 and near[1] == 2


def test_value_codes_equal_the_single_ones():
    many = np.arange(1, 70000)
    assert [tuple(t) for t in zip(*(a.tolist() for a in webp.value_codes(many)), strict=True)] == [webp.value_code(v) for v in many.tolist()]


def test_bits_that_stop_or_point_outside():
    own = np.random.default_rng(1).integers(0, 90, 64 * 20).astype(np.uint8)
    chunk = webp.read_header(webp.encode_grey(own))[1]
    for cut in (200, 500, len(chunk) - 3):
        with pytest.raises(webp.BadImage):
            webp.decode(chunk[:cut])
    rng = np.random.default_rng(2)
    for _ in range(300):
        broken = bytearray(chunk)
        broken[int(rng.integers(5, len(chunk)))] ^= 1 << int(rng.integers(8))
        try:
            assert webp.decode(bytes(broken)).size
        except webp.BadImage:
            pass
