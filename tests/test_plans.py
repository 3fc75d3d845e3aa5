import datetime as dt

import pytest

from tallow.model import INTERVALS, Chunk, CoverageGapError, InvalidRequestError, Kind, Request, normalize_symbol, parse_end, parse_interval, parse_start
from tallow.plans import planner

UTC = dt.UTC
HOUR, MONTH = parse_interval("1h"), parse_interval("1mo")


def t(*a):
    return dt.datetime(*a, tzinfo=UTC)


def kinds(chunks):
    return [(c.kind.value, c.start) for c in chunks]


def test_tables():
    assert kinds(planner.expand(t(2024, 1, 1), t(2024, 4, 1), t(2025, 1, 1), HOUR)) == [("monthly", t(2024, m, 1)) for m in (1, 2, 3)]
    got = planner.expand(t(2024, 1, 15), t(2024, 3, 1), t(2025, 1, 1), HOUR)
    assert kinds(got) == [("daily", t(2024, 1, d)) for d in range(15, 32)] + [("monthly", t(2024, 2, 1))]
    assert kinds(planner.expand(t(2024, 2, 15), t(2024, 4, 10), t(2025, 1, 1), MONTH)) == [("monthly", t(2024, m, 1)) for m in (2, 3, 4)]
    tail = planner.expand(t(2026, 8, 1), t(2026, 8, 18), t(2026, 8, 17), HOUR)
    assert len(tail) == 17 and tail[-1] == Chunk(t(2026, 8, 17), t(2026, 8, 18), Kind.REST)
    assert planner.expand(t(2024, 1, 1), t(2024, 2, 1), None, HOUR) == [Chunk(t(2024, 1, 1), t(2024, 2, 1), Kind.REST)]
    year = planner.expand(t(2024, 12, 20), t(2025, 1, 3), t(2025, 6, 1), HOUR)
    assert kinds(year) == [("daily", t(2024, 12, d)) for d in range(20, 32)] + [("daily", t(2025, 1, d)) for d in (1, 2)]


def test_every_range_is_covered():
    for iv in (HOUR, MONTH):
        for through in (None, t(2024, 2, 10), t(2024, 5, 1)):
            for first in range(40):
                for length in (1, 20, 29, 31, 45, 100):
                    a = t(2023, 12, 20) + dt.timedelta(days=first, hours=first % 5)
                    b = a + dt.timedelta(days=length, minutes=length)
                    planner.check_coverage(planner.expand(a, b, through, iv), a, b)


def test_consolidate_substitute_route():
    def days(a, b):
        return [Chunk(t(2024, 1, d), t(2024, 1, d) + planner.ONE_DAY, Kind.DAILY) for d in range(a, b)]

    assert kinds(planner.consolidate(days(16, 32), lambda m: True)) == [("monthly", t(2024, 1, 1))]
    assert len(planner.consolidate(days(17, 32), lambda m: True)) == 15
    assert planner.consolidate(days(1, 32), None) == days(1, 32) == planner.consolidate(days(1, 32), lambda m: False)
    holed = days(1, 10) + days(11, 32)
    assert planner.consolidate(holed, lambda m: True) == holed
    feb = Chunk(t(2024, 2, 1), t(2024, 3, 1), Kind.MONTHLY)
    assert len(planner.substitute(feb, True)) == 29 and planner.substitute(feb, False)[0].kind is Kind.REST
    with pytest.raises(CoverageGapError):
        planner.substitute(Chunk(t(2024, 2, 1), t(2024, 3, 1)), True)
    months = planner.expand(t(2024, 1, 1), t(2024, 5, 1), t(2024, 5, 1), MONTH)
    routed = planner.route(months, lambda k, s: s.month in (1, 4), False)
    assert routed == [Chunk(t(2024, 1, 1), t(2024, 2, 1), Kind.MONTHLY), Chunk(t(2024, 2, 1), t(2024, 4, 1), Kind.REST), Chunk(t(2024, 4, 1), t(2024, 5, 1), Kind.MONTHLY)]
    some = planner.expand(t(2024, 2, 1), t(2024, 2, 7), t(2024, 3, 1), HOUR)
    assert [c.kind.value for c in planner.route(some, lambda k, s: k is Kind.DAILY and s.day in (3, 4), True)] == ["rest", "daily", "daily", "rest"]
    with pytest.raises(CoverageGapError):
        planner.check_coverage(holed, t(2024, 1, 1), t(2024, 2, 1))
    for bad in ((t(2024, 2, 1), t(2024, 2, 1), None), (t(2024, 1, 1), t(2024, 2, 1), t(2024, 1, 5, 1))):
        with pytest.raises(InvalidRequestError):
            planner.expand(*bad, HOUR)


def test_grids_agree():
    base = [t(2024, 2, 28) + dt.timedelta(hours=7 * k, seconds=k % 3, microseconds=k % 2) for k in range(200)]
    for iv in INTERVALS:
        for x in base:
            up = iv.align_up(x)
            assert iv.aligned(up) and up >= x and (up == x) == iv.aligned(x)
            assert iv.aligned(iv.end(up))
    three, week = parse_interval("3d"), parse_interval("1w")
    assert three.aligned(t(2024, 3, 1)) and three.aligned(t(2024, 4, 3)) and not three.aligned(t(2024, 3, 2))
    assert week.aligned(t(2024, 3, 4)) and not week.aligned(t(2024, 3, 7)) and not week.aligned(t(1970, 1, 1))
    assert parse_interval("1M") is MONTH is not parse_interval("1m")


@pytest.mark.parametrize(("text", "want"), [("btcusdt", "BTCUSDT"), (" BTC/USDT ", "BTCUSDT"), ("eth-btc", "ETHBTC"), ("1000SATS", "1000SATS")])
def test_symbols(text, want):
    assert normalize_symbol(text) == want == normalize_symbol(want)


@pytest.mark.parametrize("text", ["", "ab", "a_b", "BTC.USDT", "BTC USDT", "é123", "x" * 21, "\u0131BTC", "\u212aBTC"])
def test_bad_symbols(text):
    with pytest.raises(InvalidRequestError):
        normalize_symbol(text)


def test_requests():
    assert parse_end("2024-01-31") == t(2024, 1, 31, 23, 59, 59, 999999) and parse_start("2024-01-31T01:00:00.5+01:00") == t(2024, 1, 31, 0, 0, 0, 500000)
    now = t(2024, 6, 1)
    assert Request("btc-usdt", HOUR, t(2024, 1, 1)).resolve(now) == Request("BTCUSDT", HOUR, t(2024, 1, 1), now)
    Request("BTCUSDT", HOUR, now, now).validate()
    for bad in (Request("x", HOUR, now), Request("BTCUSDT", HOUR, now, now - dt.timedelta(microseconds=1)), Request("BTCUSDT", HOUR, dt.datetime(2024, 1, 1)), Request("BTCUSDT", "1h", now)):
        with pytest.raises(InvalidRequestError):
            bad.validate()
    with pytest.raises(InvalidRequestError):
        Request("BTCUSDT", HOUR, t(2025, 1, 1)).resolve(now)
    for text in ("2024-13-01", "yesterday", "2024-01-01T00:00:00"):
        with pytest.raises(InvalidRequestError):
            parse_start(text)
