"""Candles, intervals, requests, chunks and typed failures."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import types as T

UTC = dt.UTC
MICRO = dt.timedelta(microseconds=1)
SECOND = 1_000_000
DAY = 86_400 * SECOND


class TallowError(Exception):
    """Base of the library's failures."""


class InvalidRequestError(TallowError, ValueError):
    """The caller's mistake; nothing was read."""


class NotAvailableError(TallowError):
    """Upstream has no data where data is due."""


class ChecksumError(TallowError):
    """Bytes differ from their published SHA-256."""


class CorruptArchiveError(TallowError):
    """Bytes are as published but their content is not valid."""


class RateLimitedError(TallowError):
    """Upstream asked to slow down and retries did not help."""


class BannedError(RateLimitedError):
    """Upstream refuses this address; retrying makes it worse."""


class CoverageGapError(TallowError):
    """No source is left for a span."""


_NUMBER = T.DecimalType(38, 8)
COLUMNS = ("open_time", "close_time", "open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume", "trades")
PRICES, VOLUMES = COLUMNS[2:6], COLUMNS[6:10]
CANDLE_SCHEMA = T.StructType(
    [T.StructField(c, T.TimestampType(), False) for c in COLUMNS[:2]] + [T.StructField(c, _NUMBER, False) for c in COLUMNS[2:10]] + [T.StructField("trades", T.LongType(), False)]
)
#: Order of the twelve fields on the wire; the last is unused.
WIRE = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base_volume", "taker_buy_quote_volume", "ignore")
#: Instants from here on are microseconds, below it milliseconds.
MICROS_FROM = 10**14


@dataclass(frozen=True)
class Interval:
    """A candle width. micros is 0 for calendar months; anchor is a grid point in microseconds since 1970."""

    name: str
    micros: int
    rest: str
    anchor: int = 0
    daily: bool = True

    def aligned(self, t: dt.datetime) -> bool:
        if not self.micros:
            return t == t.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        return (micros_of(t) - self.anchor) % self.micros == 0

    def align_up(self, t: dt.datetime) -> dt.datetime:
        """The first open at or after t."""
        if not self.micros:
            first = month_start(t)
            return t if t == first else next_month(first)
        return instant(self.anchor + -(-(micros_of(t) - self.anchor) // self.micros) * self.micros)

    def end(self, t: dt.datetime) -> dt.datetime:
        """The open after the candle that opens at t."""
        return t + dt.timedelta(microseconds=self.micros) if self.micros else next_month(month_start(t))

    def __str__(self) -> str:
        return self.name


def _fixed(name: str, seconds: int, **more) -> Interval:
    return Interval(name, seconds * SECOND, name, **more)


#: Three-day candles open on a grid through 1970-01-02, weekly ones on Mondays; wider than a day come monthly only.
INTERVALS = (
    *(_fixed(n, s) for n, s in (("1s", 1), ("1m", 60), ("3m", 180), ("5m", 300), ("15m", 900), ("30m", 1800), ("1h", 3600), ("2h", 7200), ("4h", 14400), ("6h", 21600), ("8h", 28800), ("12h", 43200), ("1d", 86400))),
    _fixed("3d", 3 * 86400, anchor=DAY, daily=False),
    _fixed("1w", 7 * 86400, anchor=4 * DAY, daily=False),
    Interval("1mo", 0, "1M", daily=False),
)
_BY_NAME = {s: i for i in INTERVALS for s in (i.name, i.rest)}


def parse_interval(text: str) -> Interval:
    """Either spelling of a month; case counts, since 1m and 1M differ."""
    if text not in _BY_NAME:
        raise InvalidRequestError(f"unknown interval {text!r}")
    return _BY_NAME[text]


class Market(Enum):
    SPOT = "spot"

    @classmethod
    def parse(cls, text: str) -> Market:
        try:
            return cls(text)
        except ValueError:
            raise InvalidRequestError(f"unknown market {text!r}") from None

    def __str__(self) -> str:
        return self.value


class Kind(Enum):
    """Where a chunk comes from."""

    MONTHLY = "monthly"
    DAILY = "daily"
    REST = "rest"

    @property
    def source(self) -> str:
        return "rest api" if self is Kind.REST else f"{self.value} archive"


@dataclass(frozen=True, order=True)
class Chunk:
    """A source and the half-open span it stands for."""

    start: dt.datetime
    end: dt.datetime
    kind: Kind = Kind.REST

    def __str__(self) -> str:
        return f"{self.kind.value} [{stamp(self.start)}, {stamp(self.end)})"


# -- instants -------------------------------------------------------------------------------------------

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=UTC)


def micros_of(t: dt.datetime) -> int:
    d = t - _EPOCH
    return (d.days * 86_400 + d.seconds) * SECOND + d.microseconds


def instant(micros: int) -> dt.datetime:
    return _EPOCH + dt.timedelta(microseconds=micros)


def day_start(t: dt.datetime) -> dt.datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def month_start(t: dt.datetime) -> dt.datetime:
    return day_start(t).replace(day=1)


def next_month(first: dt.datetime) -> dt.datetime:
    return (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)


def stamp(t: dt.datetime) -> str:
    """RFC 3339 in UTC, the fraction without trailing zeros."""
    text = t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S")
    return text + (f".{t.microsecond:06d}".rstrip("0") if t.microsecond else "") + "Z"


_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_INSTANT = re.compile(r"(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})")


def parse_instant(text: str) -> tuple[dt.datetime, bool]:
    """A date or an RFC 3339 instant, and whether it was a date; digits below a microsecond are cut off."""
    try:
        if _DATE.fullmatch(text):
            return dt.datetime.fromisoformat(text).replace(tzinfo=UTC), True
        if m := _INSTANT.fullmatch(text):
            fraction = (m[3] or "").ljust(6, "0")[:6]
            return dt.datetime.fromisoformat(f"{m[1]}T{m[2]}.{fraction}{m[4].replace('Z', '+00:00')}").astimezone(UTC), False
    except ValueError:
        pass
    raise InvalidRequestError(f"{text!r} is neither YYYY-MM-DD nor an RFC 3339 instant")


def parse_start(text: str) -> dt.datetime:
    return parse_instant(text)[0]


def parse_end(text: str) -> dt.datetime:
    """A bare date means all of that day."""
    t, whole_day = parse_instant(text)
    return t + dt.timedelta(days=1) - MICRO if whole_day else t


# -- requests -------------------------------------------------------------------------------------------

_LOOSE, _STRICT = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[A-Z0-9]{3,20}")


def normalize_symbol(text: str) -> str:
    plain = text.strip().replace("/", "").replace("-", "")
    if not _LOOSE.fullmatch(plain) or not plain.isascii() or not _STRICT.fullmatch(plain.upper()):
        raise InvalidRequestError(f"{text!r} is not a symbol")
    return plain.upper()


def check_symbol(text: str) -> None:
    """Assert the normal form, without making it."""
    if not _STRICT.fullmatch(text):
        raise InvalidRequestError(f"{text!r} is not a normalised symbol")


@dataclass(frozen=True)
class Request:
    """Candles that open in the closed range [start, end]; without end, up to now."""

    symbol: str
    interval: Interval
    start: dt.datetime
    end: dt.datetime | None = None
    market: Market = Market.SPOT

    def validate(self) -> None:
        normalize_symbol(self.symbol)
        if not isinstance(self.interval, Interval) or self.interval not in INTERVALS:
            raise InvalidRequestError("the interval is not one of INTERVALS")
        if not isinstance(self.market, Market):
            raise InvalidRequestError("the market is not a Market")
        for name, t in (("start", self.start), ("end", self.end)):
            if name == "end" and t is None:
                continue
            if not isinstance(t, dt.datetime) or t.utcoffset() != dt.timedelta(0):
                raise InvalidRequestError(f"{name} must be an instant in UTC")
        if self.end is not None and self.end < self.start:
            raise InvalidRequestError("end is before start")

    def resolve(self, now: dt.datetime) -> Request:
        """Normal symbol and a definite end; a range that has yet to begin is the caller's mistake."""
        self.validate()
        end = self.end if self.end is not None else now
        if end < self.start:
            raise InvalidRequestError("start is in the future")
        return replace(self, symbol=normalize_symbol(self.symbol), end=end)

    @property
    def end_exclusive(self) -> dt.datetime:
        """Data has no instants between microseconds."""
        return self.end + MICRO
