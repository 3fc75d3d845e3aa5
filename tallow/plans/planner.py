"""Which archives and which live ranges cover a request. Pure, on the driver: plans are small."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from itertools import groupby

from tallow.model import Chunk, CoverageGapError, InvalidRequestError, Interval, Kind, day_start, month_start, next_month

ONE_DAY = dt.timedelta(days=1)


def check_coverage(chunks: list[Chunk], start: dt.datetime, end: dt.datetime) -> None:
    """No hole, no overlap, nothing of [start, end) left out."""
    if not chunks or chunks[0].start > start or chunks[-1].end < end:
        raise CoverageGapError(f"the plan does not cover [{start}, {end})")
    for a, b in zip(chunks, chunks[1:], strict=False):
        if a.end != b.start:
            raise CoverageGapError(f"{a} is not followed by {b}")


def expand(start: dt.datetime, end: dt.datetime, through: dt.datetime | None, interval: Interval) -> list[Chunk]:
    """Chunks over [start, end): whole months, else days, up to `through`, and one live range behind it."""
    for name, t in (("start", start), ("end", end), ("through", through)):
        if t is not None and t.utcoffset() != dt.timedelta(0):
            raise InvalidRequestError(f"{name} must be in UTC")
    if start >= end:
        raise InvalidRequestError("start must be before end")
    if through is not None and through != day_start(through):
        raise InvalidRequestError("through must be a midnight")
    out: list[Chunk] = []
    edge = min(end, through) if through is not None else start
    at = start
    while at < edge:
        first = month_start(at)
        after = next_month(first)
        if not interval.daily or (at == first and after <= edge):
            out.append(Chunk(first, after, Kind.MONTHLY))
        else:
            day = day_start(at)
            while day < min(after, edge):
                out.append(Chunk(day, day + ONE_DAY, Kind.DAILY))
                day += ONE_DAY
        at = out[-1].end
    if at < end:
        out.append(Chunk(at, end, Kind.REST))
    check_coverage(out, start, end)
    return out


def consolidate(chunks: list[Chunk], month_exists: Callable[[dt.datetime], bool] | None) -> list[Chunk]:
    """An unbroken run of days that is half a published month or more becomes that month."""
    if month_exists is None:
        return list(chunks)
    out: list[Chunk] = []
    for (kind, first), group in groupby(chunks, key=lambda c: (c.kind, month_start(c.start))):
        own = list(group)
        after = next_month(first)
        unbroken = all(a.end == b.start for a, b in zip(own, own[1:], strict=False))
        if kind is Kind.DAILY and unbroken and len(own) * 2 >= (after - first).days and month_exists(first):
            out.append(Chunk(first, after, Kind.MONTHLY))
        else:
            out += own
    return out


def substitute(chunk: Chunk, daily: bool) -> list[Chunk]:
    """What to try where a chunk's source is missing: a month's days, then the live source, then nothing."""
    if chunk.kind is Kind.REST:
        raise CoverageGapError(f"no source is left for {chunk}")
    if chunk.kind is Kind.MONTHLY and daily:
        n = (chunk.end - chunk.start).days
        return [Chunk(chunk.start + k * ONE_DAY, chunk.start + (k + 1) * ONE_DAY, Kind.DAILY) for k in range(n)]
    return [Chunk(chunk.start, chunk.end, Kind.REST)]


def coalesce(chunks: list[Chunk]) -> list[Chunk]:
    """Live ranges that touch become one."""
    out: list[Chunk] = []
    for c in chunks:
        if out and c.kind is out[-1].kind is Kind.REST and out[-1].end == c.start:
            out[-1] = Chunk(out[-1].start, c.end, Kind.REST)
        else:
            out.append(c)
    return out


def route(chunks: list[Chunk], has: Callable[[Kind, dt.datetime], bool], daily: bool) -> list[Chunk]:
    """Chunks by what is published: consolidated, missing ones replaced, live ranges joined."""

    def one(c: Chunk) -> list[Chunk]:
        if c.kind is Kind.REST or has(c.kind, c.start):
            return [c]
        return [x for s in substitute(c, daily) for x in one(s)]

    return coalesce([x for c in consolidate(chunks, lambda t: has(Kind.MONTHLY, t)) for x in one(c)])
