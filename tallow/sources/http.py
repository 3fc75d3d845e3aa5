"""Requests with retries, pacing and typed failures. Transports are injected, so nothing here names a host."""

from __future__ import annotations

import email.utils
import hashlib
import random
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from tallow.model import BannedError, NotAvailableError, RateLimitedError, TallowError

RETRY_AFTER_CAP = 30.0


@dataclass
class Response:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)
    #: The body piece by piece, instead of `body`.
    parts: Iterable[bytes] | None = None

    def header(self, name: str) -> str | None:
        return {k.lower(): v for k, v in self.headers.items()}.get(name)


class _Cut(Exception):
    """A body that broke off."""


def _body(r: Response) -> Iterator[bytes]:
    """The body's pieces; a connection that breaks, or a length that isn't the declared one, is a _Cut."""
    n, declared = 0, r.header("content-length")
    try:
        for part in (r.body,) if r.parts is None else r.parts:
            n += len(part)
            yield part
    except OSError as e:
        raise _Cut(str(e)) from e
    if declared and declared.strip().isdigit() and not r.header("content-encoding") and n != int(declared):
        raise _Cut(f"{n} bytes of {declared.strip()}")


#: Takes a key or query and answers; raises OSError where the connection fails.
Transport = Callable[[str], Response]


@dataclass(frozen=True)
class Policy:
    """How often and how long to wait: full jitter under a doubling bound."""

    attempts: int = 4
    base: float = 0.5
    cap: float = 8.0

    def bound(self, attempt: int) -> float:
        return min(self.base * 2 ** (attempt - 1), self.cap)

    def backoff(self, attempt: int, rng: random.Random) -> float:
        return rng.uniform(0, self.bound(attempt))


def retry_after(header: str | None, now: float) -> float | None:
    """Seconds from a Retry-After header: a number or a date, a past date being none to wait."""
    if not header:
        return None
    if header.strip().isdigit():
        return float(header.strip())
    try:
        at = email.utils.parsedate_to_datetime(header)
    except (TypeError, ValueError):
        return None
    return max(0.0, at.timestamp() - now)


class Limiter:
    """A token bucket; every attempt pays, retries too."""

    def __init__(self, rate: float = 40.0, burst: float = 20.0, clock=time.monotonic, sleep=time.sleep):
        if rate <= 0 or burst <= 0:
            raise ValueError("rate and burst must be positive")
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = burst, clock()
        self.lock = threading.Lock()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lock"}

    def __setstate__(self, state):
        self.__dict__.update(state, lock=threading.Lock())

    def take(self, weight: float = 2.0) -> None:
        with self.lock:
            now = self.clock()
            self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
            self.at = now
            self.tokens -= weight
            wait = -self.tokens / self.rate
        if wait > 0:
            self.sleep(wait)


def get(transport: Transport, what: str, policy: Policy = Policy(), limiter: Limiter | None = None, sleep=time.sleep, clock=time.time, rng: random.Random | None = None) -> bytes:
    """The body, after retries of 429, 5xx and broken connections; 418 is final at once."""
    return _ask(transport, what, lambda r: b"".join(_body(r)), policy, limiter, sleep, clock, rng)


def save(transport: Transport, what: str, f: BinaryIO, policy: Policy = Policy(), **options) -> str:
    """Write the body to a seekable file as it arrives; its SHA-256. Every try starts the file anew."""
    start = f.tell()

    def take(r: Response) -> str:
        f.seek(start)
        f.truncate()
        sha = hashlib.sha256()
        for part in _body(r):
            sha.update(part)
            f.write(part)
        return sha.hexdigest()

    return _ask(transport, what, take, policy, **options)


def _ask[T](transport: Transport, what: str, take: Callable[[Response], T], policy: Policy, limiter: Limiter | None = None, sleep=time.sleep, clock=time.time, rng: random.Random | None = None) -> T:
    rng = rng or random.Random()
    for attempt in range(1, policy.attempts + 1):
        if limiter:
            limiter.take()
        last = attempt == policy.attempts
        try:
            r = transport(what)
        except OSError as e:
            broken = e
        else:
            broken = None
            if r.status == 200:
                try:
                    return take(r)
                except _Cut as e:
                    broken = e
        if broken is not None:
            if last:
                raise TallowError(f"{what}: {broken}") from broken
            sleep(policy.backoff(attempt, rng))
            continue
        if r.status == 404:
            raise NotAvailableError(f"{what}: not found")
        if r.status == 418:
            raise BannedError(f"{what}: refused (418)")
        if r.status != 429 and r.status < 500:
            raise TallowError(f"{what}: status {r.status}: {r.body[:200]!r}")
        if last:
            raise RateLimitedError(f"{what}: still 429 after {attempt} attempts") if r.status == 429 else TallowError(f"{what}: status {r.status}")
        asked = retry_after(r.header("retry-after"), clock())
        sleep(max(policy.backoff(attempt, rng), min(asked or 0.0, RETRY_AFTER_CAP)))
    raise AssertionError("unreachable")


#: How often, and between which bounds in seconds, the whole source is left alone after a 429 that retries did not clear.
PAUSES, PAUSE_LEAST, PAUSE_MOST = 2, 1.0, 60.0


def get_patiently(transport: Transport, what: str, policy: Policy = Policy(), limiter: Limiter | None = None, pause: float = 10.0, sleep=time.sleep, **options) -> bytes:
    """get, with a long pause and another try where the source stays busy; a ban is never retried."""
    for left in range(PAUSES, -1, -1):
        try:
            return get(transport, what, policy, limiter, sleep=sleep, **options)
        except BannedError:
            raise
        except RateLimitedError:
            if not left:
                raise
            sleep(min(PAUSE_MOST, max(PAUSE_LEAST, pause)))
    raise AssertionError("unreachable")
