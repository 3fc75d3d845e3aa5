"""The live source: candles by pages, only those that are over."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallow.model import CANDLE_SCHEMA, WIRE, CorruptArchiveError, Interval, InvalidRequestError, NotAvailableError, TallowError, micros_of
from tallow.sources.archive import Spec, batches, decode_row
from tallow.sources.http import Limiter, Policy, Transport, get_patiently

PAGE, MAX_PAGES, BODY_BYTES = 1000, 1000, 4 << 20


def decode_page(body: bytes) -> list[list[str]]:
    """Rows of twelve texts; numbers keep the digits they came with."""
    if len(body) > BODY_BYTES:
        raise TallowError("a page is too large")
    try:
        rows = json.loads(body, parse_float=str, parse_int=str, parse_constant=str)
    except ValueError as e:
        raise CorruptArchiveError(f"a page is not JSON: {e}") from None
    if not isinstance(rows, list):
        raise CorruptArchiveError("a page is not an array")
    for row in rows:
        if not isinstance(row, list) or len(row) != len(WIRE) or not all(isinstance(v, str) for v in row):
            raise CorruptArchiveError("a row is not twelve numbers or texts")
    return rows


def query_of(symbol: str, interval: Interval, start: dt.datetime, end: dt.datetime, limit: int = PAGE) -> str:
    """Milliseconds: start rounded up, the exclusive end to the last one before it."""
    first = -(-micros_of(start) // 1000)
    last = (micros_of(end) - 1) // 1000
    return "?" + urlencode({"symbol": symbol, "interval": interval.rest, "startTime": first, "endTime": last, "limit": limit})


@dataclass
class RestClient:
    transport: Transport
    policy: Policy = Policy()
    limiter: Limiter | None = None
    page: int = PAGE
    options: dict = field(default_factory=dict)

    def candles(self, symbol: str, spec: Spec, now: dt.datetime) -> Iterator[tuple]:
        """Candles that open in [spec.start, spec.end) and are over by now, in order.

        Ends at an empty or short page, at the span's end, or at the first candle in progress.
        """
        spec.validate()
        at, before = spec.start, None
        for _ in range(MAX_PAGES):
            try:
                body = get_patiently(self.transport, query_of(symbol, spec.interval, at, spec.end, self.page), self.policy, self.limiter, **self.options)
            except NotAvailableError as e:
                raise TallowError(f"the live source does not answer: {e}") from None
            rows = decode_page(body)
            for fields in rows:
                row = decode_row(fields, spec)
                if before is not None and row[0] <= before:
                    raise CorruptArchiveError(f"open_time {row[0]} does not follow {before}")
                before = row[0]
                if spec.interval.end(row[0]) > now:
                    return
                yield row
            if len(rows) < self.page:
                return
            at = spec.interval.end(before)
            if at >= spec.end:
                return
        raise TallowError(f"more than {MAX_PAGES} pages")


def scan(spark: SparkSession, client: RestClient, symbol: str, interval: Interval, spans: list[tuple[dt.datetime, dt.datetime]], now: dt.datetime, tasks: int = 1) -> DataFrame:
    """Candles of live ranges with `span` (their place in the list). One task by default: a limiter is per process."""
    if not spans:
        raise InvalidRequestError("no live range is given")
    rows = spark.createDataFrame([(i, micros_of(a), micros_of(b)) for i, (a, b) in enumerate(spans)], "span int, a long, b long").coalesce(tasks)
    schema = "span int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CANDLE_SCHEMA)

    def run(parts):
        from tallow.model import instant

        for part in parts:
            for i, a, b in zip(*(part.column(c).to_pylist() for c in ("span", "a", "b")), strict=True):
                for own in batches(client.candles(symbol, Spec(interval, instant(a), instant(b)), now)):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * own.num_rows, pa.int32()), *own.columns], ["span", *own.schema.names])

    return rows.mapInArrow(run, schema)


