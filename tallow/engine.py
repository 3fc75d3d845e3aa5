"""CandleEngine: requests to DataFrames, and the store's upkeep."""

from __future__ import annotations

import datetime as dt
import logging
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallow.model import CANDLE_SCHEMA, COLUMNS, Chunk, Interval, InvalidRequestError, Kind, Market, NotAvailableError, Request, instant, micros_of, month_start, next_month, normalize_symbol
from tallow.operators import series
from tallow.plans import planner
from tallow.sources import archive, listing, rest, store
from tallow.sources.http import Limiter, Policy, Transport, get, save

CONCURRENCY = 8


@dataclass(frozen=True)
class Progress:
    """A chunk is ready: its place among all, source and candles within the request."""

    done: int
    total: int
    chunk: Chunk
    rows: int


@dataclass(frozen=True)
class Availability:
    monthly: list[dt.datetime]
    daily: list[dt.datetime]
    through: dt.datetime | None
    monthly_gaps: list[dt.datetime] = field(default_factory=list)
    daily_gaps: list[dt.datetime] = field(default_factory=list)


@dataclass(frozen=True)
class Upstream:
    """Transports of archives (by key), listings and the live source (by query)."""

    archives: Transport
    listings: Transport
    live: Transport


class CandleEngine:
    """Candles of any range as one sorted DataFrame without duplicates; a span that should hold candles and does not is an error.

    cache_dir is a folder shared by the driver and all executors.
    """

    def __init__(
        self, spark: SparkSession, cache_dir: str, upstream: Upstream, concurrency: int = CONCURRENCY, limiter: Limiter | None = None, policy: Policy | None = None,
        progress: Callable[[Progress], None] | None = None, logger: logging.Logger | None = None, clock: Callable[[], dt.datetime] | None = None,
    ):
        if not cache_dir or concurrency < 1:
            raise InvalidRequestError("cache_dir must be given and concurrency at least 1")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
        self.spark, self.root, self.upstream, self.concurrency = spark, str(cache_dir), upstream, concurrency
        self.policy = policy or Policy()
        self.client = rest.RestClient(upstream.live, self.policy, limiter or Limiter())
        self.progress, self.log = progress, logger or logging.getLogger("tallow")
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC))

    # -- planning

    def plan(self, request: Request, now: dt.datetime) -> list[Chunk]:
        """Chunks of a resolved request by what is published."""
        since = month_start(request.start)
        index = listing.published(self.spark, self.upstream.listings, request.symbol, request.interval, since, self.policy, request.market.value)
        rows = index.collect()  # one row per period of a symbol
        have = {(Kind(r.agg), r.period.replace(tzinfo=dt.UTC)) for r in rows}
        ends = [next_month(t) if k is Kind.MONTHLY else t + planner.ONE_DAY for k, t in have]
        chunks = planner.expand(request.start, request.end_exclusive, max(ends, default=None), request.interval)
        return planner.route(chunks, lambda k, t: (k, t) in have, request.interval.daily)

    def _built(self, request: Request, chunks: list[Chunk]) -> dict[Chunk, int | None]:
        """Candles within the request of each archive chunk, files being made where needed; None where upstream has none."""
        if not chunks:
            return {}
        root, symbol, interval, transport, policy = self.root, request.symbol, request.interval, self.upstream.archives, self.policy
        low, high, market = request.start, request.end, request.market.value

        def run(parts):
            import pyarrow.compute as pc
            import pyarrow.parquet as pq

            for part in parts:
                for kind, a, b in zip(*(part.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
                    start, end = instant(a), instant(b)
                    e = store.entry(root, symbol, interval, Kind(kind), start, market)
                    try:
                        key, spec = store.key_of(symbol, interval, Kind(kind), start, market), archive.Spec(interval, start, end)
                        n = store.build(e, key, spec, lambda k: get(transport, k, policy), lambda k, f: save(transport, k, f, policy))
                        if start < low or end > high:
                            t = pq.read_table(e.parquet, columns=["open_time"]).column(0)
                            n = pc.sum(pc.and_(pc.greater_equal(t, pa.scalar(low, t.type)), pc.less_equal(t, pa.scalar(high, t.type)))).as_py() or 0
                    except NotAvailableError:
                        n = None
                    yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([a]), pa.array([b]), pa.array([n], pa.int64())], ["kind", "a", "b", "n"])

        schema = "kind string, a long, b long"
        rows = self.spark.createDataFrame([(c.kind.value, micros_of(c.start), micros_of(c.end)) for c in chunks], schema)
        got = rows.repartition(min(self.concurrency, len(chunks))).mapInArrow(run, schema + ", n long").collect()
        return {Chunk(instant(r.a), instant(r.b), Kind(r.kind)): r.n for r in got}

    # -- reading

    def fetch(self, request: Request, now: dt.datetime | None = None) -> DataFrame:
        """The request's candles. Archives are made ready before it returns; the rows themselves are read lazily."""
        now = now or self.clock()
        request = request.resolve(now)
        return self._assembled(request, self.plan(request, now), now)[0]

    def _assembled(self, request: Request, chunks: list[Chunk], now: dt.datetime, before: int = 0, after: int = 0) -> tuple[DataFrame, int]:
        """The candles of some of a request's chunks, and how many chunks they are in the end; before and after are numbers of other chunks."""
        waiting, ready, live = chunks, {}, []
        while archives := [c for c in waiting if c.kind is not Kind.REST]:
            live += [c for c in waiting if c.kind is Kind.REST]
            built = self._built(request, archives)
            ready |= {c: n for c, n in built.items() if n is not None}
            waiting = planner.coalesce(sorted(s for c, n in built.items() if n is None for s in planner.substitute(c, request.interval.daily)))
        live = planner.coalesce(sorted(live + waiting))
        low, high = request.start, request.end_exclusive
        total = before + len(ready) + len(live) + after
        for i, (c, n) in enumerate(sorted(ready.items()), 1):
            self._check(request, c, n, now)
            if self.progress:
                self.progress(Progress(before + i, total, c, n))
        parts = []
        if ready:
            places = {str(store.entry(self.root, request.symbol, request.interval, c.kind, c.start, request.market.value).parquet): i for i, c in enumerate(sorted([*ready, *live])) if c in ready}
            order = self.spark.createDataFrame([(p.rsplit("/", 1)[-1], i) for p, i in places.items()], "file string, chunk_ord int")
            # one row per file of the plan
            own = store.read(self.spark, list(places)).withColumn("file", F.col("_metadata.file_name"))
            parts.append(series.trim(own, request.start, request.end).join(F.broadcast(order), "file").select(*COLUMNS, "chunk_ord"))
        if live:
            spans = [(max(c.start, low), min(c.end, high)) for c in live]
            at = {i: sorted([*ready, *live]).index(c) for i, c in enumerate(live)}
            rows = rest.scan(self.spark, self.client, request.symbol, request.interval, spans, now)
            rows, counts = self._checked(rows, spans, request, now)
            for i, c in enumerate(live):
                if self.progress:
                    self.progress(Progress(before + len(ready) + i + 1, total, c, counts.get(i, 0)))
            places = F.element_at(F.create_map(*[F.lit(x) for kv in at.items() for x in kv]), F.col("span"))
            parts.append(rows.select(*COLUMNS, places.cast("int").alias("chunk_ord")))
        df = reduce(DataFrame.unionByName, parts)
        spans = sorted([*ready, *live])
        if any(a.end > b.start for a, b in zip(spans, spans[1:], strict=False)):
            # chunks that overlap: keep what rises, in their order
            df = series.strictly_increasing(df.withColumn("request", F.lit(1)), ["request"], ["chunk_ord", "open_time"])
        # otherwise every chunk's candles rise and stay in its own span, so a distributed sort is all there is to do
        return df.select(*COLUMNS).orderBy("open_time"), len(ready) + len(live)

    def _check(self, request: Request, c: Chunk, n: int, now: dt.datetime) -> None:
        start, end = max(c.start, request.start), min(c.end, request.end_exclusive)
        if not n and planned(start, end, request.interval, now):
            raise NotAvailableError(f"{request.symbol} {request.interval}: {c} holds no candle of the request")

    def _checked(self, rows: DataFrame, spans: list, request: Request, now: dt.datetime) -> tuple[DataFrame, dict[int, int]]:
        """Live rows and their number by span, after an error for a span that should have some and has none.

        They are written below the store first: the source is asked once, and a lost executor doesn't ask it again.
        """
        path = f"{Path(self.root).resolve()}/.live/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        rows = self.spark.read.schema(rows.schema).parquet(path)
        counts = {r.span: r["count"] for r in rows.groupBy("span").count().collect()}
        for i, (a, b) in enumerate(spans):
            if not counts.get(i) and planned(a, b, request.interval, now):
                raise NotAvailableError(f"{request.symbol} {request.interval}: no live candle in [{a}, {b})")
        return rows, counts

    def fetch_all(self, requests: list[Request]) -> dict[Request, DataFrame]:
        """All or nothing, with one reading of the clock."""
        now = self.clock()
        for r in requests:
            r.validate()
        return {r: self.fetch(r, now) for r in dict.fromkeys(requests)}

    def stream(self, request: Request) -> Iterator[Row]:
        """Rows in order, one partition in memory at a time.

        Chunks are made ready `concurrency` at a time, the next ones while the rows of these are read, and none
        beyond: a consumer that stops leaves the rest undone. An error comes behind the rows before it.
        """
        now = self.clock()
        request = request.resolve(now)
        return self._streamed(request, now)

    def _streamed(self, request: Request, now: dt.datetime) -> Iterator[Row]:
        chunks = sorted(self.plan(request, now))
        groups = [chunks[i : i + self.concurrency] for i in range(0, len(chunks), self.concurrency)]
        done, left, last = 0, len(chunks), None
        pool = ThreadPoolExecutor(1, "tallow-ahead")

        def ahead(group: list[Chunk]):
            nonlocal left
            left -= len(group)
            return pool.submit(self._assembled, request, group, now, done, left)

        try:
            coming = ahead(groups[0]) if groups else None
            for following in [*groups[1:], None]:
                if coming is None:
                    return
                rows, n = coming.result()
                done += n
                coming = ahead(following) if following else None
                for row in rows.toLocalIterator(prefetchPartitions=True):
                    if last is None or row.open_time > last:  # a chunk may overlap the group before
                        last = row.open_time
                        yield row
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    # -- catalog

    def available(self, symbol: str, interval: Interval, since: dt.datetime | None = None, market: Market = Market.SPOT) -> Availability:
        """What is published; with `since`, listings start at the month and day that hold it."""
        symbol = normalize_symbol(symbol)
        if since is not None and since.utcoffset() != dt.timedelta(0):
            raise InvalidRequestError("since must be in UTC")
        index = listing.published(self.spark, self.upstream.listings, symbol, interval, since, self.policy, market.value).cache()

        def periods(df: DataFrame) -> list[dt.datetime]:
            return [r.period.replace(tzinfo=dt.UTC) for r in df.orderBy("period").collect()]

        month, day = index.where("agg = 'monthly'"), index.where("agg = 'daily'")
        through = series.frontier(index, []).first().through
        out = Availability(
            periods(month), periods(day), through.replace(tzinfo=dt.UTC) if through else None,
            periods(series.interior_gaps(month, "1 MONTH", ["agg"])), periods(series.interior_gaps(day, "1 DAY", ["agg"])),
        )
        index.unpersist()
        return out

    def verify_cache(self) -> DataFrame:
        return store.verify(self.spark, self.root)

    def remove_failed(self) -> list[store.Removal]:
        return store.remove_failed(self.spark, self.root)

    def cache_usage(self) -> DataFrame:
        return store.usage(self.spark, self.root)

    def prune_archives(self, dry_run: bool = False) -> list[store.Removal]:
        return store.prune(self.spark, self.root, dry_run)

    def evict_cache(self, **selectors) -> list[store.Removal]:
        return store.evict(self.spark, self.root, **selectors)


def planned(start: dt.datetime, end: dt.datetime, interval: Interval, now: dt.datetime) -> bool:
    """Whether a candle could open in [start, end) and be over by now."""
    first = interval.align_up(start)
    return first < end and interval.end(first) <= now


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CANDLE_SCHEMA)
