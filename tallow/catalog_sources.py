"""Registered queries for sources, sinks, the store and requests, on fixtures made from the tables, and their SQL.

Archives, pages and listings are made of the candles of `events`, go through the operator, and must come back as the
candles that SQL computes.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import json
import tempfile
import uuid
import zipfile
from urllib.parse import parse_qs

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow import catalog
from tallow.catalog import END, HOUR, START, _candles, _events, _files, _plain, query
from tallow.functions import grid, text
from tallow.model import CANDLE_SCHEMA, COLUMNS, UTC, InvalidRequestError, Kind, Request, instant, micros_of, parse_end, parse_start
from tallow.operators import inventory, series, validate
from tallow.sources import archive, listing, rest, store
from tallow.sources.http import Response

_CANDLE = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CANDLE_SCHEMA)
_NUMBERS = ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume")
_UPPER = "SELECT upper(symbol) AS symbol, * EXCLUDE (symbol) FROM ({candles})"


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir; a temporary one where nothing is set, as in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="tallow-")
    base = base.removeprefix("file:").rstrip("/")
    return f"{'/' + base.lstrip('/')}/tallow-store-{uuid.uuid4().hex}"


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, start (a month's first instant) and body: the month's candles as lines of an archive."""
    fields = {c: text.plain(F.col(c)) for c in _NUMBERS}
    wire = [grid.micros(F.col("open_time")), *(fields[c] for c in _NUMBERS[:5]), grid.micros(F.col("close_time")), fields["quote_volume"], F.col("trades"), fields["taker_buy_base_volume"], fields["taker_buy_quote_volume"], F.lit("0")]
    lines = _candles(spark, sf_dir).select(F.upper("symbol").alias("symbol"), grid.month_start(F.col("open_time")).alias("start"), "open_time", F.concat_ws(",", *[w.cast("string") for w in wire]).alias("line"))
    # a month has 744 hours at most
    return lines.groupBy("symbol", "start").agg(F.expr("array_join(transform(array_sort(collect_list(struct(open_time, line))), x -> x.line), '\n')").alias("body")).select("symbol", grid.micros(F.col("start")).alias("start"), "body")


def _zip(name: str, body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(f"{name}.csv"), body)
    return out.getvalue()


def _month_end(start: dt.datetime) -> dt.datetime:
    return (start.replace(day=28) + dt.timedelta(days=4)).replace(day=1)


@query(_UPPER)
def archive_decode(spark, sf_dir):
    """Candles written as monthly ZIP archives, every second one with a header line, and decoded."""

    def run(batches):
        for batch in batches:
            for symbol, start, body in zip(*(batch.column(c).to_pylist() for c in ("symbol", "start", "body")), strict=True):
                first = instant(start)
                header = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore\n" if len(symbol) % 2 else ""
                for b in archive.decode_batches(_zip(f"{symbol}-1h", header + body), archive.Spec(HOUR, first, _month_end(first))):
                    yield pa.RecordBatch.from_arrays([pa.array([symbol] * b.num_rows), *b.columns], ["symbol", *b.schema.names])

    return _plain(_bodies(spark, sf_dir).mapInArrow(run, f"symbol string, {_CANDLE}"))


@query(_UPPER)
def store_round_trip(spark, sf_dir):
    """Archives and sidecars fetched into a store, decoded to stamped Parquet, passed by the gate and read back."""
    root = _folder(spark)

    def run(batches):
        for batch in batches:
            for symbol, start, body in zip(*(batch.column(c).to_pylist() for c in ("symbol", "start", "body")), strict=True):
                first = instant(start)
                e = store.entry(root, symbol, HOUR, Kind.MONTHLY, first)
                key = store.key_of(symbol, HOUR, Kind.MONTHLY, first)
                content = _zip(e.stem, body)
                sidecar = store.format_checksum(hashlib.sha256(content).hexdigest(), e.zip.name).encode()
                spec = archive.Spec(HOUR, first, _month_end(first))
                n = store.build(e, key, spec, lambda k, own=content, other=sidecar: other if k.endswith(".CHECKSUM") else own)

                def nothing(key: str) -> bytes:
                    raise AssertionError(f"a hit asks for {key}")

                if store.build(e, key, spec, nothing) != n:
                    raise AssertionError("a hit has another number of rows")
                yield pa.RecordBatch.from_arrays([pa.array([str(e.parquet)])], ["path"])

    paths = [r.path for r in _bodies(spark, sf_dir).mapInArrow(run, "path string").collect()]  # one for each symbol and month
    if not paths:
        return _plain(spark.createDataFrame([], f"symbol string, {_CANDLE}"))
    own = store.read(spark, paths)
    return _plain(own.select(F.regexp_extract(F.col("_metadata.file_name"), "^([A-Z0-9]+)-", 1).alias("symbol"), *COLUMNS))


@query("SELECT * FROM ({candles}) WHERE symbol = 'view' AND open_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 11:00:00'")
def live_pages(spark, sf_dir):
    """One symbol's candles of a closed range, served in JSON pages of 50 and read by the live scan."""
    rows = series.trim(_candles(spark, sf_dir).where("symbol = 'view'"), START, END).withColumns({c: text.plain(F.col(c)) for c in _NUMBERS})
    served = sorted((micros_of(r.open_time.replace(tzinfo=UTC)), micros_of(r.close_time.replace(tzinfo=UTC)), *(r[c] for c in _NUMBERS), r.trades) for r in rows.collect())

    def transport(what: str) -> Response:
        q = {k: v[0] for k, v in parse_qs(what[1:]).items()}
        low, high = int(q["startTime"]) * 1000, int(q["endTime"]) * 1000
        found = [r for r in served if low <= r[0] <= high][: int(q["limit"])]
        return Response(200, json.dumps([[str(r[0]), *r[2:7], str(r[1]), r[7], r[10], r[8], r[9], "0"] for r in found]).encode())

    cut = dt.datetime(2024, 1, 9, tzinfo=UTC)
    spans = [(START, cut), (cut, END + dt.timedelta(hours=1))]
    got = rest.scan(spark, rest.RestClient(transport, page=50), "VIEW", HOUR, spans, dt.datetime(2025, 1, 1, tzinfo=UTC))
    return _plain(got.select(F.lit("view").alias("symbol"), *COLUMNS))


@query(f"SELECT agg, period FROM ({catalog._INDEX}) WHERE symbol = 'click'")
def bucket_listing(spark, sf_dir):
    """The published archives of one symbol, listed in XML pages of seven keys, sidecars and foreign names among them."""
    own = catalog._index(spark, sf_dir).where("symbol = 'click'").collect()  # a row for each day and month
    keys = []
    for r in own:
        kind = Kind(r.agg)
        key = listing.archive_prefix("CLICK", HOUR, kind) + listing.archive_stem("CLICK", HOUR, kind, r.period) + ".zip"
        keys += [key, key + ".CHECKSUM", key.replace(".zip", ".txt")]
    keys.sort()

    def transport(what: str) -> Response:
        q = {k: v[0] for k, v in parse_qs(what[1:]).items()}
        left = [k for k in keys if k.startswith(q["prefix"]) and k > q.get("marker", "")]
        items = "".join(f"<Contents><Key>{k}</Key><Size>{len(k)}</Size></Contents>" for k in left[:7])
        return Response(200, f"<ListBucketResult><IsTruncated>{str(len(left) > 7).lower()}</IsTruncated>{items}</ListBucketResult>".encode())

    return _plain(listing.published(spark, transport, "CLICK", HOUR))


@query("""WITH t AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+01:00' WHEN 3 THEN strftime(ts, '%Y-13-%d') ELSE strftime(ts, '%d.%m.%Y') END AS text FROM events)
SELECT event_id, text, CASE event_id % 5 WHEN 0 THEN epoch_us(date_trunc('day', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) WHEN 2 THEN epoch_us(ts) - 3600000000 END AS starts,
  CASE event_id % 5 WHEN 0 THEN epoch_us(date_trunc('day', ts)) + 86400000000 - 1 WHEN 1 THEN epoch_us(date_trunc('second', ts)) WHEN 2 THEN epoch_us(ts) - 3600000000 END AS ends FROM t""")
def parse_instants(spark, sf_dir):
    """Dates and instants as a user writes them; a date as an end is its last microsecond."""
    i, t = F.col("event_id") % 5, F.col("ts")
    spelled = (
        F.when(i == 0, F.date_format(t, "yyyy-MM-dd")).when(i == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+01:00'"))
        .when(i == 3, F.date_format(t, "yyyy-'13'-dd")).otherwise(F.date_format(t, "dd.MM.yyyy"))
    )

    def run(batches):
        def parsed(parse, value):
            try:
                return micros_of(parse(value))
            except InvalidRequestError:
                return None

        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("text"), *(pa.array([parsed(f, v) for v in texts], pa.int64()) for f in (parse_start, parse_end))], ["event_id", "text", "starts", "ends"])

    return _events(spark, sf_dir).select("event_id", spelled.alias("text")).mapInArrow(run, "event_id long, text string, starts long, ends long")


@query("""WITH n AS (SELECT TIMESTAMP '2024-01-20 10:30:00' AS now)
SELECT event_id, CASE WHEN event_id % 5 = 1 OR event_id % 5 = 2 OR (event_id % 5 = 4 AND ts > now) THEN 'refused' ELSE upper(event_type) || 'USDT' END AS symbol,
  CASE WHEN event_id % 5 = 1 OR event_id % 5 = 2 OR (event_id % 5 = 4 AND ts > now) THEN NULL WHEN event_id % 5 = 4 THEN epoch_us(now) ELSE epoch_us(ts) + 1 END AS end_exclusive
FROM events, n""".replace("ELSE epoch_us(ts) + 1 END", "ELSE epoch_us(ts) END + 1"))
def request_rules(spark, sf_dir):
    """Requests checked and resolved at a fixed instant: bad symbols, ends before starts and starts to come are refused."""
    now = dt.datetime(2024, 1, 20, 10, 30, tzinfo=UTC)

    def run(batches):
        for batch in batches:
            out = []
            for i, name, us in zip(*(batch.column(c).to_pylist() for c in ("event_id", "event_type", "us")), strict=True):
                start = instant(us)
                end = {2: start - dt.timedelta(microseconds=1), 4: None}.get(i % 5, start)
                try:
                    r = Request("x" if i % 5 == 1 else f" {name}/usdt", HOUR, start, end).resolve(now)
                    out.append((i, r.symbol, micros_of(r.end_exclusive)))
                except InvalidRequestError:
                    out.append((i, "refused", None))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], ["event_id", "symbol", "end_exclusive"])

    return _events(spark, sf_dir).select("event_id", "event_type", grid.micros(F.col("ts")).alias("us")).mapInArrow(run, "event_id long, symbol string, end_exclusive long")


@query(f"""WITH f AS (SELECT path, length, regexp_replace(path, '(\\.zip\\.CHECKSUM|\\.zip|\\.parquet)$', '') AS stem FROM ({catalog._FILES}) WHERE NOT regexp_matches(path, '[369]\\.parquet$') AND NOT regexp_matches(path, '[05]\\.zip\\.CHECKSUM$'))
SELECT path, length FROM f WHERE path LIKE '%.zip' AND EXISTS (SELECT 1 FROM f g WHERE g.path = f.stem || '.parquet') AND EXISTS (SELECT 1 FROM f g WHERE g.path = f.stem || '.zip.CHECKSUM')""")
def prunable_archives(spark, sf_dir):
    files = _files(spark, sf_dir).where(~F.col("path").rlike(r"[369]\.parquet$") & ~F.col("path").rlike(r"[05]\.zip\.CHECKSUM$"))
    return inventory.prunable(files)


@query("SELECT * FROM (VALUES ('itself', true), ('another order', true), ('one row more', false), ('one row less', false), ('another close', false)) t(against, equal)")
def same_rows(spark, sf_dir):
    own = _candles(spark, sf_dir).select(*COLUMNS)
    first = own.orderBy("open_time", "close", "trades").limit(1)
    others = {
        "itself": own, "another order": own.orderBy(F.desc("open_time")), "one row more": own.unionByName(first), "one row less": own.exceptAll(first),
        "another close": own.withColumn("close", F.when(F.col("open_time") == own.agg(F.min("open_time")).first()[0], F.col("close") + 1).otherwise(F.col("close")).cast(text.NUMBER)),
    }
    return spark.createDataFrame([(name, series.same_rows(own, other)) for name, other in others.items()], "against string, equal boolean")


@query(f"""WITH b AS ({catalog._BROKEN}), r AS (SELECT symbol, CASE WHEN open_time < TIMESTAMP '2024-01-05 00:00:00' OR open_time >= TIMESTAMP '2024-01-12 11:00:00' THEN 'outside its period'
  WHEN low > high THEN 'low above high' WHEN low > least(open, close) THEN 'low above open or close' WHEN high < greatest(open, close) THEN 'high below open or close' WHEN low < 0 THEN 'negative price'
  WHEN least(volume, quote_volume, taker_buy_base_volume, taker_buy_quote_volume) < 0 THEN 'negative volume' WHEN taker_buy_base_volume > volume THEN 'taker base above volume'
  WHEN taker_buy_quote_volume > quote_volume THEN 'taker quote above quote volume' WHEN trades < 0 THEN 'negative trades' ELSE 'good' END AS reason FROM b)
SELECT symbol, reason, count(*) AS n FROM r GROUP BY ALL""")
def quarantine_split(spark, sf_dir):
    good, bad = validate.quarantine(catalog._broken(spark, sf_dir), HOUR, START, END)
    return good.select("symbol", F.lit("good").alias("reason")).unionByName(bad.select("symbol", "reason")).groupBy("symbol", "reason").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT event_id, (event_id * event_id * 37 + event_id % 3 * 64)::BIGINT * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4096 WHEN 2 THEN 1 ELSE 262144 END AS n FROM events)
SELECT event_id, CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE)
  WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', n / 1099511627776.0::DOUBLE) END AS size FROM s""")
def human_bytes(spark, sf_dir):
    i, wide = F.col("event_id"), F.col("event_id").cast("decimal(38,0)")
    # decimals: from event 975,159 on these sizes pass 64 bits, where the SQL stops with an error
    n = (wide * wide * 37 + i % 3 * 64) * F.when(i % 4 == 1, 4096).when(i % 4 == 3, 262144).otherwise(1)
    return _events(spark, sf_dir).select("event_id", text.human_bytes(n).alias("size"))


@query(f"""WITH {catalog._EXPANDED} SELECT request_id, start, "end", ((epoch_us("end") - epoch_us(start)) // 3600000000)::BIGINT AS estimate FROM chunks WHERE kind <> 'rest'""")
def row_estimate(spark, sf_dir):
    from tallow.plans import relational

    def run(batches):
        for batch in batches:
            spans = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("request_id", "a", "b")), pa.array([archive.Spec(HOUR, instant(a), instant(b)).estimated_rows() for a, b in spans], pa.int64())], ["request_id", "a", "b", "estimate"])

    chunks = relational.expand(catalog._requests(spark, sf_dir)).where("kind <> 'rest'")
    found = chunks.select("request_id", grid.micros(F.col("start")).alias("a"), grid.micros(F.col("end")).alias("b")).mapInArrow(run, "request_id long, a long, b long, estimate long")
    return _plain(found.select("request_id", grid.at(F.col("a")).alias("start"), grid.at(F.col("b")).alias("end"), "estimate"))
