"""Registered queries over the supplied tables, and their SQL equivalents.

The tables hold no candles, so hourly ones are derived from `events`: a symbol per event type, `value` as price.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.functions import grid, text
from tallow.model import INTERVALS, UTC, parse_interval
from tallow.operators import inventory, series, validate
from tallow.plans import relational

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

HOUR = parse_interval("1h")
START, END = dt.datetime(2024, 1, 5, tzinfo=UTC), dt.datetime(2024, 1, 12, 11, 0, tzinfo=UTC)

CANDLES_SQL = """
  SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS open_time,
    (date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND)::TIMESTAMP AS close_time,
    first(value::DECIMAL(38,8) ORDER BY ts, event_id) AS open, max(value::DECIMAL(38,8)) AS high,
    min(value::DECIMAL(38,8)) AS low, last(value::DECIMAL(38,8) ORDER BY ts, event_id) AS close,
    sum((user_id % 100 + 1)::DECIMAL(38,8)) AS volume, sum(value::DECIMAL(38,8)) AS quote_volume,
    sum(CASE WHEN event_id % 2 = 0 THEN user_id % 100 + 1 ELSE 0 END::DECIMAL(38,8)) AS taker_buy_base_volume,
    sum(CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END::DECIMAL(38,8)) AS taker_buy_quote_volume,
    count(*) AS trades
  FROM events GROUP BY event_type, date_trunc('hour', ts)
"""


def query(sql: str | None):
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = sql if "{candles}" not in sql else sql.replace("{candles}", CANDLES_SQL)
        return f

    return add


def queries() -> dict[str, Query]:
    from tallow import catalog_sources  # noqa: F401  (registers its own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tallow import catalog_sources  # noqa: F401

    return dict(_SQL)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("value").cast(text.NUMBER), (F.col("user_id") % 100 + 1).cast(text.NUMBER)
    order = F.struct("ts", "event_id")
    bought = F.col("event_id") % 2 == 0
    zero = F.lit(0).cast(text.NUMBER)
    out = (
        _events(spark, sf_dir).groupBy(F.col("event_type").alias("symbol"), grid.bucket(F.col("ts"), HOUR).alias("open_time"))
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
            F.sum(size).alias("volume"), F.sum(price).alias("quote_volume"), F.sum(F.when(bought, size).otherwise(zero)).alias("taker_buy_base_volume"),
            F.sum(F.when(bought, price).otherwise(zero)).alias("taker_buy_quote_volume"), F.count("*").alias("trades"),
        )
    )
    return out.withColumn("close_time", grid.interval_end(F.col("open_time"), HOUR) - F.expr("INTERVAL 1 MICROSECOND"))


def _plain(df: DataFrame) -> DataFrame:
    """Instants as zone-less timestamps, as the tables have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def _busy(per: DataFrame) -> DataFrame:
    """Periods (symbol, period, count) with at least the symbol's usual number of events; the others are holes."""
    from pyspark.sql import Window

    own = Window.partitionBy("symbol")
    return per.withColumns({"total": F.sum("count").over(own), "of": F.count("*").over(own)}).where("count * of >= total").select("symbol", "period")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with at least the usual number of events of a type, as published daily archives."""
    return _busy(_events(spark, sf_dir).groupBy(F.col("event_type").alias("symbol"), grid.day_start(F.col("ts")).alias("period")).count())


_BUSY = """SELECT symbol, period FROM (SELECT event_type AS symbol, date_trunc('{unit}', ts)::TIMESTAMP AS period, count(*) AS n,
  sum(count(*)) OVER (PARTITION BY event_type) AS total, count(*) OVER (PARTITION BY event_type) AS k FROM events GROUP BY 1, 2, event_type) WHERE n * k >= total"""
_DAYS = _BUSY.format(unit="day")


@query("SELECT * FROM ({candles})")
def candles_1h(spark, sf_dir):
    return _plain(_candles(spark, sf_dir))


@query("SELECT * FROM ({candles}) WHERE open_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 11:00:00'")
def range_trim_closed(spark, sf_dir):
    return _plain(series.trim(_candles(spark, sf_dir), START, END))


_SLICES = """
  SELECT 0 AS chunk_ord, symbol, open_time, close, trades FROM c WHERE open_time < TIMESTAMP '2024-01-12 00:00:00'
  UNION ALL SELECT 1, symbol, open_time, close + 1, trades FROM c WHERE open_time BETWEEN TIMESTAMP '2024-01-09 05:00:00' AND TIMESTAMP '2024-01-20 00:00:00'
  UNION ALL SELECT 2, symbol, open_time, close + 2, trades FROM c WHERE open_time >= TIMESTAMP '2024-01-02 00:00:00'
"""


def _slices(spark, sf_dir) -> DataFrame:
    own = _candles(spark, sf_dir).select("symbol", "open_time", "close", "trades")
    t = F.col("open_time")
    parts = [own.where(t < "2024-01-12"), own.where(t.between("2024-01-09 05:00:00", "2024-01-20")), own.where(t >= "2024-01-02")]
    return series.merge([p.withColumn("close", (F.col("close") + i).cast(text.NUMBER)) for i, p in enumerate(parts)])


@query(f"""WITH c AS ({{candles}}), s AS ({_SLICES}), w AS (
  SELECT *, max(open_time) OVER (PARTITION BY symbol ORDER BY chunk_ord, open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
SELECT symbol, open_time, close::DECIMAL(38,8) AS close, trades, chunk_ord FROM w WHERE m IS NULL OR open_time > m""")
def dedup_strict_increase(spark, sf_dir):
    return _plain(series.strictly_increasing(_slices(spark, sf_dir), ["symbol"], ["chunk_ord", "open_time"]))


@query(f"""WITH c AS ({{candles}}), s AS ({_SLICES}) SELECT symbol, open_time, close::DECIMAL(38,8) AS close, trades, chunk_ord,
  (row_number() OVER (PARTITION BY symbol ORDER BY open_time, chunk_ord))::INTEGER AS place FROM s""")
def ordered_merge(spark, sf_dir):
    from pyspark.sql import Window

    return _plain(_slices(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("open_time", "chunk_ord"))))


def _grid_queries() -> None:
    """Alignment, buckets and next opens of each interval."""
    for iv in INTERVALS:
        unit = f"((epoch_us(t) - ({iv.anchor})) % {iv.micros or 1} + {iv.micros or 1}) % {iv.micros or 1}"
        month = "date_trunc('month', t)::TIMESTAMP"
        aligned = f"t = {month}" if not iv.micros else f"{unit} = 0"
        floor = month if not iv.micros else f"make_timestamp(epoch_us(t) - {unit})"
        up = f"CASE WHEN t = {month} THEN t ELSE ({month} + INTERVAL 1 MONTH)::TIMESTAMP END" if not iv.micros else f"make_timestamp(epoch_us(t) + ({iv.micros} - {unit}) % {iv.micros})"
        end = f"({month} + INTERVAL 1 MONTH)::TIMESTAMP" if not iv.micros else f"make_timestamp(epoch_us(t) + {iv.micros})"
        source = "(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('hour', ts) WHEN event_id % 5 = 0 THEN date_trunc('day', ts) ELSE ts END::TIMESTAMP AS t FROM events)"

        def run(spark, sf_dir, iv=iv):
            ts, i = F.col("ts"), F.col("event_id")
            t = F.when(i % 3 == 0, F.date_trunc("hour", ts)).when(i % 5 == 0, F.date_trunc("day", ts)).otherwise(ts)
            own = _events(spark, sf_dir).select("event_id", t.alias("t"))
            t = F.col("t")
            return _plain(own.select("event_id", grid.is_aligned(t, iv).alias("aligned"), grid.bucket(t, iv).alias("opened"), grid.align_up(t, iv).alias("next_open"), grid.interval_end(t, iv).alias("ends")))

        run.__name__ = f"grid_{iv.name}"
        query(f"SELECT event_id, {aligned} AS aligned, {floor} AS opened, {up} AS next_open, {end} AS ends FROM {source}")(run)


_grid_queries()


def _resampled(name: str, opened: str) -> None:
    def run(spark, sf_dir):
        t = F.col("ts")
        return _plain(_events(spark, sf_dir).groupBy(F.col("event_type").alias("symbol"), grid.bucket(t, parse_interval(name)).alias("open_time")).agg(F.count("*").alias("trades"), F.max(F.col("value").cast(text.NUMBER)).alias("high")))

    run.__name__ = f"bucket_{name}"
    query(f"SELECT event_type AS symbol, {opened} AS open_time, count(*) AS trades, max(value::DECIMAL(38,8)) AS high FROM events GROUP BY ALL")(run)


_resampled("3d", "time_bucket(INTERVAL 3 DAY, ts, TIMESTAMP '1970-01-02')")
_resampled("1w", "time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05')")
_resampled("1mo", "date_trunc('month', ts)::TIMESTAMP")


@query("""WITH p AS (SELECT DISTINCT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS period FROM events),
s AS (SELECT symbol, unnest(generate_series(min(period), max(period), INTERVAL 1 HOUR))::TIMESTAMP AS period FROM p GROUP BY symbol)
SELECT symbol, period FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.symbol = s.symbol AND p.period = s.period)""")
def gaps_hourly(spark, sf_dir):
    published = _events(spark, sf_dir).select(F.col("event_type").alias("symbol"), grid.bucket(F.col("ts"), HOUR).alias("period")).distinct()
    return _plain(series.interior_gaps(published, "1 HOUR", ["symbol"]))


@query(f"""WITH p AS ({_DAYS}),
s AS (SELECT symbol, unnest(generate_series(min(period), max(period), INTERVAL 1 DAY))::TIMESTAMP AS period FROM p GROUP BY symbol)
SELECT symbol, period, NOT EXISTS (SELECT 1 FROM p WHERE p.symbol = s.symbol AND p.period = s.period) AS is_gap FROM s""")
def gaps_daily_listing(spark, sf_dir):
    return _plain(series.listing(_days(spark, sf_dir), "1 DAY", ["symbol"]))


_INDEX = f"""SELECT symbol, 'daily' AS agg, period FROM ({_DAYS})
  UNION ALL SELECT DISTINCT symbol, 'monthly', date_trunc('month', period)::TIMESTAMP FROM ({_DAYS}) WHERE symbol <> 'view'"""


def _index(spark, sf_dir) -> DataFrame:
    days = _days(spark, sf_dir)
    months = days.where("symbol <> 'view'").select("symbol", F.lit("monthly").alias("agg"), grid.month_start(F.col("period")).alias("period")).distinct()
    return days.select("symbol", F.lit("daily").alias("agg"), "period").unionByName(months)


@query(f"""SELECT symbol, max(CASE WHEN agg = 'monthly' THEN period + INTERVAL 1 MONTH ELSE period + INTERVAL 1 DAY END)::TIMESTAMP AS through
FROM ({_INDEX}) GROUP BY symbol""")
def frontier(spark, sf_dir):
    return _plain(series.frontier(_index(spark, sf_dir), ["symbol"]))


_REQUESTS = """SELECT o_orderkey AS request_id, o_orderdate::TIMESTAMP AS start,
  (o_orderdate + to_days((o_orderkey % 75 + 1)::INTEGER) + to_hours((o_orderkey % 3)::INTEGER))::TIMESTAMP AS end,
  (o_orderdate + to_days((o_orderkey % 60)::INTEGER))::TIMESTAMP AS through, o_orderkey % 4 <> 0 AS has_daily FROM orders"""


def _requests(spark, sf_dir) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("request_id"), day.alias("start"),
        (day + F.make_dt_interval((k % 75 + 1).cast("int"), (k % 3).cast("int"))).alias("end"),
        (day + F.make_dt_interval((k % 60).cast("int"))).alias("through"), (k % 4 != 0).alias("has_daily"),
    )


_EXPANDED = f"""r AS (SELECT *, least("end", through) AS edge FROM ({_REQUESTS})),
m AS (SELECT *, unnest(generate_series(date_trunc('month', start)::TIMESTAMP, date_trunc('month', edge - INTERVAL 1 MICROSECOND)::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM r WHERE start < edge),
k AS (SELECT *, (m + INTERVAL 1 MONTH)::TIMESTAMP AS m_end, NOT has_daily OR (m >= start AND m + INTERVAL 1 MONTH <= edge) AS whole FROM m),
a AS (
  SELECT request_id, 'monthly' AS kind, m AS start, m_end AS "end" FROM k WHERE whole
  UNION ALL SELECT request_id, 'daily', d, (d + INTERVAL 1 DAY)::TIMESTAMP FROM (SELECT request_id, unnest(generate_series(greatest(m, date_trunc('day', start)::TIMESTAMP), date_trunc('day', least(m_end, edge) - INTERVAL 1 MICROSECOND)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM k WHERE NOT whole)
), chunks AS (
  SELECT * FROM a UNION ALL
  SELECT r.request_id, 'rest', coalesce(x.reach, r.start), r."end" FROM r LEFT JOIN (SELECT request_id, max("end") AS reach FROM a GROUP BY 1) x USING (request_id) WHERE coalesce(x.reach, r.start) < r."end"
)"""


@query(f"WITH {_EXPANDED} SELECT request_id, kind, start, \"end\" FROM chunks")
def expand_chunks(spark, sf_dir):
    return _plain(relational.expand(_requests(spark, sf_dir)))


@query(f"""WITH {_EXPANDED}, pub AS (SELECT DISTINCT request_id, date_trunc('month', start)::TIMESTAMP AS period FROM chunks WHERE request_id % 5 <> 0),
run AS (SELECT request_id, date_trunc('month', start)::TIMESTAMP AS period, count(*) AS n, date_diff('day', min(start), max("end")) AS span FROM chunks WHERE kind = 'daily' GROUP BY 1, 2),
t AS (SELECT request_id, period FROM run SEMI JOIN pub USING (request_id, period) WHERE n = span AND n * 2 >= date_diff('day', period, period + INTERVAL 1 MONTH))
SELECT request_id, kind, start, "end" FROM chunks c WHERE kind <> 'daily' OR NOT EXISTS (SELECT 1 FROM t WHERE t.request_id = c.request_id AND t.period = date_trunc('month', c.start))
UNION ALL SELECT request_id, 'monthly', period, (period + INTERVAL 1 MONTH)::TIMESTAMP FROM t""")
def consolidate_months(spark, sf_dir):
    chunks = relational.expand(_requests(spark, sf_dir))
    published = chunks.where("request_id % 5 <> 0").select("request_id", F.date_trunc("month", "start").alias("period"))
    return _plain(relational.consolidate(chunks, published, ["request_id"]))


@query(f"""WITH p AS ({_DAYS}), o AS (
  SELECT symbol, period AS start, (period + INTERVAL 1 DAY)::TIMESTAMP AS "end", lag((period + INTERVAL 1 DAY)::TIMESTAMP) OVER (PARTITION BY symbol ORDER BY period) AS before FROM p),
i AS (SELECT *, sum(CASE WHEN before = start THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY start) AS island FROM o)
SELECT symbol, min(start) AS start, max("end") AS "end", count(*) AS n_ranges FROM i GROUP BY symbol, island""")
def coalesce_ranges(spark, sf_dir):
    days = _days(spark, sf_dir).select("symbol", F.col("period").alias("start"), (F.col("period") + F.expr("INTERVAL 1 DAY")).alias("end"))
    return _plain(series.coalesce_ranges(days, ["symbol"]))


@query(f"""WITH o AS (SELECT symbol, period AS start, (period + INTERVAL 1 DAY)::TIMESTAMP AS "end",
  lag((period + INTERVAL 1 DAY)::TIMESTAMP) OVER (PARTITION BY symbol ORDER BY period) AS before FROM ({_DAYS}))
SELECT symbol, start, "end", before FROM o WHERE before IS NOT NULL AND before <> start""")
def coverage_check(spark, sf_dir):
    days = _days(spark, sf_dir).select("symbol", F.col("period").alias("start"), (F.col("period") + F.expr("INTERVAL 1 DAY")).alias("end"))
    return _plain(series.coverage_violations(days, ["symbol"]))


@query(f"""WITH c AS (SELECT DISTINCT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS period FROM events)
SELECT symbol, period, EXISTS (SELECT 1 FROM ({_DAYS}) i WHERE i.symbol = c.symbol AND i.period = c.period) AS present FROM c""")
def missing_semi_anti(spark, sf_dir):
    chunks = _events(spark, sf_dir).select(F.col("event_type").alias("symbol"), grid.day_start(F.col("ts")).alias("period")).distinct()
    missing, present = relational.missing_and_present(chunks, _days(spark, sf_dir), ["symbol", "period"])
    return _plain(missing.withColumn("present", F.lit(False)).unionByName(present.withColumn("present", F.lit(True))))


@query("SELECT symbol, i AS \"interval\" FROM (SELECT DISTINCT event_type AS symbol FROM events) CROSS JOIN (SELECT unnest(['1m', '1h', '1d']) AS i)")
def request_cross(spark, sf_dir):
    names = spark.createDataFrame([("1m",), ("1h",), ("1d",), ("1h",)], "interval string")
    return relational.requests_of(_events(spark, sf_dir).select(F.col("event_type").alias("symbol")), names)


@query("""SELECT o.event_type AS symbol, i.name AS "interval", i.rest AS rest, i.micros AS micros, i.daily AS daily FROM (SELECT DISTINCT event_type FROM events) o
CROSS JOIN (VALUES """ + ", ".join(f"('{i.name}', '{i.rest}', {i.micros}::BIGINT, {str(i.daily).upper()})" for i in INTERVALS) + ") i(name, rest, micros, daily)")
def interval_lookup(spark, sf_dir):
    dim = spark.createDataFrame([(i.name, i.rest, i.micros, i.daily) for i in INTERVALS], "interval string, rest string, micros long, daily boolean")
    symbols = _events(spark, sf_dir).select(F.col("event_type").alias("symbol"))
    return relational.requests_of(symbols, dim.select("interval")).join(F.broadcast(dim), "interval").select("symbol", "interval", "rest", "micros", "daily")


_BROKEN = """SELECT symbol, open_time,
    CASE WHEN trades % 97 = 0 THEN open_time + INTERVAL 30 MINUTE ELSE close_time END::TIMESTAMP AS close_time, open,
    CASE WHEN epoch_us(open_time) // 3600000000 % 11 = 0 THEN low - 1 ELSE high END AS high,
    CASE WHEN epoch_us(open_time) // 3600000000 % 13 = 0 THEN close + 1 ELSE low END AS low, close,
    CASE WHEN epoch_us(open_time) // 3600000000 % 7 = 0 THEN -volume ELSE volume END AS volume,
    quote_volume, CASE WHEN epoch_us(open_time) // 3600000000 % 5 = 0 THEN volume + 1 ELSE taker_buy_base_volume END AS taker_buy_base_volume,
    CASE WHEN epoch_us(open_time) // 3600000000 % 17 = 0 THEN quote_volume + 1 ELSE taker_buy_quote_volume END AS taker_buy_quote_volume,
    CASE WHEN epoch_us(open_time) // 3600000000 % 19 = 0 THEN -trades ELSE trades END AS trades FROM ({candles})"""


def _broken(spark, sf_dir) -> DataFrame:
    """Candles with faults at fixed places."""
    h = F.floor(grid.micros(F.col("open_time")) / 3_600_000_000)

    def every(n, bad, good):
        return F.when(h % n == 0, bad).otherwise(F.col(good))

    own = _candles(spark, sf_dir)
    return own.withColumns(
        {
            "high": every(11, F.col("low") - 1, "high").cast(text.NUMBER), "low": every(13, F.col("close") + 1, "low").cast(text.NUMBER),
            "volume": every(7, -F.col("volume"), "volume"), "taker_buy_base_volume": every(5, F.col("volume") + 1, "taker_buy_base_volume").cast(text.NUMBER),
            "taker_buy_quote_volume": every(17, F.col("quote_volume") + 1, "taker_buy_quote_volume").cast(text.NUMBER), "trades": every(19, -F.col("trades"), "trades"),
        }
    )


@query(f"""WITH b AS ({_BROKEN}), r AS (SELECT symbol, CASE WHEN low > high THEN 'low above high' WHEN low > least(open, close) THEN 'low above open or close'
  WHEN high < greatest(open, close) THEN 'high below open or close' WHEN low < 0 THEN 'negative price' END AS reason FROM b)
SELECT symbol, reason, count(*) AS n FROM r GROUP BY ALL""")
def validate_prices(spark, sf_dir):
    return _broken(spark, sf_dir).groupBy("symbol", validate.price_reason().alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH b AS ({_BROKEN}), r AS (SELECT symbol, CASE WHEN least(volume, quote_volume, taker_buy_base_volume, taker_buy_quote_volume) < 0 THEN 'negative volume'
  WHEN taker_buy_base_volume > volume THEN 'taker base above volume' WHEN taker_buy_quote_volume > quote_volume THEN 'taker quote above quote volume' WHEN trades < 0 THEN 'negative trades' END AS reason FROM b)
SELECT symbol, reason, count(*) AS n FROM r GROUP BY ALL""")
def validate_volumes(spark, sf_dir):
    return _broken(spark, sf_dir).groupBy("symbol", validate.volume_reason().alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('hour', ts) ELSE ts END::TIMESTAMP AS o, ts + to_minutes((event_id % 130)::INTEGER - 5) AS c FROM events)
SELECT event_id, CASE WHEN o < TIMESTAMP '2024-01-05 00:00:00' OR o >= TIMESTAMP '2024-01-12 11:00:00' THEN 'outside its period' WHEN epoch_us(o) % 3600000000 <> 0 THEN 'off the grid'
  WHEN c <= o OR c >= o + INTERVAL 1 HOUR THEN 'close time outside its interval' END AS reason FROM t""")
def validate_times(spark, sf_dir):
    i = F.col("event_id")
    own = _events(spark, sf_dir).select("event_id", F.when(i % 2 == 0, F.date_trunc("hour", "ts")).otherwise(F.col("ts")).alias("open_time"), (F.col("ts") + F.make_dt_interval(mins=(i % 130 - 5).cast("int"))).alias("close_time"))
    return own.select("event_id", validate.time_reason(HOUR, START, END).alias("reason"))


@query("""SELECT user_id, event_id, ts AS open_time FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id // 500 * 500 + 499 - event_id % 500) AS before FROM events) WHERE ts <= before""")
def monotonic_violations(spark, sf_dir):
    i = F.col("event_id")
    own = _events(spark, sf_dir).select("user_id", "event_id", F.col("ts").alias("open_time"), (i - i % 500 + 499 - i % 500).alias("position"))
    return _plain(validate.monotonic_violations(own, ["user_id"], "position").drop("position"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN make_timestamp(epoch_us(ts)) ELSE make_timestamp(epoch_us(ts) // 1000 * 1000) END AS t FROM events""")
def epoch_unit_detect(spark, sf_dir):
    us = grid.micros(F.col("ts"))
    wire = F.when(F.col("event_id") % 2 == 0, us).otherwise(F.floor(us / 1000))
    return _plain(_events(spark, sf_dir).select("event_id", grid.from_epoch(wire).alias("t")))


_TEXTS = "CASE event_id % 6 WHEN 0 THEN ' 1.5' WHEN 1 THEN '1e3' WHEN 2 THEN '0.000000019' WHEN 3 THEN event_id::VARCHAR || '.50000000' WHEN 4 THEN '118661604939.' || lpad((event_id % 100000000)::VARCHAR, 8, '0') ELSE '-' || event_id::VARCHAR END"


@query(f"""SELECT event_id, CASE WHEN regexp_matches(s, '^[+-]?[0-9]{{1,30}}(\\.[0-9]{{1,8}})?$') THEN s::DECIMAL(38,8)::VARCHAR END AS number,
  CASE WHEN regexp_matches(s, '^[+-]?[0-9]{{1,19}}$') THEN s::BIGINT END AS whole FROM (SELECT event_id, {_TEXTS} AS s FROM events)""")
def decimal_exact(spark, sf_dir):
    i = F.col("event_id")
    s = (
        F.when(i % 6 == 0, " 1.5").when(i % 6 == 1, "1e3").when(i % 6 == 2, "0.000000019").when(i % 6 == 3, F.concat(i.cast("string"), F.lit(".50000000")))
        .when(i % 6 == 4, F.concat(F.lit("118661604939."), F.lpad((i % 100000000).cast("string"), 8, "0"))).otherwise(F.concat(F.lit("-"), i.cast("string")))
    )
    return _events(spark, sf_dir).select("event_id", text.exact_decimal(s).cast("string").alias("number"), text.exact_long(s).alias("whole"))


_SPELLED = "CASE event_id % 5 WHEN 0 THEN ' ' || event_type || '/usdt ' WHEN 1 THEN upper(event_type) || '-' || (event_id % 1000)::VARCHAR WHEN 2 THEN event_type || '_x' WHEN 3 THEN 'é' || event_type ELSE 'a b' END"


@query(f"""SELECT event_id, CASE WHEN regexp_matches(b, '^[A-Za-z0-9]{{3,20}}$') THEN upper(b) END AS symbol
FROM (SELECT event_id, regexp_replace(trim({_SPELLED}), '[/-]', '', 'g') AS b FROM events)""")
def normalize_symbol(spark, sf_dir):
    i, e = F.col("event_id"), F.col("event_type")
    s = (
        F.when(i % 5 == 0, F.concat(F.lit(" "), e, F.lit("/usdt "))).when(i % 5 == 1, F.concat(F.upper(e), F.lit("-"), (i % 1000).cast("string")))
        .when(i % 5 == 2, F.concat(e, F.lit("_x"))).when(i % 5 == 3, F.concat(F.lit("é"), e)).otherwise("a b")
    )
    return _events(spark, sf_dir).select("event_id", text.normalize_symbol(s).alias("symbol"))


_NAMES = f"SELECT upper(symbol) AS symbol, '1h' AS iv, agg, period, upper(symbol) || '-1h-' || CASE WHEN agg = 'monthly' THEN strftime(period, '%Y-%m') ELSE strftime(period, '%Y-%m-%d') END AS stem FROM ({_INDEX})"


def _names(spark, sf_dir) -> DataFrame:
    own = _index(spark, sf_dir).withColumn("symbol", F.upper("symbol")).withColumn("iv", F.lit("1h"))
    return own.withColumn("stem", text.archive_name(F.col("symbol"), F.col("iv"), F.col("period"), F.col("agg") == "monthly"))


@query(f"SELECT symbol, agg, period, 'data/spot/' || agg || '/klines/' || symbol || '/' || iv || '/' || stem || '.zip' AS key FROM ({_NAMES})")
def archive_names(spark, sf_dir):
    key = F.concat_ws("/", F.lit("data/spot"), "agg", F.lit("klines"), "symbol", "iv", F.concat("stem", F.lit(".zip")))
    return _plain(_names(spark, sf_dir).select("symbol", "agg", "period", key.alias("key")))


@query(f"""WITH n AS (SELECT symbol, iv, CASE WHEN day(period) % 4 = 3 AND agg = 'daily' THEN stem || '.zip.CHECKSUM' WHEN day(period) % 4 = 2 AND agg = 'daily' THEN replace(stem, '-01-', '-13-') || '.zip' ELSE stem || '.zip' END AS name FROM ({_NAMES}))
SELECT name, CASE WHEN regexp_matches(name, '^' || symbol || '-' || iv || '-[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?\\.zip$') THEN try_strptime(regexp_extract(name, '([0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?)\\.zip$', 1) || CASE WHEN length(regexp_extract(name, '([0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?)\\.zip$', 1)) = 7 THEN '-01' ELSE '' END, '%Y-%m-%d') END AS period FROM n""")
def parse_archive_names(spark, sf_dir):
    d, daily = F.dayofmonth("period") % 4, F.col("agg") == "daily"
    name = F.when((d == 3) & daily, F.concat("stem", F.lit(".zip.CHECKSUM"))).when((d == 2) & daily, F.concat(F.replace(F.col("stem"), F.lit("-01-"), F.lit("-13-")), F.lit(".zip"))).otherwise(F.concat("stem", F.lit(".zip")))
    own = _names(spark, sf_dir).withColumn("name", name)
    return _plain(own.select("name", text.archive_period(F.col("name"), F.col("symbol"), F.col("iv")).alias("period")))


@query("""WITH a AS (SELECT event_id::VARCHAR AS stem, sha256(props) AS actual FROM events),
s AS (SELECT event_id::VARCHAR AS stem, CASE WHEN event_id % 50 = 0 THEN sha256('x') ELSE sha256(props) END AS wanted FROM events WHERE event_id % 9 <> 0)
SELECT CASE WHEN wanted IS NULL THEN 'no sidecar' WHEN wanted = actual THEN 'ok' ELSE 'mismatch' END AS status, count(*) AS n FROM a LEFT JOIN s USING (stem) GROUP BY 1""")
def sha256_verify(spark, sf_dir):
    e, i = _events(spark, sf_dir), F.col("event_id")
    archives = e.select(i.cast("string").alias("stem"), F.col("props").cast("binary").alias("content"))
    sidecars = e.where("event_id % 9 <> 0").select(i.cast("string").alias("stem"), F.when(i % 50 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("props", 256)).alias("wanted"))
    return inventory.verified(archives, sidecars).groupBy("status").agg(F.count("*").alias("n"))


_FILES = f"SELECT 'spot/klines/' || symbol || '/' || iv || '/' || agg || '/' || stem || x.ext AS path, (length(stem) * x.w)::BIGINT AS length FROM ({_NAMES}) CROSS JOIN (VALUES ('.zip', 100000), ('.zip.CHECKSUM', 4), ('.parquet', 150000), ('.tmp', 1)) x(ext, w)"


def _files(spark, sf_dir) -> DataFrame:
    kinds = F.explode(F.array(*[F.struct(F.lit(e).alias("ext"), F.lit(w).alias("w")) for e, w in ((".zip", 100000), (".zip.CHECKSUM", 4), (".parquet", 150000), (".tmp", 1))]))
    own = _names(spark, sf_dir).withColumn("x", kinds)
    return own.select(F.concat(F.concat_ws("/", F.lit("spot/klines"), "symbol", "iv", "agg", "stem"), F.col("x.ext")).alias("path"), (F.length("stem") * F.col("x.w")).cast("long").alias("length"))


@query(f"""SELECT CASE WHEN path LIKE '%.zip.CHECKSUM' THEN 'sidecars' WHEN path LIKE '%.zip' THEN 'archives' WHEN path LIKE '%.parquet' THEN 'parquet' ELSE 'other' END AS file_class,
count(*) AS files, sum(length)::BIGINT AS bytes FROM ({_FILES}) GROUP BY 1""")
def cache_usage(spark, sf_dir):
    return inventory.usage(_files(spark, sf_dir))


@query(f"""SELECT path FROM ({_FILES}) f JOIN ({_NAMES}) n ON n.stem = regexp_extract(path, '([^/]*?)(\\.zip\\.CHECKSUM|\\.zip|\\.parquet)$', 1)
WHERE (CASE WHEN n.agg = 'monthly' THEN period + INTERVAL 1 MONTH ELSE period + INTERVAL 1 DAY END) <= TIMESTAMP '2024-01-17 00:00:00'""")
def evict_before(spark, sf_dir):
    return inventory.selected(inventory.parsed(_files(spark, sf_dir)), before=dt.datetime(2024, 1, 17, tzinfo=UTC)).select("path")


@query("SELECT symbol, open_time, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume::DOUBLE AS volume FROM ({candles})")
def column_helpers(spark, sf_dir):
    return _plain(series.column_helpers(_candles(spark, sf_dir)).select("symbol", "open_time", "open", "high", "low", "close", "volume"))


_TRIMMED = "regexp_replace({c}::VARCHAR, '\\.?0+$', '')"
_CSV_SQL = " || ',' || ".join(
    ["strftime(open_time, '%Y-%m-%dT%H:%M:%S') || 'Z'", "strftime(close_time, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"]
    + [_TRIMMED.format(c=c) for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume")] + ["trades::VARCHAR"]
)


@query(f"SELECT symbol, {_CSV_SQL} AS line FROM ({{candles}})")
def export_csv_text(spark, sf_dir):
    from tallow.sources import sinks

    return _candles(spark, sf_dir).select("symbol", sinks.csv_line().alias("line"))


_JSON_SQL = (
    "'{\"open_time\":\"' || strftime(open_time, '%Y-%m-%dT%H:%M:%S') || 'Z\",\"close_time\":\"' || strftime(close_time, '%Y-%m-%dT%H:%M:%S.%f') || 'Z\"' || "
    + " || ".join(f"',\"{c}\":\"' || {_TRIMMED.format(c=c)} || '\"'" for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume"))
    + " || ',\"trades\":' || trades::VARCHAR || '}'"
)


@query(f"SELECT symbol, {_JSON_SQL} AS line FROM ({{candles}})")
def export_json_text(spark, sf_dir):
    from tallow.sources import sinks

    return _candles(spark, sf_dir).select("symbol", sinks.json_line().alias("line"))


@query("SELECT symbol, open_time, trades FROM ({candles}) WHERE open_time + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 10:30:00'")
def settled_only(spark, sf_dir):
    return _plain(series.settled(_candles(spark, sf_dir), HOUR, dt.datetime(2024, 1, 20, 10, 30, tzinfo=UTC)).select("symbol", "open_time", "trades"))


@query("""WITH s AS (SELECT event_id, ts AS a, ts + to_minutes((event_id % 200)::INTEGER) AS b FROM events), f AS (
  SELECT event_id, b, make_timestamp(epoch_us(a) + (3600000000 - epoch_us(a) % 3600000000) % 3600000000) AS first FROM s)
SELECT event_id, first < b AND first + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 10:30:00' AS due FROM f""")
def expects_candles(spark, sf_dir):
    own = _events(spark, sf_dir)
    end = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 200).cast("int"))
    return own.select("event_id", grid.expects_candles(F.col("ts"), end, HOUR, F.lit(dt.datetime(2024, 1, 20, 10, 30, tzinfo=UTC))).alias("due"))


@query(f"""WITH d AS (SELECT DISTINCT event_type AS symbol, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-03', INTERVAL 3 HOUR))::TIMESTAMP AS start FROM events),
h AS (SELECT symbol, period AS o FROM ({_BUSY.format(unit="hour")}))
SELECT symbol, start, (start + INTERVAL 3 HOUR)::TIMESTAMP AS "end" FROM d
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.symbol = d.symbol AND h.o >= d.start AND h.o < d.start + INTERVAL 3 HOUR) AND start + INTERVAL 1 HOUR <= TIMESTAMP '2024-02-01 00:00:00'""")
def empty_spans(spark, sf_dir):
    e = _events(spark, sf_dir)
    spans = e.select(F.col("event_type").alias("symbol")).distinct().withColumn("start", F.explode(F.expr("sequence(timestamp'2024-01-01', timestamp'2024-02-03', INTERVAL 3 HOURS)"))).withColumn("end", F.col("start") + F.expr("INTERVAL 3 HOURS"))
    candles = _busy(e.groupBy(F.col("event_type").alias("symbol"), grid.bucket(F.col("ts"), HOUR).alias("period")).count()).withColumnRenamed("period", "open_time")
    return _plain(series.empty_spans(spans, candles, ["symbol"], HOUR, dt.datetime(2024, 2, 1, tzinfo=UTC)))


@query("""WITH l AS (SELECT user_id AS file, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS row_idx,
  CASE WHEN event_id % 3 = 0 THEN 'open_time' ELSE event_id::VARCHAR END AS c0, CASE WHEN event_id % 4 = 0 THEN value::DECIMAL(38,8)::VARCHAR ELSE 'open' END AS c1 FROM events)
SELECT file, row_idx, c0, row_idx = 0 AND NOT regexp_matches(c0, '^[+-]?[0-9]{1,19}$') AND NOT regexp_matches(c1, '^[+-]?[0-9]{1,30}(\\.[0-9]{1,8})?$') AS is_header FROM l""")
def header_sniff(spark, sf_dir):
    from pyspark.sql import Window

    from tallow.sources import archive

    i = F.col("event_id")
    lines = _events(spark, sf_dir).select(
        F.col("user_id").alias("file"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("row_idx"),
        F.when(i % 3 == 0, "open_time").otherwise(i.cast("string")).alias("c0"), F.when(i % 4 == 0, F.col("value").cast(text.NUMBER).cast("string")).otherwise("open").alias("c1"),
    )
    return lines.select("file", "row_idx", "c0", archive.is_header(F.col("row_idx"), F.col("c0"), F.col("c1")).alias("is_header"))
