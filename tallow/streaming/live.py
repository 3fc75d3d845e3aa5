"""Candles on Structured Streaming: late-tolerant candles from events, and de-duplicated candle feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.functions import grid
from tallow.functions.text import NUMBER
from tallow.model import Interval, InvalidRequestError


def candles(ticks: DataFrame, interval: Interval, lateness: str = "10 minutes") -> DataFrame:
    """Candles of ticks (symbol, ts, price, size, id), each emitted once the watermark passes its end.

    Fixed-length intervals only: a month has no window.
    """
    if not interval.micros:
        raise InvalidRequestError("months can't be windowed")
    window = F.window("ts", f"{interval.micros} microseconds", f"{interval.micros} microseconds", f"{interval.anchor % interval.micros} microseconds")
    price, order = F.col("price").cast(NUMBER), F.struct("ts", "id")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("symbol", window.alias("w"))
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(F.col("size").cast(NUMBER)).alias("volume"), F.count("*").alias("trades"))
        .select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "trades")
    )


def once(feed: DataFrame, keys: list[str], lateness: str = "2 hours") -> DataFrame:
    """A feed's candles without repeats inside the watermark; state stays bounded."""
    return feed.withWatermark("open_time", lateness).dropDuplicatesWithinWatermark([*keys, "open_time"])


def aligned(feed: DataFrame, interval: Interval) -> DataFrame:
    """Only candles on the grid; stateless, so it runs on a stream as on a table."""
    return feed.where(grid.is_aligned(F.col("open_time"), interval))
