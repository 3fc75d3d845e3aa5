"""Row checks of candles: one reason per row, strict and quarantine modes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.functions import grid
from tallow.model import PRICES, VOLUMES, Interval


def price_reason() -> Column:
    open_, high, low, close = (F.col(c) for c in PRICES)
    return (
        F.when(low > high, "low above high").when(low > F.least(open_, close), "low above open or close")
        .when(high < F.greatest(open_, close), "high below open or close").when(low < 0, "negative price")
    )


def volume_reason() -> Column:
    volume, quote, base_taken, quote_taken = (F.col(c) for c in VOLUMES)
    return (
        F.when(F.least(volume, quote, base_taken, quote_taken) < 0, "negative volume").when(base_taken > volume, "taker base above volume")
        .when(quote_taken > quote, "taker quote above quote volume").when(F.col("trades") < 0, "negative trades")
    )


def time_reason(interval: Interval, start: dt.datetime | Column | None = None, end: dt.datetime | Column | None = None) -> Column:
    """Period (half-open, if given), grid and close time."""
    opened, closed = F.col("open_time").cast("timestamp"), F.col("close_time").cast("timestamp")
    out = F.when(~grid.is_aligned(opened, interval), "off the grid").when((closed <= opened) | (closed >= grid.interval_end(opened, interval)), "close time outside its interval")
    if start is not None:
        outside = (opened < F.lit(start)) | (opened >= F.lit(end))
        out = F.when(outside, "outside its period").otherwise(out)
    return out


def missing_reason() -> Column:
    return F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in ("open_time", "close_time", *PRICES, *VOLUMES, "trades")]) == 1, "missing or malformed field")


def reason(interval: Interval, start=None, end=None) -> Column:
    """Why a row is no candle, or null."""
    return F.coalesce(missing_reason(), time_reason(interval, start, end), price_reason(), volume_reason())


def monotonic_violations(df: DataFrame, group: list[str], position: str) -> DataFrame:
    """Rows that don't open after the one before them in their file."""
    before = F.lag("open_time").over(Window.partitionBy(*group).orderBy(position))
    return df.withColumn("before", before).where("open_time <= before").drop("before")


def quarantine(df: DataFrame, interval: Interval, start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their reason); nothing fails."""
    marked = df.withColumn("reason", reason(interval, start, end))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def strict(df: DataFrame, interval: Interval, start=None, end=None) -> DataFrame:
    """The rows, or a failed job at the first bad one."""
    why = reason(interval, start, end)
    ok = F.when(why.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("corrupt candle: "), why)).cast("boolean"))
    return df.where(ok)
