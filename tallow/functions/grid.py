"""Candle grids as columns. Instants are timestamps in a UTC session; arithmetic is on whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallow.model import MICROS_FROM, Interval


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def at(us: Column) -> Column:
    return F.timestamp_micros(us)


def month_start(t: Column) -> Column:
    return F.date_trunc("month", t.cast("timestamp"))


def day_start(t: Column) -> Column:
    return F.date_trunc("day", t.cast("timestamp"))


def bucket(t: Column, interval: Interval) -> Column:
    """The open of the candle that holds t."""
    if not interval.micros:
        return month_start(t)
    us = micros(t)
    return at(us - F.pmod(us - interval.anchor, F.lit(interval.micros)))


def is_aligned(t: Column, interval: Interval) -> Column:
    if not interval.micros:
        return t.cast("timestamp") == month_start(t)
    return F.pmod(micros(t) - interval.anchor, F.lit(interval.micros)) == 0


def align_up(t: Column, interval: Interval) -> Column:
    """The first open at or after t."""
    own = t.cast("timestamp")
    if not interval.micros:
        return F.when(own == month_start(t), own).otherwise(month_start(t) + F.expr("INTERVAL 1 MONTH"))
    us = micros(t)
    return at(us + F.pmod(F.lit(interval.anchor) - us, F.lit(interval.micros)))


def interval_end(t: Column, interval: Interval) -> Column:
    """The open after the candle that opens at t."""
    if not interval.micros:
        return month_start(t) + F.expr("INTERVAL 1 MONTH")
    return at(micros(t) + interval.micros)


def expects_candles(start: Column, end: Column, interval: Interval, now: Column) -> Column:
    """Whether a candle could open in [start, end) and be over by now."""
    first = align_up(start, interval)
    return (first < end.cast("timestamp")) & (interval_end(first, interval) <= now.cast("timestamp"))


def from_epoch(value: Column) -> Column:
    """An instant from milliseconds or microseconds, told apart by size."""
    return F.when(value >= MICROS_FROM, F.timestamp_micros(value)).otherwise(F.timestamp_millis(value))
