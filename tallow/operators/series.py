"""Time-series operators: trim, ordered reduce, gaps, ranges, frontier, coverage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.functions import grid
from tallow.model import COLUMNS, Interval


def trim(df: DataFrame, start, end) -> DataFrame:
    """Candles that open in the closed range; the condition reaches the scan."""
    return df.where(F.col("open_time").between(F.lit(start), F.lit(end)))


def strictly_increasing(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Keep a candle only if it opens after every one before it, in the order of chunks and rows.

    Dropped rows never raise the running maximum, so this equals the sequential reduce; duplicates and late
    candles go alike. The first of `order` is the chunk: what a chunk must open after is the maximum of a row for each
    earlier one, and only a chunk's own rows are sorted together, so one long series spreads over the cluster.
    """
    chunk, *inner = order
    own = [*group, chunk]
    earlier = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*own).agg(F.max("open_time").alias("top")).withColumn("reached", F.max("top").over(earlier))
    tops = tops.select(*[F.col(c).alias(f"own_{c}") for c in own], "reached")
    same = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in own]
    before = Window.partitionBy(*own).orderBy(*inner).rowsBetween(Window.unboundedPreceding, -1)
    fresh = df.join(tops, same).where("reached IS NULL OR open_time > reached").withColumn("latest", F.max("open_time").over(before))
    return fresh.where("latest IS NULL OR open_time > latest").select(*df.columns)


def merge(parts: list[DataFrame]) -> DataFrame:
    """Union in chunk order: adds chunk_ord, by which strictly_increasing keeps the first."""
    out = None
    for i, part in enumerate(parts):
        own = part.withColumn("chunk_ord", F.lit(i))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("nothing to merge")
    return out


def settled(df: DataFrame, interval: Interval, now: dt.datetime | Column) -> DataFrame:
    """Candles that are over by now."""
    return df.where(grid.interval_end(F.col("open_time"), interval) <= F.lit(now).cast("timestamp"))


def column_helpers(df: DataFrame) -> DataFrame:
    """Prices and volumes as doubles, for numeric libraries."""
    return df.withColumns({c: F.col(c).cast("double") for c in COLUMNS[2:10] if c in df.columns})


def interior_gaps(published: DataFrame, step: str, keys: list[str], period: str = "period") -> DataFrame:
    """Periods missing strictly between the first and last of each key."""
    span = published.groupBy(*keys).agg(F.min(period).alias("a"), F.max(period).alias("b"))
    every = span.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias(period))
    return every.join(published.select(*keys, period), [*keys, period], "left_anti")


def listing(published: DataFrame, step: str, keys: list[str], period: str = "period") -> DataFrame:
    """Published periods and gaps together, told apart by is_gap."""
    gaps = interior_gaps(published, step, keys, period).withColumn("is_gap", F.lit(True))
    return published.select(*keys, period).distinct().withColumn("is_gap", F.lit(False)).unionByName(gaps)


def frontier(published: DataFrame, keys: list[str]) -> DataFrame:
    """How far archives reach: the end of the latest month or day, whichever is later. Needs agg and period."""
    end = F.when(F.col("agg") == "monthly", F.col("period") + F.expr("INTERVAL 1 MONTH")).otherwise(F.col("period") + F.expr("INTERVAL 1 DAY"))
    return published.groupBy(*keys).agg(F.max(end).alias("through"))


def coalesce_ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """Join half-open ranges that touch: the end of one is the start of the next."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    fresh = F.coalesce((F.lag("end").over(order) != F.col("start")).cast("int"), F.lit(1))
    marked = df.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_ranges")).drop("island")


def coverage_violations(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks that don't start where the one before them ends."""
    before = F.lag("end").over(Window.partitionBy(*keys).orderBy("start"))
    return chunks.withColumn("before", before).where("before IS NOT NULL AND before <> start")


def empty_spans(chunks: DataFrame, candles: DataFrame, keys: list[str], interval: Interval, now) -> DataFrame:
    """Chunks without a candle where at least one is due. chunks: keys, start, end (half-open, already cut to the request).

    Both sides meet by day, so a candle meets the chunks of its own day only.
    """
    day = F.explode(F.expr("if(start < end, sequence(date_trunc('day', start), date_trunc('day', end - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY), array(date_trunc('day', start)))"))
    own = candles.select(*keys, "open_time", F.date_trunc("day", "open_time").alias("on"))
    counted = chunks.select(*keys, "start", "end", day.alias("on")).join(own, [*keys, "on"], "left").groupBy(*keys, "start", "end").agg(F.count_if((F.col("open_time") >= F.col("start")) & (F.col("open_time") < F.col("end"))).alias("n"))
    return counted.where((F.col("n") == 0) & grid.expects_candles(F.col("start"), F.col("end"), interval, F.lit(now))).drop("n")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows over all candle columns."""
    a, b = a.select(*COLUMNS), b.select(*COLUMNS)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
