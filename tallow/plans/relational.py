"""The planner's steps over relations of requests, for many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand(requests: DataFrame) -> DataFrame:
    """Chunks of requests (request_id, start, end half-open, through a midnight, has_daily): kind, start, end.

    Each request's chunks follow from its own row, so nothing is shuffled.
    """
    day, month, tick = "INTERVAL 1 DAY", "INTERVAL 1 MONTH", "INTERVAL 1 MICROSECOND"
    own = requests.withColumn("edge", F.least("end", "through")).withColumn("archived", F.coalesce(F.col("start") < F.col("edge"), F.lit(False)))
    whole = f"(NOT has_daily OR (m >= start AND m + {month} <= edge))"
    days = f"sequence(greatest(m, date_trunc('day', start)), date_trunc('day', least(m + {month}, edge) - {tick}), {day})"
    chunk = "named_struct('kind', '{}', 'start', {}, 'end', {})"
    of_month = f"if({whole}, array({chunk.format('monthly', 'm', f'm + {month}')}), transform({days}, d -> {chunk.format('daily', 'd', f'd + {day}')}))"
    archives = F.expr(f"if(archived, flatten(transform(sequence(date_trunc('month', start), date_trunc('month', edge - {tick}), {month}), m -> {of_month})), array())")
    reach = F.expr("if(size(archives) > 0, element_at(archives, -1).end, start)")
    rest = F.expr(f"if(reach < end, array({chunk.format('rest', 'reach', 'end')}), array())")
    found = own.withColumn("archives", archives).withColumn("reach", reach).select("request_id", F.explode(F.concat("archives", rest)).alias("c"))
    return found.select("request_id", "c.kind", "c.start", "c.end")


def consolidate(chunks: DataFrame, published_months: DataFrame, keys: list[str]) -> DataFrame:
    """Unbroken daily runs of half a published month or more become monthly chunks.

    One window by key and month tells a run; its first day then stands for the month, and the others go.
    """
    in_month = Window.partitionBy(*keys, "period")
    days = chunks.where("kind = 'daily'").select(*keys, "kind", "start", "end", F.date_trunc("month", "start").alias("period"))
    runs = days.withColumns({"n": F.count("*").over(in_month), "a": F.min("start").over(in_month), "b": F.max("end").over(in_month), "at": F.row_number().over(in_month.orderBy("start", "end"))})
    month = published_months.select(*keys, "period").distinct().withColumn("published", F.lit(True))
    whole = F.col("published").isNotNull() & (F.col("n") == F.datediff("b", "a")) & (F.col("n") * 2 >= F.datediff(F.col("period") + F.expr("INTERVAL 1 MONTH"), F.col("period")))
    told = runs.join(month, [*keys, "period"], "left").withColumn("whole", whole).where(~F.col("whole") | (F.col("at") == 1))

    def of_month(m: Column, d: str) -> Column:
        return F.when(F.col("whole"), m).otherwise(F.col(d))

    daily = told.select(*keys, of_month(F.lit("monthly"), "kind").alias("kind"), of_month(F.col("period"), "start").alias("start"), of_month(F.col("period") + F.expr("INTERVAL 1 MONTH"), "end").alias("end"))
    return chunks.where("kind <> 'daily'").select(*keys, "kind", "start", "end").unionByName(daily)


def missing_and_present(chunks: DataFrame, index: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chunks whose archive is not published, chunks whose archive is), by the columns keys of both."""
    own = index.select(*keys).distinct()
    return chunks.join(own, keys, "left_anti"), chunks.join(own, keys, "left_semi")


def requests_of(symbols: DataFrame, intervals: DataFrame) -> DataFrame:
    """Every symbol with every interval, both taken once: a product of two lists of names."""
    return symbols.distinct().crossJoin(F.broadcast(intervals.distinct()))
