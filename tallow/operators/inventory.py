"""The store's files as relations: classes, usage, verification, selection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTENSIONS = ((".zip.CHECKSUM", "sidecars"), (".zip", "archives"), (".parquet", "parquet"))
#: <root>/<market>/klines/<SYMBOL>/<interval>/<monthly|daily>/<SYMBOL>-<interval>-<period><ext>
_PATH = r"([a-z]+)/klines/([A-Z0-9]{3,20})/([0-9]+[a-z]+)/(monthly|daily)/([A-Z0-9]+-[0-9a-z]+-([0-9]{4}-[0-9]{2}(?:-[0-9]{2})?))(\.zip\.CHECKSUM|\.zip|\.parquet)$"


def file_class(path="path"):
    out = None
    for ext, name in EXTENSIONS:
        out = F.when(F.col(path).endswith(ext), name) if out is None else out.when(F.col(path).endswith(ext), name)
    return out.otherwise("other")


def usage(files: DataFrame) -> DataFrame:
    """file_class, files, bytes."""
    return files.groupBy(file_class().alias("file_class")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def verified(archives: DataFrame, sidecars: DataFrame) -> DataFrame:
    """stem and status of archives (stem, content) against sidecars (stem, wanted; empty where it names no checksum)."""
    own = archives.select("stem", F.sha2("content", 256).alias("actual")).join(sidecars.select("stem", "wanted"), "stem", "left")
    return own.select("stem", F.when(F.col("wanted").isNull(), "no sidecar").when(F.col("wanted") == "", "bad sidecar").when(F.lower("wanted") == F.col("actual"), "ok").otherwise("mismatch").alias("status"))


def removable(status: Column) -> Column:
    """Whether a failed archive may go: it is damaged, or half of its entry is gone. A bad sidecar says nothing about it."""
    return status.isin("mismatch", "no sidecar")


def prunable(files: DataFrame) -> DataFrame:
    """path and length of archives whose sidecar and Parquet file are there: what pruning may free at most."""
    own = files.withColumn("class", file_class()).where("class <> 'other'").withColumn("stem", F.regexp_replace("path", r"(\.zip\.CHECKSUM|\.zip|\.parquet)$", ""))
    return (
        own.groupBy("stem").agg(F.count_if(F.col("class") != "archives").alias("others"), F.max(F.when(F.col("class") == "archives", F.struct("path", "length"))).alias("a"))
        .where("others = 2 AND a IS NOT NULL").select("a.path", "a.length")
    )


def parsed(files: DataFrame) -> DataFrame:
    """Own files with market, symbol, interval, agg, stem, ext and period; foreign ones go."""
    names = ("market", "symbol", "interval", "agg", "stem", "date", "ext")
    own = files.withColumns({n: F.regexp_extract("path", _PATH, i) for i, n in enumerate(names, 1)}).where("stem <> ''")
    layout = F.concat_ws("-", "symbol", "interval", "date") == F.col("stem")
    matched = (F.length("date") == F.when(F.col("agg") == "monthly", 7).otherwise(10)) & layout
    return own.where(matched).withColumn("period", F.try_to_timestamp(F.when(F.length("date") == 7, F.concat("date", F.lit("-01"))).otherwise(F.col("date")), F.lit("yyyy-MM-dd"))).where("period IS NOT NULL").drop("date")


def selected(own: DataFrame, symbols=(), intervals=(), before: dt.datetime | None = None) -> DataFrame:
    """Parsed files by all given selectors; `before` bounds the data: a month that reaches past it stays."""
    if symbols:
        own = own.where(F.col("symbol").isin(list(symbols)))
    if intervals:
        own = own.where(F.col("interval").isin(list(intervals)))
    if before is not None:
        end = F.when(F.col("agg") == "monthly", F.col("period") + F.expr("INTERVAL 1 MONTH")).otherwise(F.col("period") + F.expr("INTERVAL 1 DAY"))
        own = own.where(end <= F.lit(before))
    return own
