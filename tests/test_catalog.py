import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tallow import catalog, report

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) and not math.isnan(v):
        return round(v, 9)
    return v.normalize() if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    place = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in place)) for r in rel.fetchall())


def test_human_bytes_of_large_ids(spark, tmp_path):
    """Ids from 975,159 on make sizes that pass 64 bits, where the SQL stops with an error: Python's integers say what is right."""
    from pyspark.sql import functions as F

    ids = [0, 99_999, *range(975_140, 975_160), *range(5_999_980, 6_000_000), None]
    spark.createDataFrame([(i,) for i in ids], "event_id long").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    factor = {0: 1, 1: 4096, 2: 1, 3: 262144}
    want = {i: report.human_bytes((i * i * 37 + i % 3 * 64) * factor[i % 4]) for i in ids if i is not None} | {None: None}
    assert {r.event_id: r["size"] for r in catalog.queries()["human_bytes"](spark, str(tmp_path)).collect()} == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    from tallow.operators import series

    df = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("ts", "open_time")
    import datetime as dt

    plan = series.trim(df, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6)).select("open_time")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual" in plan and "ReadSchema: struct<ts" in plan


def test_streaming_candles(spark):
    from pyspark.sql import functions as F

    from tallow.model import parse_interval
    from tallow.streaming import live

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1).alias("size"), F.col("event_id").alias("id"))
    own = live.aligned(live.candles(ticks, parse_interval("1h")), parse_interval("1h"))
    q = own.writeStream.format("memory").queryName("live_candles").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.symbol, r.open_time): r.trades for r in spark.table("live_candles").collect()}
    want = {(r.symbol, r.open_time): r.trades for r in catalog.queries()["candles_1h"](spark, SF).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 10


def test_reports():
    assert [report.human_bytes(n) for n in (0, 1023, 1024, 852_500_000, 3 << 40)] == ["0 B", "1023 B", "1.0 KB", "813.0 MB", "3.0 TB"]
    assert report.plural(2, "entry") == "2 entries" and report.plural(2, "day") == "2 days" and report.plural(1, "file") == "1 file"
    text = report.usage("/c", {"archives": (412, 893_900_000), "parquet": (412, 1 << 30)})
    assert text.splitlines()[2] == "  archives  412  852.5 MB" and text.splitlines()[-1].startswith("     total  824")
