"""CSV, JSON and Parquet exports of candles, and atomic publishing of single files."""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallow.functions.text import plain, rfc3339
from tallow.model import COLUMNS, InvalidRequestError, Request

FORMATS = ("csv", "json", "parquet")
ROW_GROUP, BATCH = 65_536, 1_024
CODEC_VERSION = 1
STAMP_SHA, STAMP_FILE, STAMP_CODEC, STAMP_ROWS = b"tallow.source.sha256", b"tallow.source.file", b"tallow.codec.version", b"tallow.rows"

ARROW = pa.schema(
    [pa.field(c, pa.timestamp("us", tz="UTC"), nullable=False) for c in COLUMNS[:2]]
    + [pa.field(c, pa.decimal128(38, 8), nullable=False) for c in COLUMNS[2:10]]
    + [pa.field("trades", pa.int64(), nullable=False)]
)


def _texts() -> dict[str, Column]:
    out = {c: rfc3339(F.col(c)) for c in COLUMNS[:2]} | {c: plain(F.col(c)) for c in COLUMNS[2:10]}
    return out | {"trades": F.col("trades").cast("string")}


def csv_line() -> Column:
    return F.concat_ws(",", *_texts().values())


def json_line() -> Column:
    """One object; decimals are strings, trades a number."""
    parts = [F.concat(F.lit(f'"{c}":' + ('"' if c != "trades" else "")), t, F.lit('"' if c != "trades" else "")) for c, t in _texts().items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _lines(df: DataFrame, line: Column) -> Iterator[str]:
    """In order of opening, one partition at a time."""
    for r in df.orderBy("open_time").select(line.alias("line")).toLocalIterator(prefetchPartitions=True):
        yield r.line


def write_csv(df: DataFrame, out: BinaryIO) -> int:
    out.write((",".join(COLUMNS) + "\n").encode())
    n = 0
    for n, line in enumerate(_lines(df, csv_line()), 1):
        out.write((line + "\n").encode())
    return n


def write_json(df: DataFrame, out: BinaryIO) -> int:
    n = 0
    for n, line in enumerate(_lines(df, json_line()), 1):
        out.write((("[\n  " if n == 1 else ",\n  ") + line).encode())
    out.write(b"\n]\n" if n else b"[]\n")
    return n


def parquet_batches(batches: Iterator[pa.RecordBatch], out, stamp: dict[bytes, bytes] | None = None) -> int:
    """Candle batches to one file: Snappy, bounded row groups, the stamp and row count in the footer.

    The same rows give the same bytes. A stamp names both the source's checksum and its file, or there is none.
    """
    if stamp is not None and not (stamp.get(STAMP_SHA) and stamp.get(STAMP_FILE)):
        raise InvalidRequestError("a stamp needs the source's checksum and its file name")
    meta = {STAMP_CODEC: str(CODEC_VERSION).encode()} | (stamp or {})
    n = 0
    with pq.ParquetWriter(out, ARROW, compression="snappy", use_dictionary=False, store_schema=False, store_decimal_as_integer=False) as w:
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(list(COLUMNS)).cast(ARROW)
            w.write_table(table, row_group_size=ROW_GROUP)
            n += batch.num_rows
        w.add_key_value_metadata({k.decode(): v.decode() for k, v in (meta | {STAMP_ROWS: str(n).encode()}).items()})
    return n


def write_parquet(df: DataFrame, out) -> int:
    """One file, in order; no source stamp, since the rows may come from many archives."""

    def batches():
        rows: list = []
        for r in df.orderBy("open_time").select(*COLUMNS).toLocalIterator(prefetchPartitions=True):
            rows.append(tuple(r))
            if len(rows) == ROW_GROUP:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return parquet_batches(batches(), out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    import datetime as dt

    columns = [pa.array([v.replace(tzinfo=dt.UTC) if isinstance(v, dt.datetime) and v.tzinfo is None else v for v in c], t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def write_directory(df: DataFrame, path: str) -> None:
    """The scalable export: many Snappy part files, exact types, through Spark's commit protocol."""
    df.sparkSession.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    df.select(*COLUMNS).write.option("compression", "snappy").parquet(path)


ENCODERS: dict[str, Callable] = {"csv": write_csv, "json": write_json, "parquet": write_parquet}


def encoder_for(name: str) -> Callable:
    if name not in ENCODERS:
        raise InvalidRequestError(f"unknown format {name!r}: one of {', '.join(FORMATS)}")
    return ENCODERS[name]


def output_name(request: Request, fmt: str) -> str:
    def day(t):
        return t.strftime("%Y-%m-%d") if t is not None else "now"

    return f"{request.symbol}-{request.interval.name}-{day(request.start)}_{day(request.end)}.{fmt}"


def destination(out: str, name: str) -> Path | None:
    """None for standard output; a directory takes the generated name."""
    if out == "-":
        return None
    path = Path(out) if out else Path(name)
    return path / name if out and path.is_dir() else path


def check_destination(out: str, requests: int) -> None:
    """Several requests need a file each: a directory that is there, or generated names in this one."""
    if requests < 2 or not out:
        return
    if out == "-":
        raise InvalidRequestError(f"{requests} requests can't share standard output: give a directory")
    if not Path(out).is_dir():
        raise InvalidRequestError(f"{out!r} must be an existing directory for {requests} requests")


def publish(path: Path | str, write: Callable[[BinaryIO], int]) -> int:
    """Write beside the target, sync, rename: readers see the whole file or none, failures leave nothing."""
    path = Path(path)
    fd, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "wb") as f:
            n = write(f)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temp, 0o644)
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)
    return n


def write_to(path: Path | None, encode: Callable, df: DataFrame) -> int:
    if path is None:
        return encode(df, sys.stdout.buffer)
    return publish(path, lambda f: encode(df, f))
