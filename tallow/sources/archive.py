"""Archives: one CSV in a ZIP, decoded strictly into candles.

`decode_batches` reads one archive, bytes or a path, block by block and yields Arrow batches; `scan` runs it over many
archives, one per row of Spark's binaryFile source. Row order matters (headers, strictly rising opens), so a file is
decoded by one task, which holds one block of it.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from decimal import Decimal
from itertools import chain
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.functions import text
from tallow.model import CANDLE_SCHEMA, COLUMNS, MICROS_FROM, VOLUMES, WIRE, CorruptArchiveError, Interval, InvalidRequestError, instant, micros_of, parse_interval
from tallow.sources.sinks import ARROW

BATCH = 8_192
#: Bytes of CSV that are parsed at once, and the longest line.
BLOCK = 8 << 20
_INT = re.compile(text.INTEGER, re.ASCII)
_DEC = re.compile(text.DECIMAL, re.ASCII)


@dataclass(frozen=True)
class Spec:
    """What an archive or page must hold: an interval, and opens in the half-open [start, end)."""

    interval: Interval
    start: dt.datetime
    end: dt.datetime

    def validate(self) -> None:
        if not isinstance(self.interval, Interval) or self.start is None or self.end is None or self.start >= self.end:
            raise InvalidRequestError("a spec needs an interval and a span that is not empty")

    def estimated_rows(self) -> int:
        if not self.interval.micros:
            return 1
        return max(1, min(65_536, int((self.end - self.start) / dt.timedelta(microseconds=self.interval.micros))))


def is_header(row_idx: Column, open_time: Column, open_: Column) -> Column:
    """Only a file's first line can be a header: its instant is no integer and its price no number."""
    return (row_idx == 0) & ~open_time.rlike(text.INTEGER) & ~open_.rlike(text.DECIMAL)


def _long(value: str, what: str) -> int:
    if not _INT.match(value) or not -(2**63) <= int(value) < 2**63:
        raise CorruptArchiveError(f"{what} {value!r} is not an integer")
    return int(value)


def decode_time(value: str, what: str) -> dt.datetime:
    n = _long(value, what)
    if n <= 0:
        raise CorruptArchiveError(f"{what} {value!r} is not an instant")
    try:
        return instant(n if n >= MICROS_FROM else n * 1000)
    except OverflowError:
        raise CorruptArchiveError(f"{what} {value!r} is out of range") from None


def decode_row(fields: list[str], spec: Spec) -> tuple:
    """A candle in column order, or CorruptArchiveError."""
    if len(fields) != len(WIRE):
        raise CorruptArchiveError(f"{len(fields)} fields instead of {len(WIRE)}")
    raw = dict(zip(WIRE, fields, strict=True))
    row: dict = {c: decode_time(raw[c], c) for c in COLUMNS[:2]}
    for c in COLUMNS[2:10]:
        if not _DEC.match(raw[c]):
            raise CorruptArchiveError(f"{c} {raw[c]!r} is not a decimal of at most eight places")
        row[c] = Decimal(raw[c])
    row["trades"] = _long(raw["trades"], "trades")
    check(row, spec)
    return tuple(row[c] for c in COLUMNS)


def check(row: dict, spec: Spec) -> None:
    opened, closed = row["open_time"], row["close_time"]
    if not spec.start <= opened < spec.end:
        raise CorruptArchiveError(f"open_time {opened} is outside its period")
    if not spec.interval.aligned(opened):
        raise CorruptArchiveError(f"open_time {opened} is off the {spec.interval} grid")
    if not opened < closed < spec.interval.end(opened):
        raise CorruptArchiveError(f"close_time {closed} is outside its interval")
    low, high = row["low"], row["high"]
    if not 0 <= low <= min(row["open"], row["close"]) <= max(row["open"], row["close"]) <= high:
        raise CorruptArchiveError("prices are out of order or negative")
    if min(row[c] for c in VOLUMES) < 0 or row["taker_buy_base_volume"] > row["volume"] or row["taker_buy_quote_volume"] > row["quote_volume"] or row["trades"] < 0:
        raise CorruptArchiveError("volumes are negative or takers exceed the total")


def decode_csv(lines: Iterator[str], spec: Spec, first: int = 0, before: dt.datetime | None = None) -> Iterator[tuple]:
    """Candles of a file's lines, or of those from row `first` on, `before` being the open of the row before."""
    spec.validate()
    try:
        for i, fields in enumerate(csv.reader(lines, strict=True), first):
            if i == 0 and fields:
                fields[0] = fields[0].removeprefix("﻿")
                if len(fields) == len(WIRE) and not _INT.match(fields[0]) and not _DEC.match(fields[1]):
                    continue
            if not fields:
                continue
            try:
                row = decode_row(fields, spec)
                if before is not None and row[0] <= before:
                    raise CorruptArchiveError(f"open_time {row[0]} does not follow {before}")
            except CorruptArchiveError as e:
                raise CorruptArchiveError(f"row {i + 1}: {e}") from None
            before = row[0]
            yield row
    except (csv.Error, UnicodeDecodeError) as e:
        raise CorruptArchiveError(str(e)) from None


def member(archive: zipfile.ZipFile) -> zipfile.ZipInfo:
    found = [i for i in archive.infolist() if not i.is_dir() and i.filename.lower().endswith(".csv")]
    if len(found) != 1:
        raise CorruptArchiveError(f"{len(found)} CSV files in the archive instead of one")
    return found[0]


@contextmanager
def _reading(content: bytes | Path) -> Iterator[BinaryIO]:
    """The CSV of an archive, inflated as it is read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as z, z.open(member(z)) as f:
            yield f
    except (zipfile.BadZipFile, EOFError, NotImplementedError, zipfile.zlib.error) as e:
        raise CorruptArchiveError(f"not a readable ZIP: {e}") from None


def decode(content: bytes | Path, spec: Spec) -> Iterator[tuple]:
    """Candles of one archive, lazily, in order; stops at the first error."""
    with _reading(content) as f:
        yield from decode_csv(io.TextIOWrapper(f, "utf-8", newline=""), spec)


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def decode_batches(content: bytes | Path, spec: Spec) -> Iterator[pa.RecordBatch]:
    """Candles of one archive as Arrow batches.

    Whole columns of a block are parsed and checked at once. From the first block in which anything is out of order
    the strict reader goes on, and says which row it is.
    """
    spec.validate()
    with _reading(content) as f:
        pieces = _pieces(f)
        for table, raw, row, before in _tables(pieces, spec):
            if table is None:
                lines = (line for piece in chain([raw], pieces) for line in io.StringIO(piece.decode("utf-8"), newline=""))
                yield from batches(decode_csv(lines, spec, row, before))
            else:
                yield from table.to_batches(max_chunksize=65_536)


def _pieces(f: BinaryIO) -> Iterator[bytes]:
    """A file's whole lines, about BLOCK bytes at a time."""
    rest = f.read(BLOCK)
    while got := f.read(BLOCK):
        cut = rest.rfind(b"\n") + 1 or rest.rfind(b"\r") + 1
        if cut:
            yield rest[:cut]
        elif len(rest) > BLOCK:
            raise CorruptArchiveError(f"a line is longer than {BLOCK} bytes")
        rest = rest[cut:] + got
    if rest:
        yield rest


def _tables(pieces: Iterator[bytes], spec: Spec) -> Iterator[tuple[pa.Table | None, bytes, int, dt.datetime | None]]:
    """A table of each piece, the piece, its first row and the open before it; ends with None for the first piece that isn't plain."""
    row, before = 0, None
    for raw in pieces:
        skip = _header_lines(raw) if row == 0 else 0
        table = _block(raw, skip, spec, before)
        yield table, raw, row, before
        if table is None:
            return
        row += skip + table.num_rows
        before = table["open_time"][-1].as_py()


def _columns(content: bytes | Path, spec: Spec) -> pa.Table | None:
    """The file as one table of candles if every row is good, else None."""
    with _reading(content) as f:
        tables = [t for t, *_ in _tables(_pieces(f), spec)]
    return pa.concat_tables(tables) if tables and tables[-1] is not None else None


def _header_lines(raw: bytes) -> int:
    first = raw.split(b"\n", 1)[0].removeprefix(b"\xef\xbb\xbf").strip().split(b",")
    return int(len(first) == len(WIRE) and not first[0].isdigit() and not re.match(rb"[+-]?[0-9]", first[1]))


def _block(raw: bytes, skip: int, spec: Spec, before: dt.datetime | None) -> pa.Table | None:
    """Lines as a table of candles, all after `before`, if every row is good, else None."""
    if b'"' in raw or raw.split(b"\n", 1)[0].count(b",") != len(WIRE) - 1 or not raw.isascii():
        return None
    try:
        t = pacsv.read_csv(
            pa.BufferReader(raw), pacsv.ReadOptions(column_names=list(WIRE), skip_rows=skip, use_threads=False), pacsv.ParseOptions(quote_char=False, ignore_empty_lines=False),
            pacsv.ConvertOptions(column_types=dict.fromkeys(WIRE, pa.string()), strings_can_be_null=False),
        )
        if not t.num_rows:
            return None
        out = {}
        for c in COLUMNS[:2]:
            if not pc.all(pc.match_substring_regex(t[c], "^[0-9]{1,18}$")).as_py():
                return None
            v = t[c].cast(pa.int64())
            out[c] = pc.if_else(pc.greater_equal(v, MICROS_FROM), v, pc.multiply(v, 1000))
        for c in COLUMNS[2:10]:
            if not pc.all(pc.match_substring_regex(t[c], r"^[0-9]{1,28}(\.[0-9]{1,8})?$")).as_py():
                return None
            out[c] = t[c].cast(ARROW.field(c).type)
        if not pc.all(pc.match_substring_regex(t["trades"], "^[0-9]{1,18}$")).as_py():
            return None
        out["trades"] = t["trades"].cast(pa.int64())
    except pa.ArrowInvalid:
        return None
    opened, closed = (out[c].to_numpy() for c in COLUMNS[:2])
    iv = spec.interval
    if before is not None and opened[0] <= micros_of(before):
        return None
    if not iv.micros or opened[0] < micros_of(spec.start) or opened[-1] >= micros_of(spec.end) or opened[0] <= 0:
        return None
    grid = (np.diff(opened) > 0).all() and ((opened - iv.anchor) % iv.micros == 0).all() and ((closed > opened) & (closed < opened + iv.micros)).all()
    body = pc.min_element_wise(out["open"], out["close"]), pc.max_element_wise(out["open"], out["close"])
    pairs = ((out["low"], body[0]), (body[1], out["high"]), (out["taker_buy_base_volume"], out["volume"]), (out["taker_buy_quote_volume"], out["quote_volume"]))
    if not grid or not all(pc.all(pc.less_equal(a, b)).as_py() for a, b in pairs):
        return None
    return pa.table([out[f.name].cast(pa.timestamp("us")).cast(f.type) if f.name in COLUMNS[:2] else out[f.name] for f in ARROW], schema=ARROW)


def period_of(name: str, symbol: str, interval: str) -> Spec | None:
    """The span of an archive's file name; None for foreign names."""
    m = re.fullmatch(rf"{re.escape(symbol)}-{re.escape(interval)}-(\d{{4}}-\d{{2}})(-\d{{2}})?\.zip", name)
    if not m:
        return None
    try:
        start = dt.datetime.fromisoformat(m[1] + (m[2] or "-01")).replace(tzinfo=dt.UTC)
    except ValueError:
        return None
    end = start + dt.timedelta(days=1) if m[2] else (start.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return Spec(parse_interval(interval), start, end)


def scan(spark: SparkSession, paths: list[str], symbol: str, interval: Interval) -> DataFrame:
    """Candles of many archives with `archive` (file name); one task decodes a file, batch by batch."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    schema = "archive string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CANDLE_SCHEMA)

    def run(parts):
        for part in parts:
            for path, content in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
                name = path.rsplit("/", 1)[-1]
                spec = period_of(name, symbol, interval.name)
                if spec is None:
                    raise CorruptArchiveError(f"{name} is not an archive of {symbol} {interval}")
                for b in decode_batches(content.as_py(), spec):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), *b.columns], ["archive", *b.schema.names])

    return files.mapInArrow(run, schema).withColumn("archive", F.col("archive"))
