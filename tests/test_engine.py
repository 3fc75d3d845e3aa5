import datetime as dt
import hashlib
import io
import json
import sys
import time
import zipfile
from collections import Counter
from decimal import Decimal
from urllib.parse import parse_qs

import pytest
from pyspark import cloudpickle

from tallow.engine import CandleEngine, Upstream
from tallow.model import CANDLE_SCHEMA, ChecksumError, Chunk, CorruptArchiveError, InvalidRequestError, Kind, NotAvailableError, Request, instant, micros_of, parse_interval
from tallow.sources import archive, listing, rest, sinks, store
from tallow.sources.http import Response

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this folder
UTC = dt.UTC
HOUR = parse_interval("1h")
NOW = dt.datetime(2024, 3, 3, 12, 30, tzinfo=UTC)


def wire(t, micros=False, i=1):
    us = micros_of(t)
    end = us + 3_600_000_000 - (1 if micros else 1000)
    scale = 1 if micros else 1000
    return [str(us // scale), f"{i}.50000000", f"{i + 2}.0", f"{i}.0", f"{i + 1}.0", "1.5", str(end // scale), "118661604939.99255335", "7", "0.5", "5.5", "0"]


def zipped(name, rows, header=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name.replace(".zip", ".csv"), "\n".join(([header] if header else []) + [",".join(r) for r in rows]))
    return out.getvalue()


class Fake:
    """An upstream in memory that counts what is asked of it. Files on disk count for the executors."""

    def __init__(self, folder):
        self.folder, self.live_from, self.objects = str(folder), None, {}
        self.listed = Counter()

    def publish(self, kind, start, hours=None, broken=False):
        end = start + dt.timedelta(days=1) if kind is Kind.DAILY else (start.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        key = store.key_of("BTCUSDT", HOUR, kind, start)
        n = int((end - start).total_seconds() // 3600) if hours is None else hours
        body = zipped(key.rsplit("/", 1)[1], [wire(start + dt.timedelta(hours=h), i=h + 1) for h in range(n)])
        sha = hashlib.sha256(body + b"x" * broken).hexdigest()
        for k, v in ((key, body), (key + ".CHECKSUM", f"{sha}  {key.rsplit('/', 1)[1]}".encode())):
            self.objects[k] = v
            path = f"{self.folder}/{k.replace('/', '|')}"
            with open(path, "wb") as f:
                f.write(v)

    def archives(self):
        folder = self.folder

        def get(key):
            try:
                with open(f"{folder}/{key.replace('/', '|')}", "rb") as f:
                    body = f.read()
            except FileNotFoundError:
                return Response(404)
            with open(f"{folder}/log", "a") as f:
                f.write(key + "\n")
            return Response(200, body)

        return get

    def listings(self, what):
        q = {k: v[0] for k, v in parse_qs(what[1:]).items()}
        self.listed[q["prefix"]] += 1
        keys = [k for k in sorted(self.objects) if k.startswith(q["prefix"]) and k > q.get("marker", "")]
        items = "".join(f"<Contents><Key>{k}</Key><Size>1</Size></Contents>" for k in keys)
        return Response(200, f"<ListBucketResult><IsTruncated>false</IsTruncated>{items}</ListBucketResult>".encode())

    @staticmethod
    def live(what):
        q = {k: int(v[0]) if v[0].isdigit() else v[0] for k, v in parse_qs(what[1:]).items()}
        t, out = -(-q["startTime"] // 3_600_000) * 3_600_000, []
        while t <= q["endTime"] and len(out) < q["limit"]:
            row = wire(instant(t * 1000), i=1000)
            out.append([int(row[0]), *row[1:6], int(row[6]), row[7], 7, *row[9:]])
            t += 3_600_000
        return Response(200, json.dumps(out).encode())

    def log(self):
        try:
            with open(f"{self.folder}/log") as f:
                return Counter(f.read().split())
        except FileNotFoundError:
            return Counter()


@pytest.fixture
def fake(tmp_path):
    (tmp_path / "up").mkdir()
    return Fake(tmp_path / "up")


def engine(spark, tmp_path, fake, **more):
    return CandleEngine(spark, str(tmp_path / "cache"), Upstream(fake.archives(), fake.listings, fake.live), clock=lambda: NOW, **more)


def day(m, d, h=0):
    return dt.datetime(2024, m, d, h, tzinfo=UTC)


def opens(df):
    return [r.open_time.replace(tzinfo=UTC) for r in df.collect()]


def test_months_days_and_the_live_tail(spark, tmp_path, fake):
    fake.publish(Kind.MONTHLY, day(1, 1))
    for d in (*range(1, 30),):
        if d != 10:
            fake.publish(Kind.DAILY, day(2, d))
    fake.publish(Kind.DAILY, day(3, 1))
    seen = []
    own = engine(spark, tmp_path, fake, progress=seen.append)
    df = own.fetch(Request("btc/usdt", HOUR, day(1, 20, 5)))
    got = opens(df)
    assert got == [day(1, 20, 5) + dt.timedelta(hours=h) for h in range(len(got))]
    assert got[-1] == dt.datetime(2024, 3, 3, 11, tzinfo=UTC)  # 12:00 is in progress
    rows = {r.open_time.replace(tzinfo=UTC): r for r in df.collect()}
    assert rows[day(2, 10, 3)].low == 1000 and rows[day(2, 9, 3)].low == 4  # one missing day is live, only that one
    assert rows[day(1, 20, 5)].quote_volume == Decimal("118661604939.99255335")
    assert len(seen) == seen[0].total and seen[-1].done == len(seen)
    before = fake.log()
    again = opens(own.fetch(Request("BTC-USDT", HOUR, day(1, 20, 5))))
    assert again == got and fake.log() == before and max(before.values()) == 1  # each archive once, then from the store


def test_missing_archive_falls_back_and_empty_span_fails(spark, tmp_path, fake):
    fake.publish(Kind.DAILY, day(2, 1))
    fake.publish(Kind.DAILY, day(2, 2), hours=0)
    fake.publish(Kind.DAILY, day(2, 3))
    key = store.key_of("BTCUSDT", HOUR, Kind.DAILY, day(2, 3))
    (tmp_path / "up" / key.replace("/", "|")).unlink()  # listed, but gone
    own = engine(spark, tmp_path, fake)
    assert len(opens(own.fetch(Request("BTCUSDT", HOUR, day(2, 3), day(2, 3, 23))))) == 24
    with pytest.raises(NotAvailableError):
        own.fetch(Request("BTCUSDT", HOUR, day(2, 1), day(2, 2, 23)))
    with pytest.raises(InvalidRequestError):
        own.fetch(Request("BTCUSDT", HOUR, dt.datetime(2024, 2, 1)))


def asked(fake):
    with open(f"{fake.folder}/log") as f:
        return {line.strip().rsplit("/", 1)[1] for line in f if line.strip().endswith(".zip")}


def test_stream_looks_ahead_only_so_far(spark, tmp_path, fake):
    for d in range(1, 9):
        fake.publish(Kind.DAILY, day(2, d), broken=d == 8)
    seen = []
    e = engine(spark, tmp_path, fake, concurrency=2, progress=seen.append)
    request = Request("BTCUSDT", HOUR, day(2, 1, 5), day(2, 8, 23))
    rows = e.stream(request)
    first = next(rows)
    assert first.open_time == dt.datetime(2024, 2, 1, 5)
    rows.close()
    time.sleep(3)  # what was under way ends
    assert {f"BTCUSDT-1h-2024-02-0{d}.zip" for d in (1, 2)} <= asked(fake) <= {f"BTCUSDT-1h-2024-02-0{d}.zip" for d in (1, 2, 3, 4)}
    assert [p.done for p in seen][:2] == [1, 2] and {p.total for p in seen} == {8}
    seen.clear()
    got = []
    with pytest.raises(Exception, match="checksum"):
        for r in e.stream(request):
            got.append(r.open_time)
    assert len(got) == 6 * 24 - 5 and got == sorted(set(got)) and [p.done for p in seen] == [1, 2, 3, 4, 5, 6]
    short = Request("BTCUSDT", HOUR, day(2, 1, 5), day(2, 6, 20))
    assert [tuple(r) for r in e.stream(short)] == [tuple(r) for r in e.fetch(short).collect()]
    with pytest.raises(InvalidRequestError):
        e.stream(Request("BTCUSDT", HOUR, day(2, 2), day(2, 1)))


def test_stream_falls_back(spark, tmp_path, fake):
    """Groups whose archives are missing go to the live source; the rows are those of fetch."""
    for d in (1, 2, 3, 5):
        fake.publish(Kind.DAILY, day(2, d))
    request = Request("BTCUSDT", HOUR, day(2, 1), day(2, 6, 7))
    e = engine(spark, tmp_path, fake, concurrency=1)
    assert [r.open_time for r in e.stream(request)] == [day(2, 1).replace(tzinfo=None) + dt.timedelta(hours=h) for h in range(5 * 24 + 8)]


def test_store_upkeep(spark, tmp_path, fake):
    for d in (1, 2, 3):
        fake.publish(Kind.DAILY, day(2, d))
    own = engine(spark, tmp_path, fake)
    own.fetch(Request("BTCUSDT", HOUR, day(2, 1), day(2, 3, 23)))
    usage = {r.file_class: r.files for r in own.cache_usage().collect()}
    assert usage == {"archives": 3, "sidecars": 3, "parquet": 3}
    e = [store.entry(own.root, "BTCUSDT", HOUR, Kind.DAILY, day(2, d)) for d in (1, 2, 3)]
    e[0].zip.write_bytes(b"garbage")
    assert Counter(r.status for r in own.verify_cache().collect()) == {"ok": 2, "mismatch": 1}
    # a hit never opens the archive; a stale stamp rebuilds from upstream
    assert len(opens(own.fetch(Request("BTCUSDT", HOUR, day(2, 1), day(2, 1, 23))))) == 24
    bytes_before = e[1].parquet.read_bytes()
    e[1].parquet.write_bytes(b"no parquet")
    own.fetch(Request("BTCUSDT", HOUR, day(2, 2), day(2, 2, 23)))
    assert e[1].parquet.read_bytes() == bytes_before
    e[2].parquet.unlink()
    assert [r.removed for r in own.prune_archives(dry_run=True)] == [True, True, False] and e[1].zip.exists()
    assert [r.removed for r in own.prune_archives()] == [True, True, False] and not e[1].zip.exists() and e[2].zip.exists()
    (e[0].folder / "notes.txt").write_text("mine")
    assert {r.path.rsplit("/", 1)[1] for r in own.evict_cache(before=day(2, 3))} == {x.name for y in e[:2] for x in (y.sidecar, y.parquet)}
    own.evict_cache(everything=True)
    assert [p.name for p in (tmp_path / "cache").rglob("*") if p.is_file()] == ["notes.txt"]
    with pytest.raises(InvalidRequestError):
        own.evict_cache()


def test_checksum_and_corruption(spark, tmp_path, fake):
    fake.publish(Kind.DAILY, day(2, 1), broken=True)
    with pytest.raises(Exception, match="ChecksumError"):
        engine(spark, tmp_path, fake).fetch(Request("BTCUSDT", HOUR, day(2, 1), day(2, 1, 23)))
    assert ChecksumError and not list((tmp_path / "cache").rglob("*.zip"))


def test_available(spark, tmp_path, fake):
    for m in (1, 2):
        fake.publish(Kind.MONTHLY, day(m, 1), hours=1)
    for d in (1, 4, 5, 8):
        fake.publish(Kind.DAILY, day(2, d), hours=1)
    a = engine(spark, tmp_path, fake).available("BTCUSDT", HOUR)
    assert a.monthly == [day(1, 1), day(2, 1)] and a.through == day(3, 1) and a.monthly_gaps == []
    assert a.daily_gaps == [day(2, d) for d in (2, 3, 6, 7)]
    late = engine(spark, tmp_path, fake).available("BTCUSDT", HOUR, day(2, 4, 13))
    assert late.monthly == [day(2, 1)] and late.daily == [day(2, d) for d in (4, 5, 8)] and late.daily_gaps == [day(2, 6), day(2, 7)]
    with pytest.raises(InvalidRequestError):
        engine(spark, tmp_path, fake).available("BTCUSDT", HOUR, dt.datetime(2024, 2, 4))


def test_archive_scan_equals_live(spark, tmp_path, fake):
    fake.publish(Kind.DAILY, day(2, 1), hours=24)
    for k, v in fake.objects.items():
        if k.endswith(".zip"):
            (tmp_path / k.rsplit("/", 1)[1]).write_bytes(v)
    got = archive.scan(spark, [str(tmp_path / "*.zip")], "BTCUSDT", HOUR).drop("archive")
    live = rest.scan(spark, rest.RestClient(fake.live, page=10), "BTCUSDT", HOUR, [(day(2, 1), day(2, 2))], NOW).drop("span")
    assert got.count() == live.count() == 24
    assert got.select("open_time", "close_time", "volume").exceptAll(live.select("open_time", "close_time", "volume")).isEmpty()


BASE = "1735603200000,10.00000000,12.00000000,9.00000000,11.00000000,1.50000000,1735606799999,16.50000000,7,0.50000000,5.50000000,0"


def decoded(*lines, spec=None):
    spec = spec or archive.Spec(HOUR, dt.datetime(2024, 12, 31, tzinfo=UTC), dt.datetime(2025, 1, 1, tzinfo=UTC))
    return list(archive.decode_csv(iter([x + "\n" for x in lines]), spec))


def changed(**fields):
    names = archive.WIRE
    row = dict(zip(names, BASE.split(","), strict=True)) | fields
    return ",".join(row[n] for n in names)


@pytest.mark.parametrize(
    "lines",
    [
        (BASE.rsplit(",", 1)[0],), (BASE + ",0",), (BASE, changed(open="n/a")), (BASE, changed(open_time="2024-12-31T00:00:00Z")), (changed(open_time="0"),),
        (changed(open_time="1735603200"),), (changed(open_time="1735689600000", close_time="1735693199999"),), (changed(open_time="1735605000000"),),
        (changed(open_time="1735603200000500"),), (changed(close_time="1735603199999"),), (changed(close_time="1735606800000"),), (changed(low="13.0"),),
        (changed(high="10.5"),), (changed(open="-10", high="-9", low="-12", close="-11"),), (changed(volume="-1"),), (changed(quote_volume="-1"),),
        (changed(taker_buy_base_volume="1.50000001"),), (changed(taker_buy_quote_volume="16.50000001"),), (changed(trades="7.5"),), (changed(trades="-1"),),
        (BASE, BASE), (changed(open_time="1735606800000", close_time="1735610399999"), BASE), (changed(volume="0.000000019"),), (changed(volume="1e3"),), (changed(volume=" 1"),),
    ],
)
def test_rejected(lines):
    with pytest.raises(CorruptArchiveError):
        decoded(*lines)
    with pytest.raises(CorruptArchiveError):
        both_ways(lines)
    spec = archive.Spec(HOUR, dt.datetime(2024, 12, 31, tzinfo=UTC), dt.datetime(2025, 1, 1, tzinfo=UTC))
    assert archive._columns(zipped("a.zip", [x.split(",") for x in lines]), spec) is None


def both_ways(lines):
    """The column-wise reader gives what the strict one gives, or leaves the file to it."""
    spec = archive.Spec(HOUR, dt.datetime(2024, 12, 31, tzinfo=UTC), dt.datetime(2025, 1, 1, tzinfo=UTC))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.csv", "\n".join(lines))
    fast, slow = archive._columns(out.getvalue(), spec), list(archive.decode(out.getvalue(), spec))
    return fast, [tuple(r.values()) for b in archive.decode_batches(out.getvalue(), spec) for r in b.to_pylist()], slow


@pytest.mark.parametrize("lines", [(BASE,), ("a,b,c,d,e,f,g,h,i,j,k,l", BASE), (BASE, changed(open_time="1735606800000000", close_time="1735610399999999", volume="118661604939.99255335"))])
def test_columns_equal_rows(lines):
    fast, got, slow = both_ways(lines)
    assert fast is not None and got == slow and fast.num_rows == len(slow)


@pytest.mark.parametrize("lines", [(), ("\ufeff" + BASE,), ("a,b,c,d,e,f,g,h,i,j,k,l",), (changed(open="+10.0"),)])
def test_rows_where_columns_give_up(lines):
    fast, got, slow = both_ways(lines)
    assert fast is None and got == slow


@pytest.mark.parametrize(
    ("lines", "n"),
    [((BASE,), 1), (("open_time,open,high,low,close,volume,close_time,quote_volume,trades,a,b,ignore", BASE), 1), (("a,b,c,d,e,f,g,h,i,j,k,l",), 0), ((), 0), (("﻿" + BASE,), 1), (("!,?,c,d,e,f,g,h,i,j,k,l", BASE), 1), ((BASE, changed(open_time="1735606800000000", close_time="1735610399999999")), 2)],
)
def test_accepted(lines, n):
    assert len(decoded(*lines)) == n


def hours(n):
    return [changed(open_time=str(1735603200000 + h * 3_600_000), close_time=str(1735606799999 + h * 3_600_000)) for h in range(n)]


HEADER = "open_time,open,high,low,close,volume,close_time,quote_volume,trades,a,b,ignore"


@pytest.mark.parametrize("block", [1, 150, 700, 5_000])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_blocks_give_what_the_whole_gives(monkeypatch, block, end):
    """Whatever the block, the rows or the error are the strict reader's, and the error names the same row."""
    monkeypatch.setattr(archive, "BLOCK", block)
    spec = archive.Spec(HOUR, dt.datetime(2024, 12, 31, tzinfo=UTC), dt.datetime(2025, 1, 1, tzinfo=UTC))
    good = hours(20)
    quoted = ",".join(f'"{x}"' for x in good[11].split(","))
    files = [good, [HEADER, *good], good[:11] + [quoted] + good[12:], good[:7] + [""] + good[7:], good[:15] + good[13:], [HEADER, *good[:9], HEADER, *good[9:]], [*good[:18], "1,2"], ["\ufeff" + good[0], *good[1:]], [*good[:12], good[12] + "\u00e9"], []]
    for lines in files:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.csv", "".join(x + end for x in lines))

        def outcome(rows):
            got = []
            try:
                got += rows()
            except CorruptArchiveError as e:
                return str(e)
            return got

        if block < 150 and lines:
            # shorter than a line: refused as too long, or read
            got = outcome(lambda own=out: [tuple(r.values()) for b in archive.decode_batches(own.getvalue(), spec) for r in b.to_pylist()])
            assert got == outcome(lambda own=out: list(archive.decode(own.getvalue(), spec))) or "longer than" in got
            continue
        got = outcome(lambda own=out: [tuple(r.values()) for b in archive.decode_batches(own.getvalue(), spec) for r in b.to_pylist()])
        assert got == outcome(lambda own=out: list(archive.decode(own.getvalue(), spec))), lines


def test_blocks_stay_columnar_and_paths_are_read(monkeypatch, tmp_path):
    monkeypatch.setattr(archive, "BLOCK", 400)
    spec = archive.Spec(HOUR, dt.datetime(2024, 12, 31, tzinfo=UTC), dt.datetime(2025, 1, 1, tzinfo=UTC))
    path = tmp_path / "a.zip"
    path.write_bytes(zipped("a.zip", [x.split(",") for x in hours(20)]))
    strict = list(archive.decode(path, spec))
    monkeypatch.setattr(archive, "decode_csv", lambda *a: pytest.fail("the strict reader was asked"))
    parts = list(archive.decode_batches(path, spec))
    assert len(parts) > 3 and [tuple(r.values()) for b in parts for r in b.to_pylist()] == strict and len(strict) == 20
    cut = tmp_path / "cut.zip"
    cut.write_bytes(path.read_bytes()[:-30])
    with pytest.raises(CorruptArchiveError):
        list(archive.decode_batches(cut, spec))


def test_zip_members():
    spec = archive.Spec(HOUR, dt.datetime(2024, 12, 31, tzinfo=UTC), dt.datetime(2025, 1, 1, tzinfo=UTC))
    for members in ((), ("a.csv", "b.csv"), ("a.txt",)):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for m in members:
                z.writestr(m, BASE)
        with pytest.raises(CorruptArchiveError):
            list(archive.decode(out.getvalue(), spec))
    with pytest.raises(CorruptArchiveError):
        list(archive.decode(b"no zip", spec))
    with pytest.raises(InvalidRequestError):
        list(archive.decode_csv(iter([]), archive.Spec(HOUR, spec.end, spec.start)))


def test_listing_pages():
    pages = iter(
        [
            b"<ListBucketResult><IsTruncated>true</IsTruncated><NextMarker>b</NextMarker><Contents><Key>a</Key><Size>3</Size></Contents></ListBucketResult>",
            b"<ListBucketResult><IsTruncated>true</IsTruncated><Contents><Key>c</Key><Size>1</Size></Contents></ListBucketResult>",
            b"<ListBucketResult><IsTruncated>false</IsTruncated></ListBucketResult>",
        ]
    )
    asked = []
    got = listing.list_objects(lambda q: (asked.append(q), Response(200, next(pages)))[1], "p/")
    assert [o.key for o in got] == ["a", "c"] and "marker=b" in asked[1] and "marker=c" in asked[2]
    for body in (b"<html></html>", b"nonsense", b"<ListBucketResult><IsTruncated>true</IsTruncated></ListBucketResult>"):
        with pytest.raises(Exception, match="listing"):
            listing.list_objects(lambda q, body=body: Response(200, body), "p/")


def test_sinks(spark, tmp_path):
    rows = decoded(BASE, changed(open_time="1735606800000", close_time="1735610399999", volume="118661604939.99255335"))
    df = spark.createDataFrame(rows, CANDLE_SCHEMA)
    out = io.BytesIO()
    assert sinks.write_csv(df, out) == 2
    lines = out.getvalue().decode().split("\n")
    assert lines[0] == ",".join(sinks.COLUMNS) and lines[1] == "2024-12-31T00:00:00Z,2024-12-31T00:59:59.999Z,10,12,9,11,1.5,16.5,0.5,5.5,7"
    out = io.BytesIO()
    sinks.write_json(df, out)
    parsed = json.loads(out.getvalue())
    assert parsed[1]["volume"] == "118661604939.99255335" and parsed[0]["trades"] == 7 and out.getvalue().startswith(b'[\n  {"open_time":"2024-12-31T00:00:00Z"')
    path = tmp_path / "x.parquet"
    assert sinks.publish(path, lambda f: sinks.write_parquet(df, f)) == 2
    assert spark.read.parquet(str(path)).count() == 2
    with pytest.raises(ZeroDivisionError):
        sinks.publish(tmp_path / "y", lambda f: f.write(b"x") / 0)
    assert {p.name for p in tmp_path.iterdir()} == {"x.parquet"}
    assert Chunk(day(1, 1), day(2, 1), Kind.MONTHLY).kind.source == "monthly archive"


def test_command_line(spark, tmp_path, fake, capsys, monkeypatch):
    from tallow import cli, engine

    for d in (1, 2):
        fake.publish(Kind.DAILY, day(2, d))
    up = Upstream(fake.archives(), fake.listings, fake.live)
    monkeypatch.setattr(engine.CandleEngine, "__init__", _with_clock(engine.CandleEngine.__init__))

    def run(*argv):
        code = cli.main(["--quiet", "--cache-dir", str(tmp_path / "cache"), *argv], spark, up)
        return code, capsys.readouterr()

    out = tmp_path / "x.csv"
    code, said = run("download", "--symbol", "btc/usdt", "--interval", "1h", "--start", "2024-02-01", "--end", "2024-02-02", "--out", str(out))
    assert code == 0 and said.out == "" and "48 candles" in said.err and len(out.read_text().splitlines()) == 49
    code, said = run("list", "--symbol", "BTCUSDT", "--interval", "1h")
    assert code == 0 and "daily archives" in said.out and "2024-02-01 .. 2024-02-02" in said.out
    code, said = run("list", "--symbol", "BTCUSDT", "--interval", "1h", "--since", "2024-02-02")
    assert code == 0 and "2024-02-02 .. 2024-02-02" in said.out
    code, said = run("cache")
    assert "  archives  2  " in said.out and "in 2 archives can be freed by prune" in said.out
    assert run("verify")[0] == 0 and "2 files" in run("prune")[1].out and "4 files" in run("evict", "--all")[1].out
    assert "nothing matched" in run("evict", "--all")[1].out and "no cached archives" in run("prune")[1].out and "empty" in run("cache")[1].out
    assert run("evict")[0] == 2 and run("download", "--symbol", "x", "--interval", "1h", "--start", "2024-02-01")[0] == 2 and run("nothing")[0] == 2
    two = run("download", "--symbol", "BTCUSDT", "--interval", "1h,1d", "--start", "2024-02-01", "--end", "2024-02-02", "--out", "-")
    assert two[0] == 2 and [str(r.interval) for r in cli.requests_of(["btcusdt", "BTC/USDT"], ["1h,1d", "1h"], "2024-01-01", None)] == ["1h", "1d"]


def _with_clock(init):
    return lambda self, *a, **k: init(self, *a, **(k | {"clock": lambda: NOW}))


def test_several_downloads_need_a_directory(tmp_path):
    sinks.check_destination("", 5)
    sinks.check_destination("x.csv", 1)
    sinks.check_destination("-", 1)
    sinks.check_destination(str(tmp_path), 2)
    (tmp_path / "f.csv").write_text("kept")
    for out in ("-", str(tmp_path / "missing"), str(tmp_path / "f.csv")):
        with pytest.raises(InvalidRequestError):
            sinks.check_destination(out, 2)


def test_command_line_keeps_files_apart(spark, tmp_path, fake, capsys):
    from tallow import cli

    (tmp_path / "x.csv").write_text("kept")
    up = Upstream(fake.archives(), fake.listings, fake.live)

    def run(*args):
        return cli.main(["--cache-dir", str(tmp_path / "cache"), "--quiet", "download", "--start", "2024-03-03", "--end", "2024-03-03T03:00:00Z", *args], spark, up)

    for several in (("--symbol", "BTCUSDT,ETHUSDT", "--interval", "1h"), ("--symbol", "BTCUSDT", "--interval", "1h,2h")):
        for out in (tmp_path / "x.csv", tmp_path / "new.csv"):
            assert run(*several, "--out", str(out)) == 2
    assert (tmp_path / "x.csv").read_text() == "kept" and not (tmp_path / "new.csv").exists()
    (tmp_path / "out").mkdir()
    assert run("--symbol", "BTCUSDT,ETHUSDT", "--interval", "1h", "--out", str(tmp_path / "out")) == 0
    assert len(list((tmp_path / "out").iterdir())) == 2
    assert run("--symbol", "BTCUSDT", "--interval", "1h", "--out", str(tmp_path / "x.csv")) == 0
    assert (tmp_path / "x.csv").read_text() != "kept"


def test_verify_removes_what_is_damaged_and_nothing_else(spark, tmp_path, fake, capsys):
    from tallow import cli

    for d in (1, 2, 3, 4):
        fake.publish(Kind.DAILY, day(2, d))
    own = engine(spark, tmp_path, fake)
    own.fetch(Request("BTCUSDT", HOUR, day(2, 1), day(2, 4, 23))).count()
    e = [store.entry(str(tmp_path / "cache"), "BTCUSDT", HOUR, Kind.DAILY, day(2, d)) for d in (1, 2, 3, 4)]
    e[1].zip.write_bytes(b"damaged")
    e[2].sidecar.unlink()
    e[3].sidecar.write_text("not a checksum")
    assert Counter(r.status for r in own.verify_cache().collect()) == {"ok": 1, "mismatch": 1, "no sidecar": 1, "bad sidecar": 1}

    def run(*args):
        return cli.main(["--cache-dir", str(tmp_path / "cache"), "--quiet", "verify", *args], spark, Upstream(fake.archives(), fake.listings, fake.live))

    assert run() == 1 and all(x.zip.exists() for x in e)
    assert run("--rm") == 1
    out = capsys.readouterr().out
    assert f"removed {e[1].zip.name}" in out and f"removed {e[1].sidecar.name}" in out and f"removed {e[2].zip.name}" in out
    assert [x.zip.exists() for x in e] == [True, False, False, True]
    assert [x.sidecar.exists() for x in e] == [True, False, False, True]
    assert all(x.parquet.exists() for x in e)


def test_stamps_are_whole_and_bytes_reproducible(tmp_path):
    rows = [wire(day(2, 1, h), i=h + 1) for h in range(24)]
    spec = archive.Spec(HOUR, day(2, 1), day(2, 2))
    body = zipped("BTCUSDT-1h-2024-02-01.zip", rows)

    def write(path, stamp):
        with open(path, "wb") as f:
            sinks.parquet_batches(archive.decode_batches(body, spec), f, stamp)
        return path.read_bytes()

    whole = {sinks.STAMP_SHA: b"a" * 64, sinks.STAMP_FILE: b"x.zip"}
    assert write(tmp_path / "a", whole) == write(tmp_path / "b", whole)
    for bad in ({}, {sinks.STAMP_SHA: b"a" * 64}, {sinks.STAMP_FILE: b"x.zip"}, whole | {sinks.STAMP_SHA: b""}):
        with pytest.raises(InvalidRequestError):
            write(tmp_path / "c", bad)


def test_quarantine_and_strict(spark):
    from pyspark.sql import functions as F

    from tallow.operators import series, validate

    spec = archive.Spec(HOUR, day(2, 1), day(2, 2))
    good = spark.createDataFrame([archive.decode_row(wire(day(2, 1, h), i=h + 1), spec) for h in range(5)], CANDLE_SCHEMA)
    bad = good.limit(1).withColumn("high", F.lit(Decimal(0)).cast("decimal(38,8)")).unionByName(good.limit(1).withColumn("trades", F.lit(None).cast("long")))
    kept, gone = validate.quarantine(good.unionByName(bad), HOUR, day(2, 1), day(2, 2))
    assert series.same_rows(kept, good) and not series.same_rows(kept, good.limit(4))
    assert sorted(r.reason for r in gone.collect()) == ["low above high", "missing or malformed field"]
    assert validate.strict(good, HOUR).count() == 5
    with pytest.raises(Exception, match="corrupt candle"):
        validate.strict(good.unionByName(bad), HOUR).collect()


def test_write_directory(spark, tmp_path):
    from tallow.operators import series

    spec = archive.Spec(HOUR, day(2, 1), day(2, 2))
    df = spark.createDataFrame([archive.decode_row(wire(day(2, 1, h), i=h + 1), spec) for h in range(24)], CANDLE_SCHEMA)
    sinks.write_directory(df, str(tmp_path / "out"))
    assert series.same_rows(spark.read.schema(CANDLE_SCHEMA).parquet(str(tmp_path / "out")), df)


def test_bytes_as_a_column(spark):
    from pyspark.sql import functions as F

    from tallow import report
    from tallow.functions import text

    sizes = [0, 1, 1023, 1024, 1280, 1536, 1792, 10**6, 852_500_000, 1 << 30, 3 << 40, 1 << 51]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", text.human_bytes(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in got} == {n: report.human_bytes(n) for n in sizes}


def test_bytes_beyond_a_long(spark):
    from pyspark.sql import functions as F

    from tallow import report
    from tallow.functions import text

    near = [round((whole + tenths / 20) * 2**40) for whole in (4096, 8_388_000, 350_000_000) for tenths in range(1, 20, 2)]
    sizes = [1023, 1024, 1280, 1048575, (1 << 53) + 1, (1 << 63) - 1, 1 << 63, 349_150_210_000_000_000_000, (1 << 103) - 1, 1 << 103, 10**38 - 1, *near]
    rows = spark.createDataFrame([(Decimal(n),) for n in [*sizes, -1]], "n decimal(38,0)").withColumn("n", F.when(F.col("n") >= 0, F.col("n")))
    got = rows.select(F.col("n").cast("string").alias("n"), text.human_bytes(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in got} == {str(n): report.human_bytes(n) for n in sizes} | {None: None}


def test_usage_names_what_can_go():
    from tallow import report

    rows = {"archives": (2, 2048), "parquet": (2, 100)}
    assert report.usage("/r", rows, [1024]).endswith("\n1.0 KB in 1 archive can be freed by prune\n")
    assert report.usage("/r", rows).endswith("nothing to prune: every archive is still needed\n")
    assert "prune" not in report.usage("/r", {"parquet": (2, 100)}) and report.usage("/r", {}) == "/r\n\nempty\n"
