"""python -m tallow.cli: download, list, cache, prune, evict, verify. Data on stdout, the rest on stderr."""

from __future__ import annotations

import argparse
import http.client
import importlib
import sys
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from pathlib import Path

from tallow import report
from tallow.engine import CandleEngine, Upstream
from tallow.model import INTERVALS, InvalidRequestError, Request, TallowError, normalize_symbol, parse_end, parse_interval, parse_start
from tallow.sources import sinks
from tallow.sources.http import Response

OK, FAILED, USAGE, INTERRUPTED = 0, 1, 2, 130
PIECE = 1 << 20


class _Base:
    """A transport over a base URL."""

    def __init__(self, base: str):
        self.base = base

    def __call__(self, what: str) -> Response:
        try:
            r = urllib.request.urlopen(self.base + what, timeout=60)
        except urllib.error.HTTPError as e:
            with e:
                return Response(e.code, e.read(1024), dict(e.headers))
        except http.client.HTTPException as e:
            raise OSError(f"{type(e).__name__}: {e}") from e
        return Response(r.status, headers=dict(r.headers), parts=self._parts(r))

    @staticmethod
    def _parts(r) -> Iterator[bytes]:
        with r:
            try:
                while got := r.read(PIECE):
                    yield got
            except http.client.HTTPException as e:
                raise OSError(f"{type(e).__name__}: {e}") from e


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tallow", description="Historical candles on Spark")
    p.add_argument("--cache-dir", default="candles")
    p.add_argument("--concurrency", type=int, default=8)
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--upstream", help="module:function that returns an Upstream")
    p.add_argument("--archives", default="")
    p.add_argument("--listings", default="")
    p.add_argument("--live", default="")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("download")
    d.add_argument("--symbol", action="append", required=True)
    d.add_argument("--interval", action="append", required=True)
    d.add_argument("--start", required=True)
    d.add_argument("--end")
    d.add_argument("--format", default="csv", choices=sinks.FORMATS)
    d.add_argument("--out", default="")
    ls = sub.add_parser("list")
    ls.add_argument("--symbol", required=True)
    ls.add_argument("--interval", required=True)
    ls.add_argument("--since", help="list from this date or instant on")
    ls.add_argument("--all", action="store_true")
    sub.add_parser("cache")
    sub.add_parser("prune").add_argument("--dry-run", action="store_true")
    e = sub.add_parser("evict")
    for name in ("symbol", "interval"):
        e.add_argument(f"--{name}", action="append", default=[])
    e.add_argument("--before")
    e.add_argument("--all", action="store_true")
    e.add_argument("--dry-run", action="store_true")
    sub.add_parser("verify").add_argument("--rm", action="store_true", help="delete archives that fail, with their sidecars")
    return p


def requests_of(symbols: Sequence[str], intervals: Sequence[str], start: str, end: str | None) -> list[Request]:
    """Symbol by symbol, every interval; both lists count once after parsing."""
    names = dict.fromkeys(normalize_symbol(x) for s in symbols for x in s.split(","))
    widths = dict.fromkeys(parse_interval(x) for i in intervals for x in i.split(","))
    return [Request(s, i, parse_start(start), parse_end(end) if end else None) for s in names for i in widths]


def main(argv: Sequence[str] | None = None, spark=None, upstream: Upstream | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return OK if not e.code else USAGE
    try:
        if upstream is None and args.upstream:
            module, _, name = args.upstream.partition(":")
            upstream = getattr(importlib.import_module(module), name)()
        upstream = upstream or Upstream(_Base(args.archives), _Base(args.listings), _Base(args.live))
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("tallow").getOrCreate()

        def show(p) -> None:
            print(f"{report.progress_bar(p.done, p.total)} {p.chunk.kind.source}", file=sys.stderr)

        engine = CandleEngine(spark, args.cache_dir, upstream, args.concurrency, progress=None if args.quiet else show)
        return _run(engine, args)
    except InvalidRequestError as e:
        print(f"tallow: {e}", file=sys.stderr)
        return USAGE
    except KeyboardInterrupt:
        return INTERRUPTED
    except (TallowError, OSError) as e:
        print(f"tallow: {e}", file=sys.stderr)
        return FAILED


def _run(engine: CandleEngine, args) -> int:
    if args.command == "download":
        wanted = requests_of(args.symbol, args.interval, args.start, args.end)
        sinks.check_destination(args.out, len(wanted))
        now, failed = engine.clock(), 0
        for r in wanted:
            try:
                path = sinks.destination(args.out, sinks.output_name(r.resolve(now), args.format))
                n = sinks.write_to(path, sinks.encoder_for(args.format), engine.fetch(r, now))
                print(f"{r.symbol} {r.interval}: {report.plural(n, 'candle')}" + (f" to {path}" if path else ""), file=sys.stderr)
            except TallowError as e:
                failed += 1
                print(f"tallow: {r.symbol} {r.interval}: {e}", file=sys.stderr)
        return FAILED if failed else OK
    if args.command == "list":
        symbol, interval = normalize_symbol(args.symbol), parse_interval(args.interval)
        sys.stdout.write(report.availability(symbol, interval, engine.available(symbol, interval, parse_start(args.since) if args.since else None), args.all))
    elif args.command == "cache":
        sys.stdout.write(report.usage(engine.root, {r.file_class: (r.files, r.bytes) for r in engine.cache_usage().collect()}, [r.freed for r in engine.prune_archives(dry_run=True) if r.removed]))
    elif args.command == "verify":
        bad = engine.verify_cache().where("status <> 'ok'").orderBy("stem").collect()
        for r in bad:
            print(f"{r.stem}: {r.status}")
        if args.rm:
            for r in engine.remove_failed():
                print(f"removed {Path(r.path).name}" if r.removed else f"could not remove {r.path}: {r.reason}", file=sys.stdout if r.removed else sys.stderr)
        return FAILED if bad else OK
    else:
        if args.command == "prune":
            got = engine.prune_archives(args.dry_run)
        else:
            before = parse_start(args.before) if args.before else None
            got = engine.evict_cache(symbols=[normalize_symbol(s) for s in args.symbol], intervals=[parse_interval(i).name for i in args.interval], before=before, everything=args.all, dry_run=args.dry_run)
        if not got:
            print("no cached archives" if args.command == "prune" else "nothing matched")
            return OK
        for r in got:
            if not r.removed:
                print(f"kept {Path(r.path).name}: {r.reason}", file=sys.stderr)
        gone = [r for r in got if r.removed]
        print(f"{'would free' if args.dry_run else 'freed'} {report.human_bytes(sum(r.freed for r in gone))} in {report.plural(len(gone), 'file')}, kept {len(got) - len(gone)}")
    return OK


#: Names that --interval takes.
INTERVAL_NAMES = tuple(i.name for i in INTERVALS)

if __name__ == "__main__":
    sys.exit(main())
