"""The two-tier store: archives with checksum sidecars, and candles decoded from them as stamped Parquet.

<root>/<market>/klines/<SYMBOL>/<interval>/<monthly|daily>/<stem>{.zip,.zip.CHECKSUM,.parquet}

A Parquet file counts only if its footer names its source's checksum, the current codec and its own row count, and
its columns are the candle's. The root must be a folder that all executors share.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.model import CANDLE_SCHEMA, ChecksumError, CorruptArchiveError, Interval, InvalidRequestError, Kind
from tallow.operators import inventory
from tallow.sources import archive
from tallow.sources.listing import archive_prefix, archive_stem
from tallow.sources.sinks import ARROW, CODEC_VERSION, STAMP_CODEC, STAMP_FILE, STAMP_ROWS, STAMP_SHA, parquet_batches, publish

SIDECAR_BYTES = 4096
_SIDECAR = re.compile(r"([0-9a-fA-F]{64})(?:[ \t]+\*?(\S+))?\s*")


def parse_checksum(text: str, name: str) -> str:
    """The SHA-256 of a sidecar's first line; the file it names must be `name`."""
    if len(text) > SIDECAR_BYTES:
        raise CorruptArchiveError("a checksum file is too large")
    m = _SIDECAR.fullmatch(text.split("\n", 1)[0])
    if not m or (m[2] and m[2] != name):
        raise CorruptArchiveError(f"not the checksum of {name}: {text[:80]!r}")
    return m[1].lower()


def format_checksum(sha: str, name: str) -> str:
    return f"{sha}  {name}"


@dataclass(frozen=True)
class Entry:
    """Paths of one archive's three files."""

    folder: Path
    stem: str

    @property
    def zip(self) -> Path:
        return self.folder / f"{self.stem}.zip"

    @property
    def sidecar(self) -> Path:
        return self.folder / f"{self.stem}.zip.CHECKSUM"

    @property
    def parquet(self) -> Path:
        return self.folder / f"{self.stem}.parquet"


def entry(root: str, symbol: str, interval: Interval, kind: Kind, start, market: str = "spot") -> Entry:
    return Entry(Path(root) / market / "klines" / symbol / interval.name / kind.value, archive_stem(symbol, interval, kind, start))


def gate(path: Path, sha: str, name: str) -> int:
    """Rows of a Parquet file that is what its sidecar says; CorruptArchiveError otherwise."""
    try:
        f = pq.ParquetFile(path)
    except Exception as e:
        raise CorruptArchiveError(f"{path.name}: {e}") from None
    with f:
        meta = f.metadata.metadata or {}
        wanted = {STAMP_SHA: sha.encode(), STAMP_FILE: name.encode(), STAMP_CODEC: str(CODEC_VERSION).encode(), STAMP_ROWS: str(f.metadata.num_rows).encode()}
        wrong = [k.decode() for k, v in wanted.items() if meta.get(k) != v]
        if wrong:
            raise CorruptArchiveError(f"{path.name}: stale or foreign: {', '.join(wrong)}")
        own = f.schema_arrow
        if own.names != ARROW.names or [t.type for t in own] != [t.type for t in ARROW]:
            raise CorruptArchiveError(f"{path.name}: its columns are not a candle's")
        return f.metadata.num_rows


#: Writes an object to a file and gives its SHA-256.
Save = Callable[[str, BinaryIO], str]


def ensure(e: Entry, key: str, fetch: Callable[[str], bytes], save: Save | None = None) -> str:
    """The archive and its sidecar on disk, verified when downloaded; its SHA-256. `save` takes the archive without holding it."""

    def download(f: BinaryIO) -> int:
        if save is not None:
            got = save(key, f)
        else:
            content = fetch(key)
            got = hashlib.sha256(content).hexdigest()
            f.write(content)
        if got != sha:
            raise ChecksumError(f"{e.zip.name} is not what its checksum says")
        return f.tell()

    if e.sidecar.exists():
        sha = parse_checksum(e.sidecar.read_text(), e.zip.name)
        if e.zip.exists():
            return sha
    e.folder.mkdir(parents=True, exist_ok=True)
    text = fetch(key + ".CHECKSUM").decode("ascii", "replace")
    sha = parse_checksum(text, e.zip.name)
    publish(e.zip, download)
    publish(e.sidecar, lambda f: f.write(format_checksum(sha, e.zip.name).encode()))
    return sha


def _sha_of(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def build(e: Entry, key: str, spec: archive.Spec, fetch: Callable[[str], bytes], save: Save | None = None) -> int:
    """Rows of the archive's Parquet file, made from the archive where it is missing or stale.

    On a hit neither the archive is opened nor anything hashed.
    """
    if e.sidecar.exists() and e.parquet.exists():
        try:
            return gate(e.parquet, parse_checksum(e.sidecar.read_text(), e.zip.name), e.zip.name)
        except CorruptArchiveError:
            pass
    sha = ensure(e, key, fetch, save)
    if _sha_of(e.zip) != sha:
        e.zip.unlink()
        sha = ensure(e, key, fetch, save)
    stamp = {STAMP_SHA: sha.encode(), STAMP_FILE: e.zip.name.encode()}
    return publish(e.parquet, lambda f: parquet_batches(archive.decode_batches(e.zip, spec), f, stamp))


def key_of(symbol: str, interval: Interval, kind: Kind, start, market: str = "spot") -> str:
    return archive_prefix(symbol, interval, kind, market) + archive_stem(symbol, interval, kind, start) + ".zip"


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Candles of tier-2 files; pages are checked against their checksums, which Spark leaves off by itself."""
    return spark.read.schema(CANDLE_SCHEMA).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)


# -- maintenance ----------------------------------------------------------------------------------------


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), full, length of every file; a missing root is an empty store. Contents are not read."""
    if not Path(root).exists():
        return spark.createDataFrame([], "path string, full string, length long")
    if not any(p.is_file() for p in Path(root).rglob("*")):
        return spark.createDataFrame([], "path string, full string, length long")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace("path", "^file:/*", "/")
    return df.select(F.substring(full, len(str(Path(root).resolve())) + 2, 1 << 20).alias("path"), full.alias("full"), "length")


def usage(spark: SparkSession, root: str) -> DataFrame:
    return inventory.usage(files(spark, root))


def verify(spark: SparkSession, root: str) -> DataFrame:
    """stem, full, status of every archive: hashes are taken on the executors."""
    own = files(spark, root).where(F.col("path").endswith(".zip")).select("full")
    if own.isEmpty():
        return spark.createDataFrame([], "stem string, full string, status string")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root)
    archives = content.select(F.regexp_replace("path", "^file:/*", "/").alias("stem"), "content")
    sums = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.CHECKSUM").text(root)
    sidecars = sums.select(F.regexp_replace(F.regexp_replace(F.input_file_name(), "^file:/*", "/"), r"\.CHECKSUM$", "").alias("stem"), F.regexp_extract("value", r"^([0-9a-fA-F]{64})", 1).alias("wanted"))
    return inventory.verified(archives, sidecars).select(F.regexp_extract("stem", r"([^/]+)\.zip$", 1).alias("stem"), F.col("stem").alias("full"), "status")


@dataclass(frozen=True)
class Removal:
    path: str
    freed: int
    removed: bool
    reason: str = ""


def _in_tasks(df: DataFrame, one: Callable[[str, int], tuple[int, bool, str]]) -> list[Removal]:
    """one(full, length) -> (freed, removed, reason) for every file, on the executors; rows of df have full and length."""

    def run(batches):
        for batch in batches:
            rows = [(p, *one(p, n)) for p, n in zip(batch.column("full").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.bool_(), pa.string())], ["path", "freed", "removed", "reason"])

    found = df.select("full", "length").repartition(df.sparkSession.sparkContext.defaultParallelism, "full").mapInArrow(run, "path string, freed long, removed boolean, reason string")
    return sorted((Removal(r.path, r.freed, r.removed, r.reason) for r in found.collect()), key=lambda r: r.path)


def _unlink(path: str, length: int) -> tuple[int, bool, str]:
    try:
        Path(path).unlink(missing_ok=True)  # a task that is run again finds it gone
    except OSError as why:
        return 0, False, str(why)
    return length, True, ""


def prune(spark: SparkSession, root: str, dry_run: bool = False) -> list[Removal]:
    """Delete archives whose Parquet file passes the gate; the others stay, with the reason."""

    def one(full: str, length: int) -> tuple[int, bool, str]:
        path = Path(full)
        e = Entry(path.parent, path.name.removesuffix(".zip"))
        try:
            if not e.sidecar.exists():
                raise CorruptArchiveError("it has no sidecar")
            gate(e.parquet, parse_checksum(e.sidecar.read_text(), e.zip.name), e.zip.name)
        except CorruptArchiveError as why:
            return 0, False, str(why)
        return (length, True, "") if dry_run else _unlink(full, length)

    return _in_tasks(files(spark, root).where(F.col("path").endswith(".zip")), one)


def evict(spark: SparkSession, root: str, symbols=(), intervals=(), before=None, everything: bool = False, dry_run: bool = False) -> list[Removal]:
    """Delete entries by selectors (or all); foreign files stay, emptied folders go."""
    if bool(symbols or intervals or before is not None) == everything:
        raise InvalidRequestError("give selectors or everything, not both and not neither")
    chosen = inventory.selected(inventory.parsed(files(spark, root)), symbols, intervals, before)
    out = _in_tasks(chosen, lambda full, length: (length, True, "") if dry_run else _unlink(full, length))
    top = Path(root).resolve()
    for folder in sorted({p for r in out if not dry_run for p in Path(r.path).parents if top in p.parents}, reverse=True):
        if folder.is_dir() and not any(folder.iterdir()):
            folder.rmdir()
    return out


def remove_failed(spark: SparkSession, root: str) -> list[Removal]:
    """Delete archives that are damaged or without a sidecar, and their sidecars; their Parquet files stay valid."""
    bad = verify(spark, root).where(inventory.removable(F.col("status"))).select(F.explode(F.array("full", F.concat("full", F.lit(".CHECKSUM")))).alias("full"))
    return _in_tasks(bad.join(files(spark, root).select("full", "length"), "full"), _unlink)
