"""Shared helpers: table access, shared-folder cuts, Arrow batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step works on at a time; longer single texts go alone, whole.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or (tests only) one set here."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        found = tempfile.mkdtemp(prefix="tallow-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` once to the shared folder and read it back; the files go when the driver's JVM ends.

    Unlike checkpoint() this computes the plan once and stores columns, so later readers prune.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a `cut` that nothing reads any more."""
    for name in df.inputFiles()[:1]:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if folder.getName().startswith("tallow-"):
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Keys that hold more than this share of all rows are few by arithmetic, and may be broadcast.
HEAVY = 512


def semi_join(rows: DataFrame, keys: DataFrame, key: str, total: int) -> DataFrame:
    """Rows whose key is among keys (key, n: rows with that key), where a key may have a large share of all `total` rows.

    Less than HEAVY keys have more than 1 / HEAVY of the rows. These are broadcast, and their rows stay where they are;
    of the others no key has enough rows to fill a task.
    """
    heavy = F.broadcast(keys.where(F.col("n") * HEAVY > total).select(key))
    light = rows.join(heavy, key, "left_anti").join(keys.where(F.col("n") * HEAVY <= total).select(key), key, "left_semi")
    return rows.join(heavy, key, "left_semi").select(*rows.columns).unionByName(light.select(*rows.columns))


def row_key(*cols: str | Column) -> Column:
    """128-bit key of a row's values; equal rows share it, and null differs from every value."""
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string") if isinstance(c, str) else c.cast("string")), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\x00", *texts)))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `size` bytes of text each; a longer text is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(byte_lengths(batch.column(column)), dtype=np.int64)
        i = 0
        while i < n:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(i, j - i)
            i = j


def byte_lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column back to back as uint8, and the n + 1 offsets; null counts as empty."""
    import pyarrow.compute as pc

    blob = pc.fill_null(col, "").cast(pa.large_binary())
    if isinstance(blob, pa.ChunkedArray):
        blob = blob.combine_chunks()
    _, offs, data = blob.buffers()
    offsets = np.frombuffer(offs, np.int64, len(blob) + 1, blob.offset * 8)
    start, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, end - start, start) if data is not None and end > start else np.zeros(0, np.uint8)
    return raw, offsets - start


def le_u32(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()
