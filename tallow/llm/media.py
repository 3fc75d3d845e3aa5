"""Media columns: payloads stored as lossless WebP images and read back as pixel arrays.

`store` writes each payload as grey 8-bit samples in rows of 64, one image per 256 rows, the images back to
back in one binary column. `read_pixels` decodes any lossless WebP column to pixel arrays, a row for each image.

Edge cases: a null text counts as empty, which is one row of 64 zero bytes; a null media value gives null
pixels; repeated rows each give a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm import webp
from tallow.llm.common import text_bytes, text_slices

BLOCK = 64


def payload_of(text: bytes) -> bytes:
    """The text's bytes, zero-filled to a positive multiple of BLOCK."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def write_media(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8)
    return b"".join(webp.encode_grey(samples[i : i + webp.TILE]) for i in range(0, len(samples), webp.TILE))


def images_of(media: bytes) -> list[bytes]:
    """VP8L chunks of images that stand back to back."""
    out, at = [], 0
    while at < len(media):
        at, chunk = webp.read_header(media, at)
        out.append(chunk)
    return out


def read_media(medias: list[bytes]) -> list[np.ndarray]:
    """Samples of each media value."""
    chunks = [images_of(m) for m in medias]
    flat = webp.decode_grey([c for own in chunks for c in own])
    out, at = [], 0
    for own in chunks:
        out.append(np.concatenate(flat[at : at + len(own)]) if len(own) != 1 else flat[at])
        at += len(own)
    return out


def _payloads(batch: pa.RecordBatch) -> tuple[list[int], list[bytes]]:
    raw, offs = text_bytes(batch.column("text"))
    whole = raw.tobytes()
    cuts = offs.tolist()
    return np.diff(offs).tolist(), [payload_of(whole[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary) of every text."""

    def run(batches):
        for batch in text_slices(batches):
            sizes, payloads = _payloads(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([write_media(p) for p in payloads], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_pixels(df: DataFrame, column: str = "media") -> DataFrame:
    """Every image of each value: its index, width, height, and pixels as ARGB integers row by row.

    A value without images, null or empty, is one row of nulls.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("image", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, own = batch.column("doc_id")[i].as_py(), batch.column("media")[i].as_py()
                if not own:
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id}], schema=schema)
                    continue
                for n, chunk in enumerate(images_of(own)):
                    px = webp.decode(chunk)
                    row = {"doc_id": doc_id, "image": n, "width": px.shape[1], "height": px.shape[0], "pixels": px.ravel().astype(np.int64).tolist()}
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("media")).mapInArrow(run, "doc_id long, image int, width int, height int, pixels array<long>")


def feature_of(samples: np.ndarray) -> str:
    """Rows, distinct values, mean, deviation and mean step between neighbours, from the samples as read."""
    counts = np.bincount(samples, minlength=256).astype(np.int64)
    levels, n = np.arange(256), len(samples)
    total = int((counts * levels).sum())
    square = int((counts * levels * levels).sum())
    step = int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64))
    spread = (n * square - total * total) / (n * n)
    return f"rows={n // BLOCK};values={int((counts > 0).sum())};mean={total / n:.4f};variance={spread:.4f};step={step / max(1, n - 1):.4f}"


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def round_trip_digests(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back, and describe both: see DIGESTS."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def run(batches):
        for batch in text_slices(batches):
            sizes, payloads = _payloads(batch)
            medias = [write_media(p) for p in payloads]
            back = read_media(medias)
            raw = [s.tobytes() for s in back]
            columns = [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array([len(b) for b in raw], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in raw], pa.string()),
                pa.array([zlib.crc32(b[-BLOCK:]) for b in raw], pa.int64()),
                pa.array([len(m) for m in medias], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in medias], pa.string()),
                pa.array([feature_of(s) for s in back], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS)
