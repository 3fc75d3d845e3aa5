"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of up to `chunk_chars` characters is one chunk. A longer one is cut into chunks that overlap;
the chunks are spread over the cluster and pre-tokenised on their own. The split pattern never looks
back, so where two neighbouring chunks share a pre-token boundary they agree from there on: the seam is
set at the first such boundary. The pieces between seams are the text's pre-tokens, each encoded by
itself. Where an overlap holds no shared boundary (one run longer than the overlap), the two chunks are
joined and pre-tokenised again from the last certain boundary, so the result is exact for every text.
Decoding concatenates the raw bytes of the ids.

Edge cases: a null text counts as empty and gives no ids; repeated rows each give a row; columns other
than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import row_key

CHUNK_CHARS = 32768
OVERLAP_CHARS = 512
#: Pre-tokens whose ids a Python worker keeps.
CACHE_PIECES = 400_000
#: A piece's end depends on at most three characters after it (a contraction of three, a space before a word).
LOOKAHEAD = 4

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    """Ranks and pattern, with a bounded cache of pre-token -> ids as little-endian 32-bit integers."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("tallow", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.cache: dict[str, bytes] = {}

    @classmethod
    def get(cls, ranks_path: str, pattern: str) -> Codec:
        key = (ranks_path, pattern)
        if key not in _codecs:
            _codecs[key] = cls(ranks_path, pattern)
        return _codecs[key]

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        cache, single = self.cache, self.core._encode_single_piece
        if len(cache) > CACHE_PIECES:
            cache.clear()
        for piece in set(pieces).difference(cache):
            cache[piece] = np.asarray(single(piece.encode()), dtype="<u4").tobytes()
        return list(map(cache.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_pieces(self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def cut_chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, characters) of chunks that cover the text, each but the last running `overlap` into the next."""
    return [(s, text[s : s + chunk + overlap]) for s in range(0, max(len(text), 1), chunk)]


def stitch(chunks: Iterator[tuple[int, str, np.ndarray, list[bytes]]], total: int, codec: Codec) -> Iterator[bytes]:
    """Ids of a whole text, part by part.

    chunks, in order: start, text, absolute ends of the pieces, ids of each piece.
    """
    done = 0  # characters whose ids are out; always a true boundary
    held: tuple[int, str, np.ndarray, list[bytes]] | None = None
    for start, text, ends, ids in chunks:
        if held is not None:
            h_start, h_text, h_ends, h_ids = held
            limit = h_start + len(h_text) - LOOKAHEAD
            sure = h_ends[(h_ends > done) & (h_ends <= limit)]
            shared = np.intersect1d(sure[sure >= start], np.append(ends, start), assume_unique=True)
            if len(shared):
                seam = int(shared[0])
                a, b = np.searchsorted(h_ends, [done, seam], side="right")
                yield b"".join(h_ids[a:b])
                done = seam
            else:
                last = int(sure[-1]) if len(sure) else done
                a, b = np.searchsorted(h_ends, [done, last], side="right")
                yield b"".join(h_ids[a:b])
                done = last
                text = h_text[last - h_start :] + text[h_start + len(h_text) - start :]
                start = last
                pieces = codec.split(text)
                ends = start + np.cumsum([len(p) for p in pieces], dtype=np.int64)
                ids = codec.encode_pieces(pieces)
        held = (start, text, ends, ids)
    if held is not None:
        _, _, h_ends, h_ids = held
        yield b"".join(h_ids[int(np.searchsorted(h_ends, done, side="right")) :])


def digest_row(parts: Iterator[bytes], codec: Codec) -> tuple[int, str, str]:
    ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
    for ids in parts:
        ids_sha.update(ids)
        text_sha.update(codec.decode(ids))
        n += len(ids) // 4
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def _digest_batch(doc_ids: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _ids_row(parts: Iterator[bytes], codec: Codec) -> tuple[list[int]]:
    return (np.frombuffer(b"".join(parts), "<u4").tolist(),)


def _ids_batch(doc_ids: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])


def _run(docs: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int, schema: str, row: Callable, batch_of: Callable) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def short(batches):
        codec = Codec.get(ranks_path, pattern)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(ids), 256):
                rows = [row(iter((codec.encode(t or ""),)), codec) for t in texts.slice(i, 256).to_pylist()]
                yield batch_of(ids[i : i + 256], rows)

    cut_schema = "row_key binary, doc_id long, chunk int, start long, total long, text string"

    def spread(batches):
        for batch in batches:
            for key, doc, text in zip(batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                whole = text.as_py()
                for k, (start, part) in enumerate(cut_chunks(whole, chunk, overlap)):
                    yield pa.RecordBatch.from_pylist([{"row_key": key, "doc_id": doc, "chunk": k, "start": start, "total": len(whole), "text": part}], schema=_CUT)

    def encode_chunks(batches):
        codec = Codec.get(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                ends, counts, ids = [], [], []
                for text, start in zip(part.column("text").to_pylist(), part.column("start").to_pylist(), strict=True):
                    pieces = codec.split(text)
                    coded = codec.encode_pieces(pieces)
                    ends.append((start + np.cumsum([len(p) for p in pieces], dtype="<i8")).tobytes())
                    counts.append(np.array([len(c) // 4 for c in coded], dtype="<i4").tobytes())
                    ids.append(b"".join(coded))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ends, pa.binary()), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], [*part.schema.names, "ends", "counts", "ids"])

    def join_chunks(batches):
        codec = Codec.get(ranks_path, pattern)

        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}

        def one(first, more):
            """Chunks of one text; equal rows of the table come as repeated chunks."""
            yield first
            seen = first["chunk"]
            for r in more:
                if r["row_key"] != first["row_key"]:
                    spare.append(r)
                    return
                if r["chunk"] != seen:
                    seen = r["chunk"]
                    yield r
                elif seen == 0:
                    copies[0] += 1

        stream, spare, copies = rows(), [], [1]
        first = next(stream, None)
        while first is not None:
            spare.clear()
            copies[0] = 1

            def parsed(first=first):
                for r in one(first, stream):
                    sizes = np.cumsum(np.frombuffer(r["counts"], "<i4"), dtype=np.int64) * 4
                    cuts = [0, *sizes.tolist()]
                    yield r["start"], r["text"], np.frombuffer(r["ends"], "<i8"), [r["ids"][a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

            out = row(stitch(parsed(), first["total"], codec), codec)
            yield batch_of([first["doc_id"]] * copies[0], [out] * copies[0])
            first = spare[0] if spare else None

    size = F.coalesce(F.length("text"), F.lit(0))
    short_out = docs.where(size <= chunk).mapInArrow(short, schema)
    long_out = (
        docs.where(size > chunk)
        .withColumn("row_key", row_key("doc_id", "text"))
        .mapInArrow(spread, cut_schema)
        .repartition("row_key", "chunk")
        .mapInArrow(encode_chunks, cut_schema + ", ends binary, counts binary, ids binary")
        .repartition("row_key")
        .sortWithinPartitions("row_key", "chunk")
        .mapInArrow(join_chunks, schema)
    )
    return short_out.unionByName(long_out)


_CUT = pa.schema([("row_key", pa.binary()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("start", pa.int64()), ("total", pa.int64()), ("text", pa.string())])


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""
    return _run(docs, ranks_path, pattern, chunk_chars, overlap_chars, "doc_id long, ids array<int>", _ids_row, _ids_batch)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and text of every list of ids; bytes that are not UTF-8 become replacement characters."""

    def run(batches):
        codec = Codec.get(ranks_path, pattern)
        for batch in batches:
            texts = [codec.decode(np.asarray(ids or [], "<u4").tobytes()).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Per document: doc_id, n_tokens, SHA-256 of the ids and of the bytes decoded from them."""
    return _run(docs, ranks_path, pattern, chunk_chars, overlap_chars, DIGESTS, digest_row, _digest_batch)
