"""Packing: order-preserving cuts of a token stream into sequences, by dynamic programming.

Documents of a partition are laid end to end in their order, each closed by id 1. Cuts are allowed where a
document ends (free), where a sentence ends (a small penalty) and, inside sentences longer than `stride`
tokens, at every `stride`-th token (a large one). With f(j) = cost(j) + position(j), the cheapest way to end a
sequence at cut i is penalty(i) + length - position(i) + min f(j) over cuts j at most `length` tokens back; a
monotone queue gives that minimum in constant time. The stream is solved in blocks, of which all but the
last two sequences are settled; what is left opens the next block. A partition's last sequence is either
padded or split into powers of two, whichever costs less.

Edge cases: a null or empty text is a document of the closing id alone; a null doc_id stays null; repeated
rows are packed as often as they occur; other columns are ignored; an empty table gives no pieces. A document
longer than a sequence goes on in the next ones.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
CLOSING_ID = 1
SENTENCE_COST, HARD_COST = 2, 12
STRIDE = 32
#: Tokens of a block: far more than a sequence, far less than a worker's memory.
BLOCK_TOKENS = 1 << 19
CACHE_CHUNKS, SHORT_CHUNK = 1_500_000, 8
MARK = "\x00"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_CHUNKS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: How byte-level vocabularies write bytes: printable ones as themselves, the others counted up from 256.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_ENDS = frozenset(".!?")
#: Fixed values of the vocabularies that may be encoded chunk by chunk: normaliser, splitter and merges as their file has them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MERGES = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"}
_tokenizers: dict[tuple[str, bool], Tokenizer] = {}


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers; array is quicker than numpy for a few."""
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


class Tokenizer:
    """Ids of whitespace-free chunks, kept in a bounded cache.

    The vocabulary's normaliser and splitter never join characters over ASCII white space, and drop it, so a
    text's ids are those of its chunks in order.

    With `special`, the names of special tokens in a text are those tokens, as the vocabulary's own tokenizer takes
    them; else they are text like any other. They are found as written, before the normaliser, so a chunk that holds
    one goes whole to that tokenizer, and is cached with a blank before it, apart from a chunk put in lower case.

    All this holds for vocabularies with the NORMALIZER, SPLITTER and MERGES above (`chunked`); with any other, each
    text goes whole to the vocabulary's own tokenizer, without truncation or padding.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer as Own

        self.own = Own.from_file(path)
        self.plain = Own.from_file(path) if special else None
        file = json.loads(self.own.to_str())
        self.chunked = file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == SPLITTER and MERGES.items() <= file["model"].items()
        for t in (self.own, self.plain) if special else (self.own,):
            t.no_truncation()
            t.no_padding()
        added = self.own.get_added_tokens_decoder().values() if special else ()
        if self.chunked and any(t.normalized or t.single_word or not _CHUNKS.fullmatch(t.content) for t in added):
            raise ValueError("added tokens with white space, of single words or of normalised text aren't supported")
        self.names = [t.content for t in added]
        self.own.encode_special_tokens = True
        mark = self.own.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.cache: dict[str, bytes] = {}
        #: By id: whether the token closes a sentence.
        self.ends = np.zeros(max(self.own.get_vocab_size(), CLOSING_ID + 1), dtype=bool)
        for token, i in self.own.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.removesuffix("</w>")[-1:] in _ENDS and (token.endswith("</w>") or not self.chunked)

    @classmethod
    def get(cls, path: str, special: bool = False) -> Tokenizer:
        if (path, special) not in _tokenizers:
            _tokenizers[path, special] = cls(path, special)
        return _tokenizers[path, special]

    def ids(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def chunks_of(self, text: str) -> list[str]:
        """Chunks as keys of the cache."""
        if not any(n in text for n in self.names):
            return chunks_of(text)
        return [f" {c}" if any(n in c for n in self.names) else c for c in _CHUNKS.findall(text)]

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of chunks that aren't cached into the cache.

        The splitter sets letters apart from what follows them and ignores case. So a word of plain Latin letters
        goes to the vocabulary's merges in lower case, and a stop or comma after it brings its own ids.
        """
        cache = self.cache
        if len(cache) > CACHE_CHUNKS:
            # short chunks come again most
            self.cache = cache = {c: v for c, v in cache.items() if len(c) <= SHORT_CHUNK or c in chunks}
            if len(cache) > CACHE_CHUNKS // 2:
                self.cache = cache = {c: cache[c] for c in chunks & cache.keys()}
        merges, others, words = self.own.model.tokenize, [], []
        for c in chunks.difference(cache):
            if c[0] == " ":
                cache[c] = _packed(self.plain.encode(c[1:], add_special_tokens=False).ids)
                continue
            word = c[:-1] if c[-1] in ".," else c
            if (word.isascii() and word.isalpha()) or _WORD(word):
                words.append((c, word))
            else:
                others.append(c)
        self._encode({".", ",", *others}.difference(cache))
        for c, word in words:
            low = word.lower()
            own = cache.get(low)
            if own is None:
                text = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_CHARS)
                own = cache[low] = _packed([t.id for t in merges(text)])
            if word is not c:
                cache[c] = own + cache[c[-1]]
            elif low != c:
                cache[c] = own

    def _encode(self, chunks: set[str]) -> None:
        """Many chunks to a call, a mark between them."""
        new = sorted(chunks)
        joined = [c for c in new if self.mark is not None and MARK not in c]
        for c in new if self.mark is None else (c for c in new if MARK in c):
            self.cache[c] = np.array(self.ids(c), dtype="<u4").tobytes()
        for i in range(0, len(joined), 4096):
            part = joined[i : i + 4096]
            ids = np.array(self.ids(f" {MARK} ".join(part)), dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                raise AssertionError("marks and chunks differ in number")
            raw = ids.tobytes()
            begin = [0, *((cuts + 1) * 4).tolist()]
            end = [*(cuts * 4).tolist(), len(raw)]
            for c, a, b in zip(part, begin, end, strict=True):
                self.cache[c] = raw[a:b]


def chunks_of(text: str) -> list[str]:
    return text.lower().split() if text.isascii() and not _SEPARATORS.search(text) else _CHUNKS.findall(text)


def tokens_of(texts: list[str | None], tokenizer: Tokenizer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: ids with the closing id, and ascending ends (in tokens) of its sentences."""
    if not tokenizer.chunked:
        for t in texts:
            own = (tokenizer.plain or tokenizer.own).encode(t or "", add_special_tokens=False).ids
            ids = np.array([*own, CLOSING_ID], "<u4")
            yield ids, np.flatnonzero(tokenizer.ends[ids]) + 1
        return
    split = [tokenizer.chunks_of(t or "") for t in texts]
    tokenizer.learn(set().union(*split))
    get, close = tokenizer.cache.__getitem__, np.array([CLOSING_ID], "<u4").tobytes()
    for chunks in split:
        ids = np.frombuffer(b"".join(map(get, chunks)) + close, "<u4")
        yield ids, np.flatnonzero(tokenizer.ends[ids]) + 1


def cuts_of(total: int, sentences: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a document of `total` tokens may be cut, its end included, and what each cut costs."""
    soft = sentences[: int(np.searchsorted(sentences, total))]
    at = np.append(soft, total)
    cost = np.append(np.full(len(soft), SENTENCE_COST), 0)
    gaps = np.diff(at, prepend=0)
    extra = (gaps - 1) // stride  # cuts at every stride-th token of a longer gap
    if extra.any():
        hard = np.repeat(at - gaps, extra) + stride * (np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
        at, cost = np.concatenate([at, hard]), np.concatenate([cost, np.full(len(hard), HARD_COST)])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost


def best_cuts(at: list[int], cost: list[int], length: int) -> list[int]:
    """Cheapest cuts that end at the last position; positions ascend from above 0, no gap over `length`."""
    n = len(at)
    back = [-1] * n
    queue = deque([(0, 0, -1)])  # f, position, index: f never falls from front to back
    for i in range(n):
        p = at[i]
        low = p - length
        while queue[0][1] < low:
            queue.popleft()
        best, _, back[i] = queue[0]
        f = best + cost[i] + length  # cost(i) + position(i)
        while queue and queue[-1][0] >= f:
            queue.pop()
        queue.append((f, p, i))
    out, i = [], n - 1
    while i >= 0:
        out.append(at[i])
        i = back[i]
    return out[::-1]


def tail_sizes(left: int, length: int) -> list[int]:
    """Sizes of the sequences that close a partition: one that is padded, or powers of two."""
    if left >= length or left & (left - 1) == 0:
        return [left]
    powers = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    return powers if (len(powers) - 1) * HARD_COST < length - left else [left]


class Packer:
    """Sequences of one partition's documents, in their order."""

    def __init__(self, length: int, stride: int, block: int, first_id: int, with_ids: bool):
        self.length, self.stride, self.block, self.next_id, self.with_ids = length, min(stride, length), max(block, 4 * length), first_id, with_ids
        self.docs: list[tuple] = []  # doc_id, ids, its tokens before this block, position here
        self.at: list[int] = []
        self.cost: list[int] = []
        self.size = 0

    def add(self, doc_id, own: np.ndarray, sentences: np.ndarray) -> Iterator[tuple]:
        at, cost = cuts_of(len(own), sentences, self.stride)
        self.docs.append((doc_id, own, 0, self.size))
        self.at += (at + self.size).tolist()
        self.cost += cost.tolist()
        self.size += len(own)
        if self.size >= self.block:
            yield from self.settle(best_cuts(self.at, self.cost, self.length)[:-2])

    def settle(self, cuts: list[int]) -> Iterator[tuple]:
        """Rows of the sequences that end at `cuts`; the rest becomes the start of the block."""
        begin, k, docs = 0, 0, self.docs
        for end in cuts:
            while k < len(docs) and docs[k][3] + len(docs[k][1]) - docs[k][2] <= begin:
                k += 1
            j = k
            while j < len(docs) and docs[j][3] < end:
                doc_id, ids, before, place = docs[j]
                a = max(begin, place)
                b = min(end, place + len(ids) - before)
                piece = ids[before + a - place : before + b - place]
                yield (doc_id, before + a - place, b - a, zlib.crc32(piece.tobytes()), len(ids), self.next_id, a - begin, *((piece.astype(np.int64),) if self.with_ids else ()))
                j += 1
            self.next_id += 1
            begin = end
        rest = []
        for doc_id, ids, before, place in docs:
            stop = place + len(ids) - before
            if stop > begin:
                skip = max(0, begin - place)
                rest.append((doc_id, ids, before + skip, place + skip - begin))
        first = int(np.searchsorted(self.at, begin, side="right"))
        self.at, self.cost = [p - begin for p in self.at[first:]], self.cost[first:]
        self.docs, self.size = rest, self.size - begin

    def close(self) -> Iterator[tuple]:
        if not self.size:
            return
        cuts = best_cuts(self.at, self.cost, self.length)
        last = cuts[-2] if len(cuts) > 1 else 0
        sizes = tail_sizes(cuts[-1] - last, self.length)
        yield from self.settle([*cuts[:-1], *(last + np.cumsum(sizes)).tolist()])


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, stride: int = STRIDE, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False, special: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence (SCHEMA); with_ids adds ids (array<long>).

    With `special`, names of special tokens in a text count as those tokens, as the library has it by default.
    Sequences never leave their partition, so order holds inside it and nothing is shuffled.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches):
        context = TaskContext.get()
        tokenizer = Tokenizer.get(tokenizer_path, special)
        packer = Packer(length, stride, block_tokens, (context.partitionId() if context else 0) << 40, with_ids)
        rows: list[tuple] = []

        def batch_of():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + ([pa.array(columns[7], pa.list_(pa.int64()))] if with_ids else []), names)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(ids), 256):
                for doc_id, (own, ends) in zip(ids[i : i + 256], tokens_of(texts.slice(i, 256).to_pylist(), tokenizer), strict=True):
                    rows.extend(packer.add(doc_id, own, ends))
                if len(rows) >= 4096:
                    yield batch_of()
        rows.extend(packer.close())
        if rows:
            yield batch_of()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))
