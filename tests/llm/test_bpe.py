import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from tallow.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "it's we'll   tabs\t\n\n  end  ", "x" * 900, " " * 700 + "y", "'" * 300 + "ll", "né 日本語 123 " * 60, "don't " * 200, "ab'" * 150 + "ll" + "\n" * 90 + "z"]
SCHEMA = "doc_id long, text string, ids long, chunk string, row_key int"


def expected(text):
    ids = bpe.Codec.get(RANKS, P.PATTERN).core.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap"), [(32768, 512), (40, 12), (64, 64), (7, 5)])
def test_digests_equal_the_library(spark, chunk, overlap):
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], 1, "x", 2), (None, TEXTS[9], 1, "x", 2)]
    got = bpe.round_trip_digests(spark.createDataFrame(rows, SCHEMA), RANKS, P.PATTERN, chunk, overlap).collect()
    want = sorted((-1 if r[0] is None else r[0], *expected(r[1])) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(TEXTS)], SCHEMA)
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, 50, 10), RANKS, P.PATTERN).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    assert bpe.round_trip_digests(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0
