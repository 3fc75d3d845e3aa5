import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallow.llm import packing

PATH = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start long, ids string"


def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check(rows, docs, length):
    """Pieces tile every document and every sequence, and carry the right ids."""
    t = plain()
    want = [t.encode(text or "", add_special_tokens=False).ids + [1] for _, text in docs]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in rows) == sum(map(len, want))
    for (doc_id, _), ids in zip(docs, want, strict=True):
        own = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        for r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) <= length
    return by_seq


def test_pieces_tile_everything(spark):
    rng = np.random.default_rng(2)
    words = ["the", "naïve", "Word", "don't", "3.14", "end.", "ok!", "ÀÉ", "日本語", "x\x00y", "a\x1cb", "<|endoftext|>", "Σας", "ΑΣ.", "Abc,", "ab.c.", "I'LL,"]
    docs = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(0, 400, 60))]
    docs += [(90, None), (91, ""), (92, "q" * 5000), (93, "no sentence ends here " * 2000), (94, "   x　y\n")]
    df = spark.createDataFrame([(a, b, 7, "x") for a, b in docs], SCHEMA).repartition(3)
    rows = packing.pack(df, PATH, length=256, block_tokens=2048).collect()
    by_seq = check(rows, docs, 256)
    padded = sum(256 - n for n in (sum(r.length for r in s) for s in by_seq.values()) if n & (n - 1))
    assert padded < 0.08 * sum(r.length for r in rows)
    assert packing.pack(df.limit(0), PATH).count() == 0
    with_ids = packing.pack(df, PATH, length=256, block_tokens=2048, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in with_ids)


def test_repeated_rows_and_null_ids(spark):
    rows = packing.pack(spark.createDataFrame([(1, "same text.", 0, "")] * 3 + [(None, "t", 0, "")], SCHEMA), PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 3 * next(r.doc_tokens for r in rows if r.doc_id == 1)
    assert sum(r.offset == 0 for r in rows) == len({r.sequence_id for r in rows})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 7), st.integers(0, 9)), min_size=1, max_size=12), st.integers(7, 15))
def test_cuts_are_the_cheapest(steps, length):
    at = np.cumsum([s for s, _ in steps]).tolist()
    cost = [c for _, c in steps]

    def price(cuts):
        return sum(length - (b - a) for a, b in pairwise([0, *cuts])) + sum(cost[at.index(c)] for c in cuts)

    best = min(
        price([*(a for k, a in enumerate(at[:-1]) if mask >> k & 1), at[-1]])
        for mask in range(1 << (len(at) - 1))
        if all(b - a <= length for a, b in pairwise([0, *(a for k, a in enumerate(at[:-1]) if mask >> k & 1), at[-1]]))
    )
    cuts = packing.best_cuts(at, cost, length)
    assert cuts[-1] == at[-1] and all(b - a <= length for a, b in pairwise([0, *cuts]))
    assert price(cuts) == best


@pytest.mark.parametrize("left", [1, 3, 700, 1024, 2047, 2048])
def test_tail(left):
    assert sum(packing.tail_sizes(left, 2048)) == left


def test_queries_take_special_tokens_as_the_library(spark, tmp_path):
    import corpus_pipeline
    from tallow.llm import registry

    t = Tokenizer.from_file(PATH)
    texts = [
        "hello <|endoftext|> you", "a<|endoftext|>b, C<|startoftext|><|endoftext|>.", "<|ENDOFTEXT|> is <|EndOfText|>", "<|endoftext|> and <|ENDOFTEXT|> Word. word.",
        "naïve ÀÉ<|startoftext|>É x\x00<|endoftext|>y", "a\x1cb<|endoftext|>\x1fz", "no <|endoftext| > here", "<|endoftext|>", None, "plain words only.",
    ]
    want = {i: t.encode(text or "", add_special_tokens=False).ids + [1] for i, text in enumerate(texts)}
    assert want[0] == [3306, 49407, 592, 1] and 49407 not in want[2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (registry.op1_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        rows = got.collect()
        assert {r.doc_id for r in rows} == set(want)
        for r in rows:
            ids = want[r.doc_id]
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert {r.doc_id: r.ids for r in packing.pack(docs, PATH, with_ids=True, special=True).collect() if r.length == r.doc_tokens}.items() <= want.items()


@pytest.mark.parametrize("special", [False, True])
def test_a_vocabulary_with_another_normaliser(special):
    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not special
    texts = ["Hello  World. It's two\n\nlines!", None, "", "<|endoftext|> in a text", "Ünïcode ÅNGSTRÖM 123"]
    own = packing.Tokenizer.get(path, special)
    assert not own.chunked and packing.Tokenizer.get(PATH, special).chunked
    for text, (ids, ends) in zip(texts, packing.tokens_of(texts, own), strict=True):
        assert ids.tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        assert all(0 < e <= len(ids) for e in ends.tolist())
