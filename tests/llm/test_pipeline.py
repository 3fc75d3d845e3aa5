import numpy as np
import pytest

import corpus_pipeline as p
from tallow.llm import jaccard, pii


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    """Documents with toxic ones, copies, near copies, repeated lines and personal data."""
    rng = np.random.default_rng(4)
    vocab = [a + b + c for a in ("ba", "do", "ki", "lu") for b in ("", "ner", "tis", "wo") for c in ("ra", "sel", "um", "fin")]

    def prose(n):
        w = [str(x) for x in rng.choice(vocab, n)]
        return "\n".join(" ".join(w[i : i + 12]).capitalize() + "." for i in range(0, n, 12))

    rows, labels = [], []
    for i in range(160):
        text = prose(int(rng.integers(60, 200)))
        toxic = i % 8 == 3
        if toxic:
            w = text.split(" ")
            for k in rng.integers(0, len(w), 6):
                w[int(k)] = "you " + str(rng.choice(["idiot", "moron", "scum"]))
            text = " ".join(w)
        if i % 3 == 0:
            text += f"\nPage {i} of this site is no. {i * 7} in the list."
        if i % 5 == 0:
            text += f"\nmail bob.{i % 10}@example.com or +1 (017) 555-{1000 + i % 10}"
        rows.append((i, text, "en", f"src{i % 2}", len(text)))
        labels.append((i, 1, int(toxic)))
    base = rows[1][1]
    for i in range(12):
        text = base if i % 2 else base + f" tail{'abcdefghijkl'[i]}"
        rows.append((500 + i, text, "en", "src0", len(text)))
    rows += [(600, None, "en", "src0", None), (601, "", None, None, 0), (None, base, "en", "x", 5), (602, "Solo", "en", "x", 4), (602, "Solo", "en", "x", 4)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = docs.columns
    clean = p.drop_toxic(spark, docs, corpus)
    assert clean.columns == names
    ids = {r.doc_id for r in clean.collect()}
    assert not ids & set(range(3, 160, 8))
    assert len(ids & {i for i in range(160) if i % 8 != 3}) >= 138 and {500, 600, 601, 602, None} <= ids

    lines = p.drop_lines(spark, clean, corpus)
    assert lines.columns == names
    texts = {r.doc_id: r.text for r in lines.collect() if r.doc_id is not None}
    assert not any("of this site" in (t or "") for t in texts.values())
    assert texts[501] == {r.doc_id: r.text for r in clean.collect()}[501] and texts[600] is None

    single = p.drop_near_duplicates(spark, lines, corpus)
    assert single.columns == names
    left = [r.doc_id for r in single.collect()]
    assert sorted(x for x in left if x is not None and x >= 500) == [600, 601, 602] and 1 in left and None in left
    assert len(set(left)) == len(left)
    want = {r.component_id for r in jaccard.join(lines, 5, 80).where("n_shingles > 0").collect()}
    assert want == set(left) - {600, 601, None}

    hidden = p.hide_personal_data(spark, single, corpus)
    assert hidden.columns == names
    own = pii.Pseudonyms()
    before = {r.doc_id: r.text for r in single.collect()}
    for r in hidden.collect():
        assert r.text == (own.apply(before[r.doc_id])[0] if before[r.doc_id] is not None else None)
        assert "bob." not in (r.text or "") and "555-" not in (r.text or "") or r.text != before[r.doc_id]
        assert r.n_chars == (len(r.text) if r.text is not None else None)

    pieces = p.pack_sequences(spark, hidden, corpus).collect()
    assert {x.doc_id for x in pieces} == set(left)
    for d in set(left):
        own = sorted((x.start, x.length, x.doc_tokens) for x in pieces if x.doc_id == d)
        assert [a for a, _, _ in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]


def test_run_equals_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, corpus)
    tokens = {(r.doc_id, r.doc_tokens) for r in docs.collect()}
    assert {(r.doc_id, r.doc_tokens) for r in p.run(spark, corpus).collect()} == tokens
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "pii", "packing"] and p.ORACLE_SQL is None


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string, region int"
    for name, rows in (("none", []), ("few", [(1, "a b c d e f", "en", "s", 11, "x", "y", 3), (None, None, None, None, None, None, None, None)])):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)][: len(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, path)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")] and docs.count() == len(rows)
        assert {x.doc_id for x in p.run(spark, path).collect()} == {r[0] for r in rows}


def test_copies_without_a_doc_id(spark):
    text = "one two three four five six seven"
    rows = [(None, text, "en", "s", 3)] * 4 + [(None, None, "en", "s", 0), (None, " ", "en", "s", 1), (7, text, "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or -1, r.text or "") for r in p.drop_near_duplicates(spark, docs, "").collect())
    assert got == [(-1, ""), (-1, " "), (-1, text), (7, text)]
