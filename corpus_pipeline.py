"""A corpus from raw documents to packed sequences: five stages, each an operator of tallow.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of `documents`. Where a stage changes the text, n_chars follows it.

Rows with a null doc_id can't be told apart by a join: of equal texts among them one stays, but they are not dropped
as near duplicates of others. Repeated rows of one doc_id and text count as one document there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm import jaccard, lines, packing, pii, toxicity
from tallow.llm.common import cut, table

TOKENIZER = "word_bpe_49k.json"
#: Near duplicates: shingles of five words, similarity of at least 0.8.
WORDS, PERCENT = 5, 80
#: Labels of this share of documents stay unused, for measuring.
USABLE = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) <> 2"


def _as_before(docs: DataFrame, new: DataFrame) -> DataFrame:
    """The columns of docs from new, n_chars being the new text's length."""
    return new.select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), usable=USABLE)
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_before(docs, lines.drop_recurring(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = cut(jaccard.join(docs, WORDS, PERCENT).select("doc_id", "n_shingles", "component_id"), "classes")
    stays = found.where("doc_id IS NOT NULL AND (n_shingles = 0 OR doc_id = component_id)").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(stays.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
    if not found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    nameless = docs.where("doc_id IS NULL")
    wordless = F.coalesce(F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")), F.lit("")) == ""
    return kept.unionByName(nameless.where(wordless)).unionByName(nameless.where(~wordless).dropDuplicates(["text"]))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_before(docs, pii.pseudonymise(docs, counts=False))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), special=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express trees, permutations of formats or tokenizers; tests/llm/test_pipeline.py checks the stages by other means.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
