"""Line dedup by a log-template tree, in DataFrame operations only.

Every line becomes a template: runs of blanks become one space, and tokens with a digit or an @ become <*>.
The tree has a fixed depth: the root splits by the number of tokens, the next levels by the leading LEAD
tokens of the template; a leaf holds the templates that agree in these. Inside a leaf, templates are grouped by
what they agree in behind the lead: those with the same first half of it differ in the second, those with the
same second half in the first. Such a group is one template with a variable field, and a line has both its groups;
a line too short to have halves is a template as it is, and so is a paragraph, whose small changes are edits and not
fields. A template recurs if it stands in min_docs different
documents, and lines of recurring templates are dropped wherever they stand. A line that differs in both halves
makes other groups and changes nothing for this one.

Copies of a document shall not count as different documents, or near-duplicates would lose their text here.
So a line's document is known by its longest other line, and recurrence counts those, over all lines of the
template; they must also be min_share of its lines.

Edge cases: a null text stays null, an empty one empty; lines of fewer than min_tokens tokens stay; repeated
rows count once and each give a row; of a text's longest lines the greatest in byte order counts; all other columns
pass through, but the table's own n_lines and n_dropped give way to the new ones; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import cut, semi_join

MIN_DOCS = 5
MIN_SHARE = 0.2
MIN_TOKENS = 3
LEAD = 3
#: Fewest tokens of a line that has two halves behind the lead, and most tokens of a line that may have fields.
GENERAL_TOKENS, MOST_TOKENS = LEAD + 2, 32
#: Recurring templates, 8 bytes each, that are broadcast at most; more are joined by a shuffle.
BROADCAST = 500_000

#: Working columns beside the table's own.
KEY, GONE = "tallow_key_of_text", "tallow_gone_lines"

_TEMPLATE = r"regexp_replace(trim(regexp_replace(l, '[ \\t\\r\\x0B\\f]+', ' ')), '(?<![^ ])[^ 0-9@]*[0-9@][^ ]*', '<*>')"


def _text_key(column: str) -> Column:
    return F.unhex(F.md5(F.col(column).cast("binary")))


def templates(docs: DataFrame, column: str = "text") -> DataFrame:
    """One row per distinct text: text_key, its lines in order (hash, n tokens, hashes of their templates), and hashes of its two longest."""
    texts = docs.select(F.col(f"`{column}`").alias("text")).where("text IS NOT NULL AND text <> ''")
    parts = texts.select(_text_key("text").alias("text_key"), F.expr(f"transform(split(text, '\\n', -1), l -> {_TEMPLATE})").alias("t"))
    half = f"cast(ceil((size(w) - {LEAD}) / 2.0) as int)"
    first = f"xxhash64('first', size(w), slice(w, 1, {LEAD} + {half}))"
    second = f"xxhash64('second', size(w), slice(w, 1, {LEAD}), slice(w, {LEAD + 1} + {half}, size(w)))"
    line = f"""transform(t, x -> transform(array(split(x, ' ')), w -> named_struct(
        'line', xxhash64(x), 'n', size(w), 'keys', if(size(w) between {GENERAL_TOKENS} and {MOST_TOKENS}, array({first}, {second}), array(xxhash64(x)))))[0])"""
    longest = "array_max(transform({}, x -> struct(length(x) AS n, x AS x))).x"
    return (
        parts.withColumn("first", F.expr(longest.format("filter(t, x -> x <> '')")))
        .withColumn("second", F.expr(longest.format("filter(t, x -> x <> '' AND x <> first)")))
        .select("text_key", F.expr(line).alias("lines"), F.expr("xxhash64(first)").alias("first"), F.expr("if(second IS NULL, cast(null as bigint), xxhash64(second))").alias("second"))
        .dropDuplicates(["text_key"])
    )


def recurring(parsed: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """key (of a template) and n (lines) of the templates that recur."""
    each = (
        parsed.select("first", "second", F.explode(F.array_distinct("lines")).alias("l"))
        .where(F.col("l.n") >= min_tokens)
        .select(F.explode("l.keys").alias("key"), F.expr("if(l.line = first, second, first)").alias("other"))
    )
    # a common line is counted in every task before anything moves
    counted = each.groupBy("key", "other").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count("other").alias("n_others"))
    return counted.where((F.col("n_others") >= min_docs) & (F.col("n_others") >= min_share * F.col("n"))).select("key", "n")


def drop_recurring(docs: DataFrame, column: str = "text", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """docs with the lines of recurring templates taken out of `column`, and n_lines and n_dropped (int)."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    parsed = cut(templates(docs, column), "templates")
    found = cut(recurring(parsed, min_docs, min_share, min_tokens), "recurring")
    lines = parsed.select("text_key", F.posexplode("lines").alias("at", "l")).where(F.col("l.n") >= min_tokens).select("text_key", "at", F.explode("l.keys").alias("key"))
    if found.count() <= BROADCAST:
        gone = lines.join(F.broadcast(found.select("key")), "key", "left_semi")
    else:
        gone = semi_join(lines, found, "key", lines.count())
    gone = gone.groupBy("text_key").agg(F.collect_set("at").alias(GONE)).withColumnRenamed("text_key", KEY)
    # texts without lines have keys of their own, longer than any text's, that spread them
    alone = F.concat(F.lit("text without lines ").cast("binary"), F.monotonically_increasing_id().cast("string").cast("binary"))
    key = F.when(F.coalesce(F.col(f"`{column}`"), F.lit("")) == "", alone).otherwise(_text_key(f"`{column}`"))
    own = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(KEY, key)
    # a text's lines to drop are few small rows; hashing them spares a sort of the texts
    joined = own.join(gone.hint("shuffle_hash"), KEY, "left")
    parts = f"split(`{column}`, '\\n', -1)"
    text = F.expr(f"if({GONE} IS NULL, `{column}`, array_join(transform(array_except(sequence(0, size({parts}) - 1), {GONE}), i -> {parts}[i]), '\\n'))")
    n_lines = F.expr(f"if(coalesce(`{column}`, '') = '', 0, length(`{column}`) - length(replace(`{column}`, '\\n', '')) + 1)")
    return joined.select(
        *[text.alias(c) if c == column else F.col(f"`{c}`") for c in kept],
        n_lines.alias("n_lines"),
        F.expr(f"coalesce(size({GONE}), 0)").cast("int").alias("n_dropped"),
    )
