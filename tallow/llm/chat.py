"""Chat formatting: logged snapshots of growing conversations collapse to the maximal ones, which are rendered.

A conversation's turns are ordered by (turn, role, text). Each turn has a 128-bit hash of its place, role and
text; their running exclusive-or is the hash of the prefix that ends there. A conversation is dropped if its
whole-length hash is that of a proper prefix of another one, by an anti join on distinct prefix hashes; of equal
conversations the one with the smallest conv_id stays.

Edge cases: null conv_id is one conversation of its own; a null role renders as `unknown`, a null text as
empty; repeated turns stay, in order; template markers inside texts are broken up; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.common import row_key

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_key, conv_id, place (from 1), n turns, role, text, and the prefix hash (a, b) that ends at each turn."""
    own = turns.select("conv_id", row_key("conv_id").alias("conv_key"), "turn", "role", "text")
    order = Window.partitionBy("conv_key").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = own.withColumn("place", F.row_number().over(order))
    upto = Window.partitionBy("conv_key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_key")
    said = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in ("role", "text")]
    return placed.select(
        "conv_key", "conv_id", "place", "role", "text",
        F.bit_xor(F.xxhash64("place", *said)).over(upto).alias("a"),
        F.bit_xor(F.xxhash64(F.lit("b"), *reversed(said), "place")).over(upto).alias("b"),
        F.count("*").over(whole).alias("n"),
    )


def maximal(prefixed: DataFrame) -> DataFrame:
    """conv_key of the conversations that stay."""
    whole = prefixed.where("place = n").groupBy("n", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNull().alias("last"), "conv_id", "conv_key")).alias("own"))
    inner = prefixed.where("place < n").select(F.col("place").cast("long").alias("n"), "a", "b").distinct()
    return whole.join(inner, ["n", "a", "b"], "left_anti").select("own.conv_key")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns (int) and text of every maximal conversation."""
    prefixed = prefixes(turns)
    stays = maximal(prefixed)
    clean = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    role = F.replace(F.coalesce("role", F.lit("unknown")), F.lit("<|"), F.lit("< |"))
    said = F.concat(F.lit(OPEN), role, F.lit("\n"), clean, F.lit(CLOSE + "\n"))
    return (
        prefixed.select("conv_key", "conv_id", "place", said.alias("said"))
        .join(stays, "conv_key", "left_semi")
        .groupBy("conv_key")
        .agg(F.first("conv_id").alias("conv_id"), F.count("*").cast("int").alias("n_turns"), F.expr("array_join(transform(array_sort(collect_list(struct(place, said))), x -> x.said), '')").alias("text"))
        .select("conv_id", "n_turns", "text")
    )
