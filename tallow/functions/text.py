"""Exact numbers, symbols and archive names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^[+-]?[0-9]{1,19}$"
#: At most eight decimal places: more would be rounded by a cast, without a word.
DECIMAL = r"^[+-]?[0-9]{1,30}(\.[0-9]{1,8})?$"
NUMBER = "decimal(38,8)"
SYMBOL = "^[A-Z0-9]{3,20}$"


def exact_long(text: Column) -> Column:
    """The integer, or null for anything a strict parser refuses (blanks, exponents, overflow)."""
    return F.when(text.rlike(INTEGER), text.try_cast("long"))


def exact_decimal(text: Column) -> Column:
    return F.when(text.rlike(DECIMAL), text.try_cast(NUMBER))


def plain(number: Column) -> Column:
    """A DECIMAL(38,8) without trailing zeros."""
    return F.regexp_replace(number.cast("string"), r"\.?0+$", "")


def rfc3339(t: Column) -> Column:
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(t, ".SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def normalize_symbol(text: Column) -> Column:
    """The normal form, or null for what isn't a symbol. Letters are checked before they change case."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "[/-]", "")
    return F.when(bare.rlike("^[A-Za-z0-9]{3,20}$"), F.upper(bare))


def archive_name(symbol: Column, interval: Column, period: Column, monthly: Column) -> Column:
    return F.concat_ws("-", symbol, interval, F.when(monthly, F.date_format(period, "yyyy-MM")).otherwise(F.date_format(period, "yyyy-MM-dd")))


def archive_period(name: Column, symbol: Column, interval: Column) -> Column:
    """The period of an archive's file name, or null for foreign files and dates that don't exist."""
    stem = F.regexp_extract(name, r"^(.*)\.zip$", 1)
    lead = F.concat(symbol, F.lit("-"), interval, F.lit("-"))
    date = F.when(stem.startswith(lead), F.substring(stem, F.length(lead) + 1, F.length(stem)))
    whole = F.when(date.rlike(r"^\d{4}-\d{2}$"), F.concat(date, F.lit("-01"))).when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), date)
    return F.try_to_timestamp(whole, F.lit("yyyy-MM-dd"))


def human_bytes(n: Column) -> Column:
    """1024-based, one decimal from KB up, halves to the even digit; a decimal(38,0) where a long is too small.

    The digit comes from the double itself, as printf's does: `bround` rounds its shortest text, which can look like a half.
    """
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n.cast("double") / 1024.0**power
        # terabytes of a decimal can pass a long: two parts
        whole = v.cast("long") if power < 4 else (v / 2.0**62).cast("long").cast("decimal(20,0)") * 2**62 + (v % 2.0**62).cast("long")
        # no step rounds but rint: below 2**53 bytes the fraction has 40 bits at most, above that 39
        shown = F.concat((whole + (F.rint(v % 1 * 10) / 10).cast("decimal(2,1)")).cast("string"), F.lit(f" {unit}"))
        out = out.when(n < 1024 ** (power + 1) if power < 4 else n.isNotNull(), shown)
    return out
