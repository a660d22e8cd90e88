"""Amounts, entity names and digits as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendscope.functions.lexicon import bound

#: Units of Indian amounts, as patterns, with their multipliers.
UNITS = [("crores?|cr", 1e7), ("lakhs?|lacs?|l", 1e5), ("thousands?|k", 1e3)]
UNIT = "|".join(p for p, _ in UNITS)
AMOUNT = rf"(?i)(-?)\s*(?:₹|Rs\.?|INR)?\s*(-?)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:({UNIT})\b)?"
WHOLE = rf"(?i)^\s*(-?)\s*(?:₹|Rs\.?|INR)?\s*(-?)([0-9][0-9,]*(?:\.[0-9]+)?)(?:\s+({UNIT})\.?)?\s*$"
YEAR = "^20[0-2][0-9]$"
NOISE_NAME = "(?i)https?|www|cookie|subscribe|click|login|copyright"
VALID_NAME = r"^[A-Za-z][A-Za-z0-9_ .\-&'()]{1,80}$"


def multiplier(unit: Column) -> Column:
    out = F.lit(1.0)
    for pattern, times in UNITS:
        out = F.when(F.lower(unit).rlike(f"^(?:{pattern})$"), times).otherwise(out)
    return out


def _amount(raw: Column, pattern: str, context_unit: Column, negative: Column | None = None) -> Column:
    # What the pattern finds is bound once, so that the code for an amount stays short.
    names = ("before", "sign", "digits", "unit")
    found = F.struct(*[F.regexp_extract(raw, pattern, i).alias(n) for i, n in enumerate(names, 1)], context_unit.alias("context"), (F.lit(False) if negative is None else negative).alias("negative"))

    def value(m: Column) -> Column:
        unit = F.when(m["unit"] != "", m["unit"]).otherwise(m["context"])
        minus = (m["before"] == "-") | (m["sign"] == "-") | m["negative"]
        year = (unit == "") & m["digits"].rlike(YEAR)
        amount = F.regexp_replace(m["digits"], ",", "").try_cast("double")
        return F.when((m["digits"] != "") & ~year, F.when(minus, -1.0).otherwise(1.0) * amount * multiplier(unit))

    return bound(found, value)


def parse_amount(raw: Column, context_unit: Column | None = None) -> Column:
    """First amount anywhere in a text, in rupees; a bare year is none. A unit must be a word of its own."""
    return _amount(raw, AMOUNT, F.lit("") if context_unit is None else context_unit)


def parse_inr(raw: Column, context_unit: Column | None = None) -> Column:
    """A text that is one amount, with its unit as a word of its own or from the context."""
    return _amount(raw, WHOLE, F.lit("") if context_unit is None else context_unit)


def parse_accounting(raw: Column) -> Column:
    """(1,234) is negative; else as parse_amount."""
    return _amount(raw, AMOUNT, F.lit(""), raw.rlike(r"^\s*\(.+\)\s*$"))


def valid_amount(value: Column, raw: Column) -> Column:
    bare_year = F.trim(raw).rlike("^(199[0-9]|20[0-3][0-9]|2040)$")
    return F.coalesce(~bare_year & (value >= 100), F.lit(False))


def first_digit(x: Column) -> Column:
    whole = F.floor(F.abs(x)).cast("long")
    return F.when((x > 0) & (whole > 0), F.substring(whole.cast("string"), 1, 1).cast("int"))


def normalise_entity(raw: Column) -> Column:
    cut = F.regexp_replace(raw, r"[/-]\s*[0-9]{4,}.*$", "")
    kept = F.regexp_replace(F.upper(cut), r"[^A-Z0-9 &./()-]", " ")
    name = F.trim(F.regexp_replace(kept, " +", " "))
    return F.when(F.length(name) >= 3, name).otherwise("")


def valid_entity(name: Column) -> Column:
    return ~name.rlike(NOISE_NAME) & name.rlike(VALID_NAME)
