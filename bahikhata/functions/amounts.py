"""Amounts and money as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_AMOUNT = 2_000_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_amount(raw: Column) -> Column:
    """Text of an amount cell as decimal(18,2), or null.

    Null for blank, nil, n/a, a lone sign, bare numbers of ten digits or more (ids), more than ten digits, more than
    two decimals, zero, and beyond MAX_AMOUNT. Dr/Cr marks, currency marks, blanks and grouping are dropped, brackets
    and (-) mean minus, and up to two stray characters at the end are forgiven.
    """
    fair = lambda value: F.when((value != 0) & (F.abs(value) <= MAX_AMOUNT), value)
    number = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"
    marks = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)\s*\(?(?:cr|dr)\.?\)?$", ""), r"[₹\s]", "")
    plain = F.replace(F.regexp_replace(marks, r"(?i)^(?:rs\.?|inr)", ""), F.lit(","), F.lit(""))
    signed = F.regexp_replace(F.regexp_replace(plain, r"^\(-\)", "-"), r"^\(([0-9.]+)\)$", "-$1")
    # A number with at most two stray characters after it; what is left of the text isn't one.
    digits = F.regexp_extract(signed, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))[^0-9]{0,2}$", 1)
    dressed = let(digits, lambda s: let(F.when(
        s.rlike(number) & ~F.trim(raw).rlike(r"^[0-9]{10,}$") & (F.length(F.regexp_replace(s, "[^0-9]", "")) <= 10) & ~s.rlike(r"\.[0-9]{3,}$"), s).try_cast("decimal(18,2)"), fair))
    # A bare number needs none of that, and a text without digits has no amount.
    bare = F.when(raw.rlike(r"^[0-9]{1,8}\.[0-9]{2}$"), raw).try_cast("decimal(18,2)")
    return F.when(raw.rlike(r"^[0-9]{1,8}\.[0-9]{2}$"), F.when(bare != 0, bare)).when(raw.rlike("[0-9]"), dressed)


def format_indian(amount: Column) -> Column:
    """1234567.5 -> 12,34,567.50, with a leading minus."""
    fixed = F.abs(amount.cast("decimal(18,2)")).cast("string")
    rupees, paise = F.substring_index(fixed, ".", 1), F.substring_index(fixed, ".", -1)
    head = F.reverse(F.regexp_replace(F.reverse(F.substring(rupees, F.lit(1), F.greatest(F.length(rupees) - 3, F.lit(0)))), "([0-9]{2})(?=[0-9])", "$1,"))
    grouped = F.when(F.length(rupees) > 3, F.concat(head, F.lit(","), F.right(rupees, F.lit(3)))).otherwise(rupees)
    return F.concat(F.when(amount < 0, "-").otherwise(""), grouped, F.lit("."), paise)


def nice_axis_max(top: Column) -> Column:
    """The next of 1, 2, 5 and 10 times a power of ten at or above ``top``; 1 where there is nothing."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(top)))
    part = top / size
    step = F.when(part <= 1, 1.0).when(part <= 2, 2.0).when(part <= 5, 5.0).otherwise(10.0)
    return F.when(top > 0, step * size).otherwise(1.0)


def plain_number(amount: Column) -> Column:
    """A decimal as its shortest text: 50000.00 -> 50000, 12.50 -> 12.5."""
    return F.rtrim(F.rtrim(amount.cast("decimal(18,2)").cast("string"), F.lit("0")), F.lit("."))
