"""Corrections of recognised (OCR) text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bahikhata.functions.amounts import let
from bahikhata.operators.narration_words import BANK_TERMS

# Signs that are taken for digits.
LOOKALIKES, DIGITS = "OoIlSZzBGqQAg", "0011522869949"
_NUMERIC = r"^[0-9OoIlSZBGqQAg]{1,20}$"
_SIGNS = r"\s/\-.,|:"
#: A token that has a digit to repair: nothing but digits and look-alikes, and a look-alike among them.
_TO_REPAIR = rf"(?<![^{_SIGNS}])(?=[0-9]*+[A-Za-z])[0-9OoIlSZBGqQAg]{{1,20}}(?![^{_SIGNS}\x{{85}}\x{{2028}}\x{{2029}}])"


def repaired_digits(line: Column) -> Column:
    """Look-alike letters as digits, in tokens that are made of digits and look-alikes alone; separators stay."""
    parts = F.regexp_extract_all(line, F.lit(f"[{_SIGNS}]+|[^{_SIGNS}]+"), F.lit(0))
    return F.when(line.rlike(_TO_REPAIR), F.array_join(F.transform(parts, lambda t: F.when(t.rlike(_NUMERIC), F.translate(t, LOOKALIKES, DIGITS)).otherwise(t)), "")).otherwise(line)


def _edits(size: int) -> int:
    return 1 if size <= 5 else 2 if size <= 8 else 3


def _candidates() -> Column:
    """For each length of a word from 4 to 15 the terms of a length that so many edits can reach, each cut into one part more than edits: a word within them holds a part whole."""
    def candidate(i: int, term: str, cuts: int) -> str:
        at = [len(term) * n // cuts for n in range(cuts + 1)]
        return f"struct({i} AS i, '{term}' AS term, array({', '.join(repr(term[x:y]) for x, y in zip(at, at[1:]))}) AS parts)"
    rows = [[candidate(i, t, _edits(size) + 1) for i, t in enumerate(BANK_TERMS) if abs(len(t) - size) <= _edits(size)] for size in range(4, 16)]
    return F.expr(f"array({', '.join('array(' + ', '.join(r) + ')' for r in rows)})")


def bank_term(word: Column) -> Column:
    """The bank term nearest to a word of 4 to 15 letters, within one edit of five letters, two of eight, else three; null if none is."""
    def nearest(up: Column) -> Column:
        size = F.length(up)
        most = F.when(size <= 5, 1).when(size <= 8, 2).otherwise(3)
        near = F.filter(F.get(_candidates(), size - 4), lambda t: F.exists(t["parts"], lambda p: F.contains(up, p)))
        far = F.transform(near, lambda t: F.struct(F.levenshtein(up, t["term"]).alias("d"), t["i"].alias("i"), t["term"].alias("term")))
        return F.when(size.between(4, 15), F.array_min(F.filter(far, lambda x: x["d"] <= most))["term"])
    return let(F.upper(word), nearest)


def corrected(line: Column) -> Column:
    """One pass over a line: digits repaired, then words of letters alone set to their bank term; blank lines as they are."""
    words = F.regexp_extract_all(repaired_digits(line), F.lit(r"\S+"), F.lit(0))
    fixed = F.transform(words, lambda w: F.when(w.rlike("^[A-Za-z]{4,}$") & ~F.upper(w).isin(*BANK_TERMS), F.coalesce(bank_term(w), w)).otherwise(w))
    return F.when(F.trim(line) == "", line).otherwise(F.array_join(fixed, " "))
