"""Narrations, references and account numbers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bahikhata.functions.amounts import plain_number

# Patterns of rows that are totals or headers.
TOTALS = (
    r"^(?:grand\s*)?total\b", r"^sub[\s\-]?total\b", r"^closing\s*(?:balance|bal)\b", r"^opening\s*(?:balance|bal)\b", r"^brought\s+forward\b",
    r"^balance\s+brought\s+forward\b", r"^b\s*[/\\]\s*[fd]\b", r"^balance\s*(?:c/f|b/f|carried\s*forward|bf|cf)\b", r"^carried\s+forward\b", r"^c/f\b",
    r"^b/f\b", r"^balance\s+as\s+(?:on|at|of)\b", r"^available\s*balance\b", r"^ledger\s*balance\b", r"^total\s*balance\b", r"^statement\s*(?:of|summary)\b",
    r"^op\.?\s*(?:balance|bal)\b", r"^prev(?:ious)?\s*(?:balance|bal|closing)\b", r"^balance\s*(?:forward|fwd)\b", r"^net\s*(?:balance|bal)\b",
    r"\bpage\s*total\b", r"^page\s+\d+(?:\s+of\s+\d+)?$", r"^\d+\s+of\s+\d+$", r"^[a-z\s]+bank\s+\d+x+\d+$", r"^[a-z\s]+bank\s+\d{10,}$",
)
HEADERS = (
    r"^date\b", r"^narration\b", r"^particulars\b", r"^description\b", r"^transaction\s*(?:date|details|id|no)\b", r"^tran\s*(?:date|details|id|no)\b",
    r"^debit\b", r"^credit\b", r"^balance\b", r"^amount\b", r"^withdrawal\b", r"^deposit\b", r"^chq\b", r"^cheque\b", r"^reference\b", r"^remarks\b",
    r"^s\.?\s*no\b", r"^sr\.?\s*no\b", r"^sl\.?\s*no\b", r"^serial\s*(?:no|number)\b", r"^receipt\b[?]?$", "^[✓✗✔✘]+$",
)
# Payment types by the first keyword found.
PAYMENT_TYPES = (
    ("UPI", ("UPI",)), ("NEFT", ("NEFT",)), ("RTGS", ("RTGS",)), ("IMPS", ("IMPS",)), ("NACH", ("NACH", "ACH", "ECS")), ("ATM", ("ATM",)),
    ("POS", ("POS", "SWIPE")), ("CHEQUE", ("CHQ", "CHEQUE", "CLG")), ("SALARY", ("SALARY", " SAL ")), ("EMI", ("EMI",)), ("INTEREST", ("INTEREST", " INT ")),
    ("CHARGES", ("CHRG", "CHGS", "CHARGES", "LEVY")), ("CASH", ("CASH",)), ("TRANSFER", ("TRF", "TRANSFER")), ("SWIFT", ("SWIFT", "FOREIGN")), ("DD", (" DD ", "DEMAND DRAFT")),
)
REFERENCES = (r"UTR[:\s]*([A-Z0-9]{10,22})", r"REF[:\s#]*([A-Z0-9]{8,20})", r"\b([0-9]{12,22})\b", r"(?:CHQ|CHEQUE)[:\s]*([0-9]{6,9})")
RAILS = ("UPI", "NEFT", "RTGS", "IMPS", "INFT", "NACH", "ECS", "ACH", "BBPS", "CHQ", "ATM", "POS")

#: A reference number, glued to its rail or alone.
GLUED_REFERENCE = r"(?i)\b(?:(?:UPI|NEFT|RTGS|IMPS|INFT|NACH|ECS|ACH|BBPS)[A-Z]{0,10})?[0-9]{6,}"


def contains_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether the text holds one of the words as they stand: one pattern, one node in the plan."""
    return text.rlike("|".join(re.escape(w) for w in words))


def first_case(cases: list[tuple[Column, Column]]) -> Column:
    """A flat CASE: the value of the first condition that holds, else null."""
    (condition, value), *rest = cases
    out = F.when(condition, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out


def txn_hash(date: Column, narration: Column, debit: Column, credit: Column) -> Column:
    """Polynomial hash (base 31, 32 bits, over code points) of date, narration and amounts, in lower hex; null texts count as empty."""
    part = lambda x: F.coalesce(plain_number(x), F.lit("null"))
    chars = F.split(F.concat_ws("|", F.coalesce(date, F.lit("")), F.coalesce(narration, F.lit("")), part(debit), part(credit)), "")
    points = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.lower(F.hex(F.aggregate(points, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295)))))


def is_noise_row(narration: Column) -> Column:
    text = F.trim(F.lower(F.coalesce(narration, F.lit(""))))
    return (text != "") & (text.rlike("|".join(TOTALS)) | text.rlike("|".join(HEADERS)))


def combined(narration: Column, reference: Column) -> Column:
    return F.when(reference == "", narration).otherwise(F.concat(narration, F.lit(" "), reference))


def payment_type(narration: Column) -> Column:
    up = F.upper(narration)
    return F.coalesce(first_case([(contains_any(up, words), F.lit(name)) for name, words in PAYMENT_TYPES]), F.lit("OTHER"))


def payment_ref(narration: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(narration, p, 1), F.lit("")) for p in REFERENCES], F.lit(""))


def mask_account(account: Column) -> Column:
    return F.concat(F.lit("XXXX"), F.right(F.regexp_replace(account, "[^A-Za-z0-9]", ""), F.lit(4)))


def rule_pattern(text: Column) -> Column:
    """The pattern that a confirmed row teaches: no references, upper case, 40 characters; null if only a rail is left."""
    s = F.regexp_replace(text, GLUED_REFERENCE, " ")
    s = F.upper(F.trim(F.regexp_replace(F.regexp_replace(s, "[0-9]{6,}", " "), r"\s+", " ")))
    s = F.substring(s, 1, 40)
    return F.when((s != "") & ~s.isin(*RAILS), s)


def tokens(text: Column, keep: str = r"[^\p{L}\p{N}]+") -> Column:
    """Distinct upper-case words of four bytes or more."""
    return F.array_distinct(F.filter(F.split(F.upper(text), keep), lambda t: F.octet_length(t) >= 4))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set (duplicates)."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all (reconciliation)."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def signature(name: Column) -> Column:
    """A name's tokens in order, joined by bars: equal for spellings that differ in order, case and signs."""
    return F.array_join(F.array_sort(F.filter(F.split(F.upper(name), "[^A-Z0-9]+"), lambda t: t != "")), "|")
