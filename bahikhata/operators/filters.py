"""Row predicates and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dash_filter(txns: DataFrame, bank: str = "", vendor: str = "", head: str = "", date_from: str = "", date_to: str = "") -> DataFrame:
    """Equality filters that are set, and an inclusive range of dates; rows without a date pass."""
    for name, value in (("bank_name", bank), ("vendor", vendor), ("account_head", head)):
        if value:
            txns = txns.where(F.col(name) == value)
    if date_from:
        txns = txns.where(F.col("date").isNull() | (F.col("date") >= F.lit(date_from).cast("date")))
    if date_to:
        txns = txns.where(F.col("date").isNull() | (F.col("date") <= F.lit(date_to).cast("date")))
    return txns


def reasons() -> Column:
    """Why a row isn't valid, joined by '; ' ('' if it is)."""
    amount = F.coalesce("debit", "credit")
    checks = (
        (F.length(F.coalesce("date_raw", F.lit(""))) < 8, "Missing or invalid date"), (amount.isNull(), "No amount (debit or credit)"), (F.abs(amount) > 2_000_000_000, "Amount exceeds ₹200 crore"),
        (amount < 0, "Negative amount — check column detection"), (F.octet_length(F.trim("narration")) < 2, "Empty or very short narration"),
        (F.col("balance") < -1_000_000, "Suspiciously negative balance"), (F.col("dup_flag"), "Possible duplicate transaction"))
    return F.array_join(F.array(*[F.when(c, F.lit(t)) for c, t in checks]), "; ")


def needs_review() -> Column:
    return F.when(F.col("status") == "NeedsReview", True).when(F.col("status").isin("Suspense", "Manual"), False).otherwise(reasons() != "")


def status_token(token: str) -> Column:
    """One filter word of the main list; unknown words let everything through."""
    tax = F.exists("tags", lambda t: F.upper(t).contains("GST") | F.upper(t).contains("TAX"))
    return {
        "unreviewed": F.col("status") == "Unreviewed", "suspense": F.col("status") == "Suspense", "high": (F.col("status") == "Classified") & (F.col("confidence") >= 0.7),
        "duplicates": F.col("dup_flag"), "gst": tax, "needs_review": needs_review(), "credits": F.col("credit").isNotNull() & F.col("debit").isNull(),
        "debits": F.col("debit").isNotNull() & F.col("credit").isNull()}.get(token, F.lit(True))


def main_filter(txns: DataFrame, tokens: list[str], **more: str) -> DataFrame:
    """Rows that meet any of the status words (all, without words) and every other filter."""
    any_ = F.lit(not tokens)
    for t in tokens:
        any_ = any_ | status_token(t)
    return dash_filter(txns.where(any_), **more)


def confidence_tier() -> Column:
    return F.when(F.col("confidence") >= 0.8, "HIGH").when(F.col("confidence") >= 0.4, "MEDIUM").otherwise("LOW")


def classification_basis() -> Column:
    source = F.col("classification_source")
    return (F.when(source == "rule", "Matched a saved classification rule").when(source == "keyword", "Matched a built-in keyword pattern").when(source == "ai", "Classified by AI (third-party)")
            .when(source == "user", "Manually entered or confirmed by user").when(F.col("status") == "Manual", "Manually added transaction").when(F.col("status") == "Suspense", "Marked as suspense")
            .otherwise("Not yet classified — no matching rule or keyword found"))


def posting_ledger() -> Column:
    return F.coalesce(F.nullif(F.col("account_head"), F.lit("")), F.nullif(F.col("vendor"), F.lit("")), F.lit("Unclassified"))


def export_rows(txns: DataFrame, date_from: str, date_to: str, dateless: bool, only_classified: bool = False, skip_low: bool = False, skip_dups: bool = False) -> DataFrame:
    """Rows to export; ``dateless`` says whether rows without a date go along."""
    low, high = F.lit(date_from).cast("date"), F.lit(date_to).cast("date")
    txns = txns.where(F.coalesce(F.col("date").between(low, high), F.lit(dateless)))
    if only_classified:
        txns = txns.where(~F.col("status").isin("Unreviewed", "Suspense"))
    if skip_low:
        txns = txns.where(F.col("confidence") >= 0.4)
    return txns.where(~F.col("dup_flag")) if skip_dups else txns


def export_voucher(tally: bool) -> Column:
    """The three types that exports know; any other is told by the side and, for ``tally``, by cash words."""
    kind, credit = F.col("txn_type"), F.col("credit").isNotNull()
    up = F.upper("narration")
    guess = F.when(credit, "Receipt").otherwise("Payment")
    if tally:
        guess = F.when(up.contains("ATM") | up.contains("CASH WDL") | up.contains("CASH DEP"), "Contra").otherwise(F.when(credit & F.col("debit").isNull(), "Receipt").otherwise("Payment"))
    return F.when(kind.isin("Receipt", "Payment", "Contra"), kind).otherwise(guess)


def real_rows(txns: DataFrame) -> DataFrame:
    """without the opening-balance rows."""
    return txns.where(~F.coalesce("is_opening_balance", F.lit(False)))


def ai_eligible(scope_all: bool = False) -> Column:
    """rows that may be sent to a language model: no opening rows, nothing decided by hand, and (unless all are asked for) what is open or unsure."""
    free = ~F.coalesce("is_opening_balance", F.lit(False)) & ~F.col("status").isin("Manual", "Suspense")
    return free if scope_all else free & (F.col("status").isin("Unreviewed", "NeedsReview") | (F.col("confidence") < 0.6))


# Words of an audit event by the filter that asks for them.
AUDIT_ACTIONS = {"add": ("ADD", "CREATE", "MANUAL"), "edit": ("EDIT", "RESET", "SAVE", "CLASSIFY"), "delete": ("DELETE",), "import": ("IMPORT", "BATCH"), "export": ("EXPORT",), "classify": ("CLASSIFY",), "rule": ("RULE",)}
AUDIT_TYPES = {"transaction": ("ADD", "DEDUPE", "RECONCILE", "MANUAL"), "client": ("CLIENT",), "rule": ("RULE",), "import": ("IMPORT", "BATCH"), "export": ("EXPORT",)}


def audit_filter(event: Column, action: str = "", kind: str = "") -> Column:
    """F16: events whose text holds a word of the action and one of the kind; an unknown or empty filter lets all through."""
    asked = [words for words in (AUDIT_ACTIONS.get(action), AUDIT_TYPES.get(kind)) if words]
    found = F.lit(True)
    for words in asked:
        found = found & F.upper(event).rlike("|".join(words))
    return found


def party_group() -> Column:
    """SDr or SCr for a row posted to its party; '' for heads and rows without a party."""
    side = F.when(F.col("credit").isNotNull() & F.col("debit").isNull(), "SDr").otherwise("SCr")
    return F.when((F.coalesce("account_head", F.lit("")) == "") & (F.coalesce("vendor", F.lit("")) != ""), side).otherwise("")
