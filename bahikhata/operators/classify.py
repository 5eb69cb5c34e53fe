"""Transaction classification: saved rules, the keyword ladder, voucher types, GST tags.

Everything is column expressions but the party's name, which is worked out once for each distinct narration.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bahikhata.functions.text import GLUED_REFERENCE, combined, contains_any, first_case
from bahikhata.operators.ledger_words import LADDER, RAILS

RULE_GLOBAL, RULE_CLIENT, KEYWORD = 0.6, 0.9, 0.45
MOST_RULES = 20_000

# Words of a narration that are no part of a name, and banks' short names.
SKIP = set("""NEFT RTGS IMPS UPI INFT NACH ECS ACH BBPS CR DR CREDIT DEBIT INWARD OUTWARD BY TO FROM VIA FOR PER OF AT ON IN REF UTR TXN NO NUMBER
TRF TRANSFER PAYMENT RECEIVED PAID SENT P2P P2M P2B P2A ONLINE NET BANKING INB MB BANK BRANCH IFSC CHQ CHEQUE DEP DEPOSIT WDL WITHDRAWAL WITH INT
INTEREST CLG CLEARING CL SB CA OD FD RD SAVINGS CURRENT A/C AC ACCT ACCOUNT AMT AMOUNT BAL BALANCE CHRGS CHGS CHARGES CHARGE LEVY""".split())
BANK_NAMES = set("HDFC HDFCBANK ICICI ICICIB SBI SBIN AXIS AXISB KOTAK PNB BOI BOB IOB CANARA UNION IDBI YES RBL FEDERAL INDUSIND UCO PAYTM PHONEPE GPAY".split())

_GLUED = re.compile(GLUED_REFERENCE)
_ALNUM, _DIGITS, _LETTERS = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[0-9]+"), re.compile(r"[A-Za-z]+")


def _tidy(name: str) -> str:
    name = name.strip()
    at = re.search("page ", name, re.I)
    if at and at.start():
        name = name[:at.start()].strip()
    words = name.split()
    if len(words) > 1 and len(words[-1]) <= 2 and re.fullmatch("[A-Z]+", words[-1]):
        words.pop()
    if words and len(words[-1]) >= 6 and _DIGITS.fullmatch(words[-1]):
        words.pop()
    return " ".join(words).encode()[:40].decode(errors="ignore").strip()


def party_name(text: str) -> str:
    """The counterparty in a narration: the best part between separators, else the first run of name words."""
    text = _GLUED.sub(" ", text)

    def no_name(part: str) -> bool:
        size = len(part.encode())
        return (size <= 2 and bool(_LETTERS.fullmatch(part)) or size < 2 or part.upper() in SKIP or bool(_DIGITS.fullmatch(part)) or "@" in part
                or bool(re.fullmatch("[A-Za-z]{4}0.{6}", part)) or size >= 14 and bool(_ALNUM.fullmatch(part)))

    def weight(part: str) -> int:
        words = part.split()
        bank = part.upper() in BANK_NAMES or words[0].upper() in BANK_NAMES
        return 3 * len(words) - 2 * bool(re.search("[0-9]", part)) - 6 * bank - 3 * (len(words) == 1 and len(part.encode()) > 10 and bool(_ALNUM.fullmatch(part)))

    parts = [p.strip() for p in re.split(r"[/\-|:]", text)]
    if len(parts) > 1:
        named = [(weight(p), -i, p) for i, p in enumerate(parts) if p and not no_name(p)]
        if named and max(named)[0] >= 3:
            return _tidy(max(named)[2])

    def stops(word: str) -> bool:
        return word.upper() in SKIP or bool(_DIGITS.fullmatch(word)) or (len(word.encode()) >= 9 and bool(re.search("[0-9]", word)) and bool(_ALNUM.fullmatch(word)))

    words = text.split()
    start = next((i for i, w in enumerate(words) if not stops(w) and "@" not in w), None)
    if start is None:
        return ""
    run = []
    for w in words[start:start + 6]:
        if stops(w):
            break
        run.append(w)
    return _tidy(" ".join(run))


@F.pandas_udf(T.StringType())
def _parties(texts: pd.Series) -> pd.Series:
    return texts.map(party_name)


def with_party(txns: DataFrame, text: Column, out: str = "party") -> DataFrame:
    """Adds the party of ``text``; each distinct text is worked out once and joined back."""
    txns = txns.withColumn("_text", text)
    names = txns.select("_text").distinct().select(F.col("_text").alias("_key"), _parties("_text").alias(out))
    return txns.join(names, F.col("_text") == F.col("_key"), "left").drop("_text", "_key")


def least_rung(text: Column, rungs: list[Iterable[str]]) -> Column:
    """The number of the first of ``rungs`` that has a word which the text holds, else null: one pass over the text, whatever the number of words.

    Words that begin at one place share their first letter, so the pattern branches by letters, and of the words of a letter those of earlier rungs come
    first. Each place then gives its earliest rung.
    """
    first: dict[str, int] = {}
    for i, words in enumerate(rungs):
        for w in words:
            first.setdefault(w, i)
    letters: dict[str, list[str]] = {}
    for w in first:
        letters.setdefault(w[0], []).append(re.escape(w[1:]))
    pattern = "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in letters.items()) + "))"
    known = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    return F.array_min(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda w: F.try_element_at(known, w)))


def with_keyword(rows: DataFrame, upper: Column, party: Column, is_credit: Column, bank_ledger: str) -> DataFrame:
    """Adds ``_rung``, the first rung of the ladder that the text meets (null if none), and ``_kw``, its struct(vendor, head, txn_type)."""
    rail = len(LADDER)
    # An array of one, taken apart: the optimizer doesn't copy the ladder into what uses its answer.
    rows = rows.withColumn("_rung", F.explode(F.array(least_rung(upper, [*[words for *_, words, _ in LADDER], RAILS]))))
    at = F.col("_rung")
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), at)
    special = first_case([((at == i) & F.contains(upper, F.lit(w)), F.lit(v)) for i, (*_, vendors) in enumerate(LADDER) for w, v in vendors])
    other = F.when(is_credit, F.lit("Sundry Debtors")).otherwise("Sundry Creditors")
    on_rail = at == rail
    answer = F.struct(
        F.when(on_rail, party).otherwise(F.coalesce(special, of(bank_ledger if v[2] == "*bank" else v[2] for v in LADDER))).alias("vendor"),
        F.when(on_rail, F.when(party == "", other).otherwise(party)).otherwise(of(v[0] for v in LADDER)).alias("head"),
        F.when(on_rail, F.when(is_credit, "Receipt").otherwise("Payment")).otherwise(of(v[1] for v in LADDER)).alias("txn_type"))
    return rows.withColumn("_kw", F.when(at.isNotNull(), answer))


def voucher_type(upper: Column, debit: Column, credit: Column) -> Column:
    cash = upper.rlike(r"\bATM\b|CASH\s*(DEP|WDL|WITHDRAWAL)|\bSELF\s*TRANSFER\b")
    return (F.when(cash, "Contra").when(credit.isNotNull() & debit.isNull(), "Receipt").when(debit.isNotNull() & credit.isNull(), "Payment").otherwise("Unknown"))


def tax_tag(upper: Column) -> Column:
    """GST, TAX or null; a tax number that ends the text isn't seen, as the rule has always been."""
    has = lambda *w: contains_any(upper, list(w))
    return (F.when(has("IGST", "CGST", "SGST"), "GST").when(has("GST") & has("PAY", "PMT", "REFUND", "CHALLAN"), "GST")
            .when(upper.rlike(r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z0-9]{4}."), "GST").when(has("INCOME TAX", "ADVANCE TAX", "TDS PMT", "TRACES", "CHALLAN 28"), "TAX"))


def locked(status: Column, source: Column, confidence: Column) -> Column:
    """Rows that automatic classification leaves alone."""
    return status.isin("Manual", "Suspense") | source.isin("user", "ai") | ((status == "Classified") & (confidence >= 1.0))


def first_rule(txns: DataFrame, rules: DataFrame, text: Column) -> DataFrame:
    """Adds ``rule``: of the client's and the global rules whose pattern the text holds, the first by priority and id.

    Rules are a small dimension; a client's are gathered and put in order once, those of all once for the whole query, so the match is a search of two
    arrays in the row's own task. More than MOST_RULES global rules, or rules of one client, are an error, not a cut.
    """
    entry = F.struct((-F.col("priority")).alias("k"), "id", F.col("client_id").alias("of"), F.upper("pattern").alias("pattern"), F.col("vendor").alias("vendor"), F.col("account_head").alias("account_head"), F.col("txn_type").alias("txn_type"))
    live = rules.where(F.coalesce(F.col("pattern"), F.lit("")) != "")

    def in_order(grouped: GroupedData, whose: Column) -> DataFrame:
        found = grouped.agg(F.collect_list(entry).alias("_rules"))
        too_many = F.raise_error(F.concat(F.lit("too many rules of client "), whose)).cast(found.schema["_rules"].dataType)
        return found.withColumn("_rules", F.when(F.size("_rules") > MOST_RULES, too_many).otherwise(F.array_sort("_rules")))
    own = in_order(live.where("client_id <> 0").groupBy(F.col("client_id").alias("_of")), F.col("_of").cast("string")).withColumnRenamed("_rules", "_own")
    everyone = in_order(live.where("client_id = 0").groupBy(), F.lit("0")).select("_rules").scalar()
    rows = txns.join(own, F.col("client_id") == F.col("_of"), "left").withColumn("_everyone", everyone)
    first = lambda found: F.get(F.filter(found, lambda r: F.contains(text, r["pattern"])), F.lit(0))
    return rows.withColumn("rule", F.least(first(F.col("_own")), first(F.col("_everyone")))).drop("_own", "_of", "_everyone")


def classified(txns: DataFrame, rules: DataFrame, bank_ledger: str = "Bank A/c") -> DataFrame:
    """Classifies the rows that aren't locked; adds ``changed`` and ``tag``."""
    text = combined(F.col("narration"), F.col("reference"))
    rows = with_party(txns, text).withColumn("_up", F.upper(text))
    rows = first_rule(rows, rules, F.col("_up"))
    credit = F.col("credit").isNotNull() & F.col("debit").isNull()
    rows = with_keyword(rows, F.col("_up"), F.col("party"), credit, bank_ledger).withColumn("_lock", locked(F.col("status"), F.col("classification_source"), F.col("confidence")))
    ruled, worded = F.col("rule").isNotNull(), F.col("_kw").isNotNull()
    filled = lambda new, old: F.coalesce(F.nullif(new, F.lit("")), old)

    def pick(name: str, by_rule: Column, by_word: Column, neither: Column) -> Column:
        return F.when(F.col("_lock"), F.col(name)).when(ruled, by_rule).when(worded, by_word).otherwise(neither)

    kind = pick("txn_type", filled(F.when(F.col("rule.txn_type").isin("Payment", "Receipt", "Contra"), F.col("rule.txn_type")), F.col("txn_type")), F.col("_kw.txn_type"), F.col("txn_type"))
    new = {
        "vendor": pick("vendor", filled(F.col("rule.vendor"), F.col("vendor")), F.col("_kw.vendor"), filled(F.col("party"), F.col("vendor"))),
        "account_head": pick("account_head", filled(F.col("rule.account_head"), F.col("account_head")), F.col("_kw.head"), F.col("account_head")),
        "txn_type": F.when(~F.col("_lock") & (kind == "Unknown"), voucher_type(F.col("_up"), F.col("debit"), F.col("credit"))).otherwise(kind),
        "confidence": pick("confidence", F.when(F.col("rule.of") == 0, RULE_GLOBAL).otherwise(RULE_CLIENT), F.lit(KEYWORD), F.lit(0.0)),
        "status": pick("status", F.lit("Classified"), F.lit("Classified"), F.lit("Unreviewed")),
        "classification_source": pick("classification_source", F.lit("rule"), F.lit("keyword"), F.lit("")),
    }
    watched = ("status", "vendor", "account_head", "confidence")
    changed = F.lit(False)
    for name in watched:
        changed = changed | (~new[name].eqNullSafe(F.col(name)))
    return rows.withColumn("changed", changed).withColumn("tag", F.when(~F.col("_lock"), tax_tag(F.upper(F.concat_ws(" ", "narration", "reference"))))).withColumns(new).drop("_up", "_kw", "_rung", "_lock", "rule")
