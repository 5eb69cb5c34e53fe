"""Which bank issued a statement: evidence of several kinds, as Column expressions over one row a statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bahikhata.functions.amounts import let
from bahikhata.operators.bank_words import DOMAINS, IFSC_BANKS, PHRASE_WEIGHTS, PHRASES, SHORT_NAMES

_IFSC = r"(?i)\b([A-Z]{4})0[A-Z0-9]{6}\b"
_LABELLED = r"(?i)ifsc(?:\s*code)?\s*[:\-]?\s*([A-Z]{4})0[A-Z0-9]{6}"
#: A payment's reference, which names the other side's bank.
_PAYMENT = r"(?i)\b(?:UPI|NEFT|IMPS|RTGS|ECS|NACH|ACH|POS)[A-Z]{0,3}[:\-]?/?[A-Za-z0-9@/.\-]{6,100}"
_BANK_OF = {p: bank for bank, phrases in PHRASES for p in phrases}
#: Narrations in which branch codes are counted.
SAMPLE = 50
_HIT = "struct<bank:string,confidence:double,method:string,ifsc:string>"


def norm(text: Column) -> Column:
    """Lower-case words of letters, digits, dots and at signs, one blank between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9.@]+", " "))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _hit(bank: Column, confidence: Column | float, method: Column | str, ifsc: Column | None = None) -> Column:
    """A find, or null where there is no bank."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return let(bank, lambda b: F.when(b.isNotNull(), F.struct(b.alias("bank"), lit(confidence).alias("confidence"), lit(method).alias("method"),
                                                            (F.lit(None).cast("string") if ifsc is None else ifsc).alias("ifsc"))))


def _codes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_IFSC), F.lit(1)), F.upper)


def by_ifsc(text: Column) -> Column:
    """A labelled branch code, else the first code of a known bank."""
    banks = _literal_map(IFSC_BANKS)
    labelled = F.try_element_at(banks, F.upper(F.regexp_extract(text, _LABELLED, 1)))
    full = F.nullif(F.upper(F.regexp_extract(text, _IFSC, 0)), F.lit(""))
    any_ = F.get(F.filter(F.transform(_codes(text), lambda c: F.try_element_at(banks, c)), lambda b: b.isNotNull()), F.lit(0))
    return F.coalesce(_hit(labelled, 0.98, "ifsc_labeled", full), _hit(any_, 0.80, "ifsc_any"))


def by_domain(text: Column) -> Column:
    return _hit(F.coalesce(*[F.when(text.rlike(f"(?i){p}"), bank) for bank, p in DOMAINS]), 0.95, "domain")


def by_phrase(normal: Column, cap: float = 0.95, method: str = "phrase") -> Column:
    """The phrase that stands first, as whole words; of several at one place the first of the table. One pattern finds both."""
    words = "|".join(p.replace(".", r"\.") for p in _BANK_OF)
    found = F.try_element_at(_literal_map(_BANK_OF), F.regexp_extract(normal, rf"\b({words})\b", 1))
    return let(found, lambda b: _hit(b, F.least(F.lit(cap), F.when(b.isin(*PHRASE_WEIGHTS), 0.95 * 0.9).otherwise(0.95)), method))


def by_short_name(text: Column) -> Column:
    """The first word of 3 to 8 bytes within one edit of a short name.

    Signs read as digits need no step of their own: short names have no digit, so such a repair never comes nearer.
    """
    words = F.filter(F.split(F.upper(text), r"[ /\\\-|,._@]"), lambda w: F.octet_length(w).between(3, 8))

    def tried(w: Column) -> Column:
        near = [F.when(F.levenshtein(w, F.lit(s)) <= 1, F.struct((w == F.lit(s)).alias("exact"), F.lit(bank).alias("bank"))) for s, bank in SHORT_NAMES]
        return F.coalesce(*near)
    first = F.get(F.filter(F.transform(words, tried), lambda h: h.isNotNull()), F.lit(0))
    return let(first, lambda h: _hit(h["bank"], F.when(h["exact"], 0.85).otherwise(0.72), F.when(h["exact"], "abbrev_exact").otherwise("abbrev_fuzzy")))


def top_code(narrations: Column) -> Column:
    """The branch prefix most frequent in the first narrations, met twice or more; of equals the first by letters."""
    codes = _codes(F.array_join(F.slice(narrations, 1, SAMPLE), " "))
    counted = let(codes, lambda cs: F.transform(F.array_distinct(cs), lambda c: F.struct((-F.size(F.filter(cs, lambda x: x == c))).alias("n"), c.alias("code"))))
    return let(F.array_min(counted), lambda top: F.when(top["n"] <= -2, top["code"]))


def detected() -> Column:
    """struct(bank, confidence, method, ifsc) from the columns text, header_text, filename and narrations; null without evidence.

    Each kind of evidence is asked only while the best find is below its gate, and replaces it only if surer. Null texts
    count as empty.
    """
    text, head, name = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "header_text", "filename"))
    capped = let(F.coalesce(by_phrase(norm(name)), by_short_name(name)), lambda h: _hit(h["bank"], F.least(h["confidence"], F.lit(0.65)), "filename"))
    code = F.try_element_at(_literal_map(IFSC_BANKS), top_code(F.coalesce("narrations", F.array().cast("array<string>"))))
    tiers = ((2.0, by_ifsc(head)), (0.95, by_domain(text)), (0.95, by_phrase(norm(head))), (0.75, by_short_name(head)),
             (0.82, by_phrase(norm(F.regexp_replace(text, _PAYMENT, " ")), 0.80, "phrase_full")), (0.70, capped), (0.60, _hit(code, 0.55, "narration_ifsc")))
    asked = F.filter(F.array(*[F.struct(F.lit(gate).alias("gate"), h.cast(_HIT).alias("h")) for gate, h in tiers]), lambda t: t["h"].isNotNull())
    sure = lambda r: F.coalesce(r["confidence"], F.lit(0.0))
    return F.aggregate(asked, F.lit(None).cast(_HIT), lambda r, t: F.when((sure(r) < t["gate"]) & (t["h"]["confidence"] > sure(r)), t["h"]).otherwise(r))


def metadata(text: Column) -> Column:
    """struct(account_no, ifsc, branch, statement_period, statement_id) as the text states them, '' where it doesn't; the account masked."""
    day = r"(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})"
    period = rf"(?i)(?:(?:statement|from)\s*(?:date|period)?[\s:\-]+|period[\s:\-]+){day}\s*(?:to|[-–])\s*{day}"
    masked = let(F.regexp_extract(text, r"(?i)a(?:ccount|cct|/c)[\s.\-]*(?:no|number|num|#)?[\s:\-]*([0-9]{6,20})", 1), lambda a: F.when(
        F.length(a) > 8, F.concat(F.left(a, F.lit(4)), F.repeat(F.lit("X"), F.length(a) - 8), F.right(a, F.lit(4)))).otherwise(a))
    branch = F.regexp_extract(text, r"(?i)(?:branch\s*(?:name|:)|home\s*branch)[\s:\-]+([A-Za-z][^\n\r,]{2,49})", 1)
    return F.struct(masked.alias("account_no"), F.regexp_extract(text, r"(?i)ifsc(?:\s+code)?[\s:\-]*([A-Z]{4}0[A-Z0-9]{6})", 1).alias("ifsc"),
                    F.trim(F.regexp_replace(branch, r"\s+", " ")).alias("branch"),
                    F.when(text.rlike(period), F.concat_ws(" to ", F.regexp_extract(text, period, 1), F.regexp_extract(text, period, 2))).otherwise("").alias("statement_period"),
                    F.regexp_extract(text, r"(?i)statement\s*(?:id|number|ref(?:erence)?)[\s:\-]+([A-Z0-9/\-]{6,30})", 1).alias("statement_id"))


def with_bank(statements: DataFrame) -> DataFrame:
    """B1: adds bank_name, confidence, method, needs_review and the metadata; one row a statement in, one out."""
    said = F.coalesce(F.nullif(F.col("text"), F.lit("")), "header_text", F.lit(""))
    rows = statements.withColumns({"_hit": detected(), "_meta": metadata(said)})
    sure = F.coalesce("_hit.confidence", F.lit(0.0))
    return rows.withColumns({
        "bank_name": F.coalesce("_hit.bank", F.lit("")), "confidence": sure, "method": F.coalesce("_hit.method", F.lit("none")), "needs_review": F.col("_hit.bank").isNotNull() & (sure < 0.6),
        "account_no": F.col("_meta.account_no"), "ifsc": F.coalesce("_hit.ifsc", "_meta.ifsc"), "branch": F.col("_meta.branch"),
        "statement_period": F.col("_meta.statement_period"), "statement_id": F.col("_meta.statement_id")}).drop("_hit", "_meta")


def match_bank(text: Column) -> Column:
    """The bank that a text alone names, '' if none."""
    return F.coalesce(by_phrase(norm(text))["bank"], by_ifsc(text)["bank"], by_short_name(text)["bank"], F.lit(""))
