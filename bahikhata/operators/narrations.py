"""Cleaned narrations, ledger names and parties: column expressions, and joins of distinct names.

Cases: a null or blank narration has no party, an empty text and confidence 0; null names stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bahikhata.functions.amounts import let
from bahikhata.functions.text import first_case, payment_ref, payment_type
from bahikhata.operators.narration_words import BANK_TOKENS, BUSINESS, CATEGORIES, JUNK, NAME_ENDS, PREFIXES, SMALL_WORDS, VENDORS

MIN_CONFIDENCE = 0.4


def _says_something(word: Column) -> Column:
    up = F.upper(word)
    return (F.octet_length(up) > 1) & ~up.rlike("^[0-9]+$") & ~up.isin(*JUNK)


def strip_noise(text: Column) -> Column:
    """X11: the narration's words without links, handles, references, bank codes and words that say nothing."""
    s = F.regexp_replace(F.regexp_replace(text, r"https?://\S+", " "), r"\S+@[a-z]+\b", " ")
    parts = F.transform(F.split(s, r"[/|\\]"), lambda p: F.trim(p))
    parts = F.filter(parts, lambda p: _says_something(p) & ~(F.upper(p).rlike(r"^[A-Z]{4}0") & (F.octet_length(F.upper(p)) == 11)))
    joined = F.array_join(parts, " ")
    for reference in (r"[0-9]{6,22}", r"\b[A-Z]{2,4}[0-9]{6,}\b", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"):
        joined = F.regexp_replace(joined, reference, " ")
    return F.array_join(F.filter(F.split(joined, r"\s+"), _says_something), " ")


def _vendor(upper: Column, named: bool) -> Column:
    """The known vendor whose words the text holds, or (``named``) begins with; null if none."""
    hit = (lambda k: (upper == k) | upper.startswith(k + " ")) if named else (lambda k: upper.contains(k))
    return first_case([(hit(k), F.lit(v)) for k, v in VENDORS])


def clean_party(stripped: Column) -> Column:
    """The known vendor, else the stretch of at most five words with the highest score, the first if equal; 40 characters at most."""
    def score(w: Column) -> Column:
        size = F.octet_length(w)
        return 3 - F.when(F.upper(w).isin(*BANK_TOKENS), 3).otherwise(0) - F.when(w.rlike("^[0-9]"), 4).otherwise(0) + F.when(size > 5, F.least(size - 5, F.lit(3))).otherwise(0)

    def best(words: Column) -> Column:
        def stretch(i: Column) -> Column:
            part = F.slice(words, i + 1, 5)
            return F.struct(F.aggregate(F.transform(part, score), F.lit(0), lambda a, x: a + x).alias("score"), (-i).alias("first"), F.array_join(part, " ").alias("name"))
        top = F.array_max(F.transform(F.sequence(F.lit(0), F.size(words) - 1), stretch))
        return F.when((F.size(words) > 0) & (top["score"] > 0), F.left(top["name"], F.lit(40))).otherwise("")
    return F.coalesce(_vendor(F.upper(stripped), named=False), let(F.filter(F.split(stripped, " "), lambda w: F.octet_length(w) > 1), best))


def title_case(text: Column) -> Column:
    """Words with a capital; short words all in capitals stay, small words are lower inside the text."""
    def word(w: Column, i: Column) -> Column:
        small = F.lower(w).isin(*SMALL_WORDS)
        return (F.when((F.octet_length(w) <= 4) & w.rlike("^[A-Z]+$") & ~small, w).when(small & (i > 0), F.lower(w))
                .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))))
    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), word), " ")


def ledger_name(raw: Column) -> Column:
    """One spelling of a party's name, whatever its place, ending, dots and (for persons) order of words."""
    def order(words: Column) -> Column:
        again = F.array_min(F.filter(F.sequence(F.lit(2), F.size(words) - 1), lambda i: F.get(words, i).isin([F.get(words, F.lit(0)), F.get(words, F.lit(1))])))
        words = F.when(F.size(words) >= 3, F.slice(words, F.lit(1), F.coalesce(again, F.size(words)))).otherwise(words)
        return let(words, lambda w: let(F.exists(w, lambda x: x.isin(*BUSINESS)), lambda firm: let(
            F.when((F.size(w) >= 3) & ~firm, F.slice(w, 1, 2)).otherwise(w),
            lambda two: F.when((F.size(two) == 2) & ~firm & (F.get(two, F.lit(0)) < F.get(two, F.lit(1))), F.reverse(two)).otherwise(two))))
    place = F.rtrim(F.regexp_replace(raw, r"(?s) *(?:(?<= )-|-(?= )).*$", ""))
    upper = F.trim(F.upper(F.replace(place, F.lit("."), F.lit(""))))
    ends = r"(?<=\S)(?: (?:" + "|".join(NAME_ENDS) + r"))+$"
    single = F.regexp_replace(F.trim(F.regexp_replace(upper, r"\s+", " ")), ends, "")
    known = let(upper, lambda u: _vendor(u, named=True))
    rest = let(F.array_join(let(F.split(single, " "), order), " "), lambda n: F.coalesce(_vendor(n, named=True), title_case(n)))
    return F.when(raw == "", raw).otherwise(F.coalesce(known, rest))


def cleaned(narration: Column, title: bool = True) -> Column:
    """struct(cleaned, txn_type, party, payment_ref, confidence)."""
    cased = title_case if title else (lambda x: x)

    def made(text: Column) -> Column:
        return let(strip_noise(text), lambda s: let(F.struct(cased(clean_party(s)).alias("party"), payment_type(text).alias("kind"), F.left(cased(s), F.lit(40)).alias("rest")), lambda x: answer(text, x)))

    def answer(text: Column, x: Column) -> Column:
        party, kind = x["party"], x["kind"]
        name = F.when(party == "", x["rest"]).otherwise(party)
        prefix = F.coalesce(first_case([(kind == k, F.lit(p)) for k, p in PREFIXES]), F.lit(""))
        alone = kind.isin("ATM", "CASH", "INTEREST", "CHARGES")
        whole = (F.when(name == "", "Unknown").when(alone, F.when(party == "", prefix).otherwise(F.concat(prefix, F.lit(" - "), party))).otherwise(F.concat(prefix, name)))
        size, up = F.octet_length(party), F.upper(party)
        points = lambda test, n: F.when(test, n).otherwise(0)
        known = first_case([(up.startswith(k), F.lit(True)) for k, _ in VENDORS]).isNotNull()
        sure = F.least(F.lit(99), 40 + points(kind != "OTHER", 15) + points(size >= 3, 15) + points(size >= 6, 10) + points(known, 15) + points(10 * F.octet_length(whole) < 8 * F.octet_length(text), 5)) / 100
        return F.struct(F.regexp_replace(F.trim(whole), r"\s+", " ").alias("cleaned"), kind.alias("txn_type"), party.alias("party"), payment_ref(text).alias("payment_ref"), sure.alias("confidence"))
    text = F.trim(F.coalesce(narration, F.lit("")))
    none = F.struct(F.lit("").alias("cleaned"), F.lit("OTHER").alias("txn_type"), F.lit("").alias("party"), F.lit("").alias("payment_ref"), F.lit(0.0).alias("confidence"))
    return F.when(text == "", none).otherwise(let(text, made))


def shown_cleaned(preserve: bool) -> Column:
    """Whether a list shows ``cleaned`` instead of the bank's text."""
    return F.lit(not preserve) & (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("cleaned") != "")


def is_category(head: Column) -> Column:
    return F.lower(head).rlike("|".join(CATEGORIES))


def is_part_of(short: Column, long: Column) -> Column:
    """Each word of ``short`` (arrays of upper-case words) begins a word of its own in ``long``, which has more words."""
    def take(state: Column, word: Column) -> Column:
        at = F.array_min(F.filter(F.sequence(F.lit(0), F.size(state["left"])), lambda i: F.startswith(F.get(state["left"], i), word)))
        left = F.filter(state["left"], lambda _, i: ~i.eqNullSafe(at))
        return F.struct((state["ok"] & at.isNotNull() & (F.length(word) >= 4)).alias("ok"), left.alias("left"))
    found = F.aggregate(short, F.struct(F.lit(True).alias("ok"), long.alias("left")), take)
    return (F.size(short) > 0) & (F.size(short) < F.size(long)) & found["ok"]


def canonical_parties(txns: DataFrame) -> DataFrame:
    """Raw, canonical: one spelling for each vendor and party head that stands in ``txns``.

    Names are counted once each. Spellings with the same words are one party, named by the first of its ledger names; a name
    made of beginnings of another's words goes to the one that stands on most rows. Candidates meet by the first four letters
    of the short name's first word.
    """
    name = F.explode(F.array(F.trim("vendor"), F.when((F.octet_length(F.trim("account_head")) >= 2) & ~is_category(F.col("account_head")), F.trim("account_head"))))
    raw = txns.select(name.alias("raw")).where(F.octet_length("raw") >= 1).groupBy("raw").agg(F.count("*").alias("n"))
    words = F.array_sort(F.split(F.upper("name"), " "))
    raw = raw.withColumn("name", ledger_name(F.col("raw"))).withColumn("words", words)
    one = raw.groupBy("words").agg(F.min(F.when(F.octet_length("raw") >= 2, F.col("name"))).alias("name"), F.sum("n").alias("n")).where("name IS NOT NULL")
    spoken = lambda c: F.split(F.upper(c), " ")
    short = one.select(F.col("words").alias("s_words"), spoken("name").alias("short")).withColumn("block", F.left(F.get("short", F.lit(0)), F.lit(4))).where("length(block) = 4")
    long = one.where("size(words) > 1").select(F.col("name").alias("whole"), F.col("n").alias("weight"), spoken("name").alias("long"))
    long = long.withColumn("block", F.explode(F.array_distinct(F.transform("long", lambda w: F.left(w, F.lit(4))))))
    merged = short.join(long, "block").where(is_part_of(F.col("short"), F.col("long"))).groupBy("s_words").agg(F.min(F.struct((-F.col("weight")).alias("w"), "whole"))["whole"].alias("whole"))
    named = one.join(merged, F.col("words") == F.col("s_words"), "left").select(F.col("words").alias("_words"), F.coalesce("whole", "name").alias("canonical"))
    return raw.join(named, F.col("words") == F.col("_words")).select("raw", "canonical")


def with_canonical(txns: DataFrame) -> DataFrame:
    """``txns`` with vendor and account_head in their one spelling, and ``renamed``: whether the vendor changed."""
    names = canonical_parties(txns)
    for c in ("vendor", "account_head"):
        own = names.select(F.col("raw").alias("_raw"), F.col("canonical").alias(f"_{c}"))
        txns = txns.join(own, (F.trim(c) == F.col("_raw")) & (F.lit(c == "vendor") | ~is_category(F.col(c))), "left").drop("_raw")
    vendor = F.coalesce("_vendor", "vendor")
    return txns.withColumn("renamed", ~vendor.eqNullSafe(F.col("vendor"))).withColumn("vendor", vendor).withColumn("account_head", F.coalesce("_account_head", "account_head")).drop("_vendor", "_account_head")
