"""Chart-of-accounts groups: keyword weights on distinct heads, then amount and direction."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bahikhata.operators.ledger_words import LADDER, keyword_rows


def best_group(head: Column) -> Column:
    """The group of the largest total weight; ties go to the group that the table names first. Null if no word is met."""
    text, totals = F.lower(F.trim(head)), {}
    for word, weight, group, order in keyword_rows():
        totals.setdefault((order, group), []).append(F.when(F.contains(text, F.lit(word)), weight).otherwise(0))
    scores = [F.struct(sum(parts[1:], parts[0]).alias("score"), F.lit(-order).alias("first"), F.lit(group).alias("group")) for (order, group), parts in totals.items()]
    top = F.array_max(F.array(*scores))
    return F.when(top["score"] > 0, top["group"])


@cache
def ladder_groups() -> dict[str, str]:
    """The groups of the keyword ladder's heads, by the rule of ``best_group``; heads that meet no word are left out."""
    out = {}
    for head in {v[0] for v in LADDER} | {"Sundry Debtors", "Sundry Creditors"}:
        totals: dict[tuple[int, str], int] = {}
        for word, weight, group, order in keyword_rows():
            totals[order, group] = totals.get((order, group), 0) + (weight if word in head.lower().strip() else 0)
        (order, group), score = max(totals.items(), key=lambda x: (x[1], -x[0][0]))
        if score > 0:
            out[head] = group
    return out


def with_group(txns: DataFrame, overrides: DataFrame | None = None, from_ladder: bool = False) -> DataFrame:
    """Adds ``ledger_group``; ``overrides`` (head, group) come first. Heads are matched once each.

    ``from_ladder`` says that all heads are the keyword ladder's, those of a rail without a party, or empty: then their groups are a lookup and the rows are read once. Another head
    is an error.
    """
    if from_ladder:
        at = F.col("account_head")
        known = F.create_map(*[F.lit(x) for pair in sorted(ladder_groups().items()) for x in pair])
        named = sorted({v[0] for v in LADDER} | {"Sundry Debtors", "Sundry Creditors", ""})
        rows = txns.withColumn("_group", F.when(at.isin(*named), F.try_element_at(known, at)).when(at.isNotNull(), F.raise_error(F.concat(F.lit("not a head of the ladder: "), at))))
    else:
        heads = txns.select("account_head").distinct().select(F.col("account_head").alias("_head"), best_group(F.col("account_head")).alias("_group"))
        rows = txns.join(heads, F.col("account_head").eqNullSafe(F.col("_head")), "left")
    given = F.lit(None).cast("string")
    if overrides is not None:
        rows = rows.join(overrides.select(F.lower("head").alias("_o"), F.col("group").alias("_given")), F.lower(F.trim("account_head")) == F.col("_o"), "left")
        given = F.col("_given")
    credit, amount = F.col("credit").isNotNull(), F.coalesce("credit", F.lit(0)) + F.coalesce("debit", F.lit(0))
    rest = (F.when((amount >= 10000) & ~credit, "Sundry Creditors").when((amount >= 10000) & credit, "Sundry Debtors").when(credit, "Indirect Income").otherwise("Indirect Expenses"))
    return rows.withColumn("ledger_group", F.coalesce(given, F.col("_group"), rest)).drop("_head", "_group", "_o", "_given")


def party_group(head: Column, vendor: Column, receipt: Column) -> Column:
    return F.when((F.trim(head) == "") & (F.trim(vendor) != ""), F.when(receipt, "Sundry Debtors").otherwise("Sundry Creditors"))
