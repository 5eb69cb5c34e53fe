"""The cells of a statement's rows as values, whatever kind of file they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bahikhata.functions.amounts import parse_amount
from bahikhata.functions.dates import parse_date

# Words of rows that state a balance.
OPENING_WORDS = ("opening", "brought forward", "b/f", "b/d")
CLOSING_WORDS = ("closing", "c/f", "carried forward")
_MONEY = "decimal(18,2)"


def holds(text: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def typed(rows: DataFrame) -> DataFrame:
    """(file, row, header_row, day, narration, reference, debit, credit, balance, only): text cells as values.

    A combined column's sign says the side; an amount in the debit column with Cr behind it, or with + where there is no credit column, is a credit, and one in the
    credit column with Dr a debit. ``only`` says that nothing but a balance could be read as an amount.
    """
    said, debit, credit = F.trim("debitcredit"), F.col("debit"), F.col("credit")
    one = parse_amount(said)
    down = (one < 0) | F.regexp_replace(said, "[₹ ,]", "").startswith("-")
    dr = F.when(said != "", F.when(down, F.abs(one))).otherwise(parse_amount(debit))
    cr = F.when(said != "", F.when(~down, one)).otherwise(parse_amount(credit))
    rows = rows.select("file", "row", "header_row", parse_date(F.col("date")).alias("day"), F.trim("narration").alias("narration"), F.trim("reference").alias("reference"), parse_amount(F.col("balance")).alias("balance"),
                       dr.alias("dr"), cr.alias("cr"), debit.alias("dr_text"), credit.alias("cr_text"), F.coalesce("two_sided", F.lit(False)).alias("two_sided"))
    both = F.lower(F.trim(F.concat("dr_text", "cr_text")))
    neither = F.col("dr").isNull() & F.col("cr").isNull()
    loose = parse_amount(F.regexp_replace(both, "^[drc ]+|[drc ]+$", ""))
    d = F.when(neither & F.contains(both, F.lit("dr")), loose).otherwise(F.when(F.col("cr").isNull(), F.abs("dr")).otherwise(F.col("dr")))
    c = F.when(neither & ~F.contains(both, F.lit("dr")) & F.contains(both, F.lit("cr")), loose).otherwise(F.when(F.col("dr").isNull(), F.abs("cr")).otherwise(F.col("cr")))
    rows = rows.withColumns({"only": neither, "d": d, "c": c})
    plus = F.regexp_replace("dr_text", "[₹ ,]", "").startswith("+") & ~F.col("two_sided")
    alone = lambda a, b: F.col(a).isNotNull() & F.col(b).isNull()
    up = alone("d", "c") & (plus | F.lower(F.rtrim("dr_text")).rlike(r"cr\.?$"))
    out = alone("c", "d") & F.lower(F.rtrim("cr_text")).rlike(r"dr\.?$")
    return rows.select("file", "row", "header_row", "day", "narration", "reference", "balance", "only", F.when(up, None).when(out, F.col("c")).otherwise(F.col("d")).cast(_MONEY).alias("debit"), F.when(out, None).when(up, F.col("d")).otherwise(F.col("c")).cast(_MONEY).alias("credit"))
