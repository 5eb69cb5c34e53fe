"""Duplicate transactions: repeated rows, repeated references, and like narrations on one day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bahikhata.functions.text import overlap, tokens, txn_hash

LIKE = 0.5


def first_of_each(txns: DataFrame) -> DataFrame:
    """Drops rows that repeat account, date, narration, amounts and balance; the first by ord stays."""
    key = Window.partitionBy("account", "date", "narration", "debit", "credit", "balance").orderBy("ord")
    return txns.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


def flagged(txns: DataFrame) -> DataFrame:
    """Adds dup_hash and dup_ref: second and later rows of a hash, then of a reference with its amount."""
    free = F.col("status") != "Manual"
    rows = txns.withColumn("hash", txn_hash(F.col("date_raw"), F.col("narration"), F.col("debit"), F.col("credit")))
    by_hash = F.row_number().over(Window.partitionBy("account", "hash", free).orderBy("ord"))
    rows = rows.withColumn("dup_hash", free & (by_hash > 1))
    amount, ref = F.coalesce("debit", "credit"), F.trim("reference")
    asks = free & ~F.col("dup_hash") & (F.length(F.regexp_replace(ref, "[^0-9]", "")) >= 4) & (amount > 0)
    by_ref = F.row_number().over(Window.partitionBy("account", ref, amount, asks).orderBy("ord"))
    return rows.withColumn("dup_ref", asks & (by_ref > 1))


def like_narrations(txns: DataFrame) -> DataFrame:
    """Adds dup_like: within a day, amount and direction, a row whose narration is like an earlier unflagged row's.

    The rule is sequential (a flagged row flags no other), so it is a fold over each bucket; equal token sets are judged
    once, so a bucket's work is quadratic only in its different narrations, and its rows carry keys alone.
    """
    rows = flagged(txns)
    amount = F.coalesce(F.when(F.col("debit") > 0, F.col("debit")), F.when(F.col("credit") > 0, F.col("credit")))
    open_ = rows.where(~F.col("dup_hash") & ~F.col("dup_ref") & (F.col("status") != "Manual") & amount.isNotNull())
    sets = open_.select("ord", "account", "date", amount.alias("amount"), F.col("debit").isNotNull().alias("out"), F.array_join(F.array_sort(tokens(F.col("narration"))), " ").alias("words"))
    # A set of words takes part once: its first row stands for it; its later rows are like the first, if it has words.
    first = Window.partitionBy("account", "date", "amount", "out", "words").orderBy("ord")
    sets = sets.withColumn("n", F.row_number().over(first))
    again = sets.where("n > 1 and words <> ''").select("ord")
    bucket = sets.where("n = 1 and words <> ''")

    order = F.array_sort(F.collect_list(F.struct("ord", F.split("words", " ").alias("w"))))
    start = F.struct(F.array().cast("array<array<string>>").alias("kept"), F.array().cast("array<bigint>").alias("out"))

    def judge(seen: Column, row: Column) -> Column:
        like = F.exists(seen["kept"], lambda other: overlap(other, row["w"]) >= LIKE)
        kept = F.when(like, seen["kept"]).otherwise(F.concat(seen["kept"], F.array(row["w"])))
        return F.struct(kept.alias("kept"), F.when(like, F.concat(seen["out"], F.array(row["ord"]))).otherwise(seen["out"]).alias("out"))
    judged = bucket.groupBy("account", "date", "amount", "out").agg(order.alias("_rows")).where("size(_rows) > 1")
    found = judged.select(F.explode(F.aggregate("_rows", start, judge)["out"]).alias("ord")).unionByName(again).select(F.col("ord").alias("_o"))
    return rows.join(found, F.col("ord") == F.col("_o"), "left").withColumn("dup_like", F.col("_o").isNotNull()).drop("_o")


def tagged(rows: DataFrame) -> DataFrame:
    """dup_flag and the tag DUP, once, for rows that any pass has flagged."""
    hit = F.lit(False)
    for c in ("dup_hash", "dup_ref", "dup_like"):
        hit = hit | F.col(c) if c in rows.columns else hit
    tags = F.when(hit & ~F.array_contains("tags", "DUP"), F.array_append("tags", "DUP")).otherwise(F.col("tags"))
    return rows.withColumns({"dup_flag": F.col("dup_flag") | hit, "tags": tags})
