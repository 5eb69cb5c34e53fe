"""Edits of transactions as an appended list: what stays of them after undos, and what the rows then say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bahikhata.operators.scans import scanned

FIELDS = ("vendor", "account_head", "txn_type", "status", "confidence")


def standing(events: DataFrame, group: list[str], order: str) -> DataFrame:
    """The edits of (group, order, undo, ...) that no undo takes back; an undo takes the last edit of its group that still stands, or nothing.

    The height of the stack after an event is the running sum of pushes and pops less the lowest point that it had below the floor. An edit stands if the
    height never falls under its own again. All three are running values, so a group of any length is spread.
    """
    step = F.when(F.col("undo"), -1).otherwise(1)
    rows = events.withColumn("_step", step)
    rows = scanned(rows, group, order, sums={"_sum": F.col("_step")}).withColumn("_sum", F.col("_sum") + F.col("_step"))
    rows = scanned(rows, group, order, mins={"_low": F.col("_sum")})
    rows = rows.withColumn("_height", F.col("_sum") - F.least(F.lit(0), F.col("_sum"), F.coalesce("_low", F.lit(0))))
    rows = scanned(rows.withColumn("_back", -F.col(order)), group, "_back", mins={"_later": F.col("_height")})
    return rows.where(~F.col("undo") & (F.coalesce("_later", "_height") >= F.col("_height"))).drop("_step", "_sum", "_low", "_height", "_back", "_later")


def applied(table: DataFrame, events: DataFrame, group: list[str], key: str, order: str) -> DataFrame:
    """``table`` (group, key, FIELDS, classification_source) with the standing edits: of each field the last value that isn't null or empty.

    A row that was ever edited is classified by its user, undone or not: the stack doesn't hold the source.
    """
    stated = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    last = standing(events, group, order).groupBy(*group, key).agg(*[F.max_by(c, F.when(stated(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in FIELDS])
    touched = events.where(~F.col("undo")).groupBy(*group, key).agg(F.lit(True).alias("_touched"))
    rows = table.join(last, [*group, key], "left").join(touched, [*group, key], "left")
    source = F.when(F.col("_touched"), "user").otherwise(F.col("classification_source"))
    return rows.withColumns({**{c: F.coalesce(f"_{c}", c) for c in FIELDS}, "classification_source": source}).drop("_touched", *[f"_{c}" for c in FIELDS])
