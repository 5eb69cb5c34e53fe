"""Rows of an older store brought into this one, and batches of files to import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States and voucher types that carry over; others fall back.
STATES = {"unreviewed": "Unreviewed", "classified": "Classified", "manual": "Manual", "suspense": "Suspense"}
VOUCHERS = ("Payment", "Receipt", "Contra", "Journal", "Sales", "Purchase")


def status(old: Column) -> Column:
    """Z8"""
    return F.coalesce(*[F.when(old == k, v) for k, v in STATES.items()], F.lit("Unreviewed"))


def voucher(old: Column) -> Column:
    return F.when(old.isin(*VOUCHERS), old).otherwise("Unknown")


def transactions(old: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with the client's new id (null where it has none), state and voucher type; a row without an id gets one from its content.

    ``ids`` has (legacy_client, client_id), one row a client. The scope 'global' has no client here and is told apart from unknown ones.
    """
    made = F.hex(F.xxhash64("date", "narration", "debit", "credit"))
    rows = old.join(ids, "legacy_client", "left").withColumns({"id": F.coalesce(F.nullif(F.col("id"), F.lit("")), made), "status": status(F.col("status")), "txn_type": voucher(F.col("txn_type"))})
    return rows.withColumn("outcome", F.when(F.col("legacy_client") == "global", "unsupported").when(F.col("client_id").isNull(), "failed").otherwise("imported"))


def counts(rows: DataFrame) -> DataFrame:
    """(found, imported, failed, unsupported) of ``transactions``."""
    return rows.agg(F.count("*").alias("found"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("imported", "failed", "unsupported")])


def batch_plan(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Adds name, supported and duplicate to files of (ord, path); a path met before, in any case of letters, is a duplicate."""
    again = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy("ord")) > 1
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    kind = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    return files.withColumns({"name": name, "supported": F.coalesce(kind.isin(*extensions), F.lit(False)), "duplicate": again})


def batch_summary(plan: DataFrame) -> DataFrame:
    """(ready, unsupported, duplicates) of a plan."""
    new = ~F.col("duplicate")
    return plan.agg(F.count_if(new & F.col("supported")).alias("ready"), F.count_if(new & ~F.col("supported")).alias("unsupported"), F.count_if("duplicate").alias("duplicates"))
