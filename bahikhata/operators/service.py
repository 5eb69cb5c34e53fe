"""Server-side lists and payment jobs: paged lists, latest rows, healing, exactly-once events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column | str], number: int = 1, size: int = 20) -> DataFrame:
    """A page of at most 100 rows; a total order makes pages disjoint."""
    size = max(1, min(size, 100))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def once(events: DataFrame, key: str, order: str) -> DataFrame:
    """The first delivery of each event."""
    return events.groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), order).alias("_e")).select(key, "_e.*")


def healed(local: DataFrame, remote: DataFrame, days: int, today: Column) -> DataFrame:
    """Local payments of the last ``days`` whose provider says otherwise: key, status, healed_status.

    A payment is looked up by provider reference, else by order; one found twice is ambiguous and stays.
    """
    recent = local.where(F.datediff(today, F.col("created")) <= days)
    named = recent.join(remote, F.col("provider_ref") == F.col("remote_ref"))
    ordered = recent.where("provider_ref is null").join(remote, F.col("order_ref") == F.col("remote_order"))
    hit = named.unionByName(ordered)
    of = hit.groupBy("payment_id", "status").agg(F.count("remote_status").alias("n"), F.max("remote_status").alias("remote_status"))
    mapped = F.when(F.col("remote_status") == "captured", "paid").when(F.col("remote_status").isin("failed", "expired"), "failed").when(F.col("remote_status") == "refunded", "refunded")
    return of.where("n = 1").withColumn("healed_status", mapped).where((F.col("healed_status").isNotNull()) & (F.col("healed_status") != F.col("status"))).select("payment_id", "status", "healed_status")


def rate_limited(requests: DataFrame, key: str, at: str, per_minute: int) -> DataFrame:
    """Adds ``allowed``: fewer than ``per_minute`` requests of the key in the minute before, this one apart."""
    window = Window.partitionBy(key).orderBy(F.col(at)).rangeBetween(-59, -1)
    return requests.withColumn("allowed", F.count("*").over(window) < per_minute)
