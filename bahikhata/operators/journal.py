"""Audit events that are appended once, rules as documents, settings by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bahikhata.operators.store import upserted

#: Events that a client's list shows.
SHOWN = 500


def appended(events: DataFrame, path: str, batch: int) -> None:
    """Adds events (client_id, n, event) under ``path``/batch=N. A batch that is run again replaces its own folder, so its events are there once."""
    events.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def shown(spark: SparkSession, path: str, most: int = SHOWN) -> DataFrame:
    """(client_id, place, event): each client's last ``most`` events, the newest first.

    Each of 64 parts of a client keeps its newest, so what meets in one place is bounded for a client of any number of events.
    """
    rows = spark.read.parquet(path).select("client_id", F.struct(F.col("batch").cast("long").alias("batch"), "n", "event").alias("e"))
    part = Window.partitionBy("client_id", "_piece").orderBy(F.desc("e"))
    pieces = rows.withColumn("_piece", F.pmod(F.xxhash64("e"), F.lit(64))).withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= most)
    place = F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("e")))
    return pieces.withColumn("place", place).where(F.col("place") <= most).select("client_id", "place", F.col("e.event").alias("event"))


def rule_documents(rules: DataFrame) -> DataFrame:
    """(client_id, text): each client's rules, by priority and pattern, as the document that ``statements.rules_json`` reads."""
    one = F.struct("pattern", "vendor", "account_head", "txn_type")
    rows = rules.groupBy("client_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "pattern", one.alias("rule")))), lambda r: r["rule"]).alias("rules"))
    return rows.select("client_id", F.to_json(F.struct(F.lit(1).alias("version"), "rules")).alias("text"))


def settings(table: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """(key, value) with ``changes`` put over it, the last by ``order`` of each key; a null value removes the key."""
    return upserted(table.select("key", "value"), changes.groupBy("key").agg(F.max_by("value", order).alias("value")), ["key"]).where("value is not null")
