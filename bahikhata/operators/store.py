"""Tables on plain Parquet: upserts, insert-ignore, keyed deletes, published by renaming a finished folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``table`` with ``rows`` put over it by key; of rows with one key the last by ``order`` wins."""
    if order:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def inserted(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``table`` with those of ``rows`` whose keys it lacks; of new rows with one key the first by ``order``."""
    new = rows.join(table.select(*keys), keys, "left_anti")
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return table.unionByName(new)


def deleted(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def new_by_hash(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose (client_id, hash) isn't known: what an import keeps."""
    return rows.join(known, ["client_id", "hash"], "left_anti")


def batch_merged(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Of the rows of a batch of files (client_id, file_ord, hash, is_opening_balance, ...) those whose hash neither ``known`` (client_id, hash) nor an earlier file has.

    Rows of one file that are alike all stay, and so do opening rows, whose hashes count for later files.
    """
    first = rows.groupBy("client_id", "hash").agg(F.min("file_ord").alias("_first"))
    first = first.join(known.select("client_id", "hash", F.lit(True).alias("_known")).distinct(), ["client_id", "hash"], "left")
    new = (F.col("file_ord") == F.col("_first")) & F.col("_known").isNull()
    return rows.join(first, ["client_id", "hash"]).where(F.col("is_opening_balance") | new).drop("_first", "_known")


def batch_results(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """(client_id, file_ord, found, kept, skipped, bank_name): what became of each file; opening rows don't count, and every row's bank is its client's first file's."""
    real = lambda df: df.where(~F.col("is_opening_balance")).groupBy("client_id", "file_ord")
    kept = real(merged).agg(F.count("*").alias("kept"))
    bank = rows.groupBy("client_id").agg(F.min_by("bank_name", F.when(F.col("bank_name") != "", F.struct("file_ord", "ord"))).alias("bank_name"))
    each = real(rows).agg(F.count("*").alias("found")).join(kept, ["client_id", "file_ord"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return each.join(bank, "client_id").select("client_id", "file_ord", "found", "kept", (F.col("found") - F.col("kept")).alias("skipped"), "bank_name")


def rules_once(rules: DataFrame) -> DataFrame:
    """Of a client's rules with one pattern (case apart) the one with the smallest id."""
    first = rules.groupBy("client_id", F.upper("pattern").alias("_p")).agg(F.min("id").alias("id"))
    return rules.join(first.select("id"), "id", "left_semi")


def latest_edits(table: DataFrame, edits: DataFrame, key: str, order: str) -> DataFrame:
    """``table`` with the last edit of each row laid over it; edits are appended, so undo drops the last one."""
    last = edits.groupBy(key).agg(F.max_by(F.struct(*[c for c in edits.columns if c not in (key, order)]), order).alias("_e"))
    named = [f.name for f in last.schema["_e"].dataType]
    return table.join(last, key, "left").withColumns({c: F.coalesce(F.col(f"_e.{c}"), F.col(c)) for c in named}).drop("_e")


def publish(rows: DataFrame, path: str, partition: str = "client_id") -> None:
    """Writes beside ``path`` and swaps the folders when the write is whole; one writer at a time, and between the two renames a reader finds no table.

    ``catalog.commit`` has no such moment, and changes several tables together.
    """
    spark: SparkSession = rows.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.partitionBy(partition).parquet(new)
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.rename(at, jvm.org.apache.hadoop.fs.Path(old))
    fs.rename(jvm.org.apache.hadoop.fs.Path(new), at)
    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)
