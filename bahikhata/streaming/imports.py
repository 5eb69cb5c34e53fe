"""Incremental imports as a stream: each micro-batch runs the batch pipeline and keeps only rows not seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bahikhata.functions.text import txn_hash


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hash", txn_hash(F.col("date_raw"), F.col("narration"), F.col("debit"), F.col("credit")))


def import_stream(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's new rows to ``table``/batch=N. A batch that is run again overwrites its own folder, so rows land once.

    Known hashes are the table's own: rows and hashes can't part, unlike two separate writes.
    """
    spark = rows.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        new = hashed(batch).dropDuplicates(["client_id", "hash"])
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            known = spark.read.parquet(table).where(F.col("batch") != number).select("client_id", "hash")
            new = new.join(known, ["client_id", "hash"], "left_anti")
        new.write.mode("overwrite").parquet(f"{table}/batch={number}")
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_within(events: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """First delivery of each event with bounded state: later ones within ``delay`` are dropped."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def hourly(events: DataFrame, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Counts and totals by hour and type, complete when the watermark passes."""
    return events.withWatermark(at, delay).groupBy(F.window(at, "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))


def landing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
