"""Rows in one global order, dealt over tasks: ranges of a key whose first keys are known to every task."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input that a range stands for, and ranges at most: their first keys go to every task; beyond, ranges grow and are streamed.
RANGE_BYTES, RANGES = 64 << 20, 10_000
#: Bytes that a Python worker holds at once, besides the largest row.
BATCH_BYTES = 4 << 20


def byte_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches end at so many rows or at BATCH_BYTES, whichever comes first."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def how_many(rows: DataFrame) -> int:
    """Ranges for rows: the session's shuffle partitions, or one a RANGE_BYTES of Spark's estimate of them if that is more."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(RANGES, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)))


def firsts(keys: DataFrame, n: int) -> list[tuple]:
    """The first key of each of up to ``n`` ranges of nearly equal numbers of rows, in order.

    Spark's own range partitioning samples the keys; one row a range comes to the driver. Keys have no nulls, and equal keys stay together.
    """
    names = keys.columns
    dealt = keys.repartitionByRange(n, *names).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(F.struct(*names)).alias("k"))
    return sorted((tuple(r["k"]) for r in dealt.select("k").collect()), key=lambda k: tuple(x.encode() if isinstance(x, str) else x for x in k))


def as_array(bounds: list[tuple], keys: DataFrame) -> Column:
    """First keys as an array of structs with the names and types of ``keys``."""
    schema = keys.select(F.array(F.struct(*keys.columns)).alias("b")).schema["b"].dataType
    plain = lambda x: x.isoformat() if isinstance(x, datetime.date) else x
    return F.from_json(F.lit(json.dumps([dict(zip(keys.columns, map(plain, b))) for b in bounds])), schema.simpleString())


def range_of(key: Column, bounds: Column, n: int) -> Column:
    """The number of the range that ``key`` lies in, found by halving: the last whose first key isn't above it (0 for a key before all)."""
    steps = [1 << i for i in reversed(range(max(1, n.bit_length())))]
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(bounds, at + s - 1) <= key), at + s).otherwise(at))
    return F.greatest(found - 1, F.lit(0))
