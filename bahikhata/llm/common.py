"""What the training-data operators share: the shared folder, written tables, prefix sums."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the contracts on whole texts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
FILE_BYTES = 128 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder that stands in for spark.checkpoint.dir in tests.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset and Spark is local (tests) one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='bahikhata-')}")
        where = _OWN[-1]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Written tables of the innermost ``scratch``.
_MADE: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end the tables that were written inside it, but those in the list it gives. Nothing that is still to be read may need them."""
    made, stay = [], []
    _MADE.append(made)
    try:
        yield stay
    finally:
        _MADE.remove(made)
        for path in made:
            if path not in stay:
                removed(spark, path)
            elif _MADE:
                _MADE[-1].append(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def compact(df: DataFrame, thin: bool = False) -> DataFrame:
    """df in no more partitions than a few a core, or one a FILE_BYTES of estimated size if that is more.

    Small files cost a folder entry, a process for its permissions and a footer each. ``thin`` says that rows are a few numbers, so a
    few partitions a core are enough whatever the estimate (joins overestimate).
    """
    n = 4 * df.sparkSession.sparkContext.defaultParallelism
    if not thin:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        n = max(n, size // FILE_BYTES)
    return df.coalesce(min(n, 1_000_000))


def written(df: DataFrame, tag: str, compression: str = "zstd", thin: bool = False) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs one read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    compact(df, thin).write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows that a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def with_offsets(df: DataFrame, group: list[str], order: str, size: str, out: str, buckets: int) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of ``group`` before this one by the bigint ``order``.

    A running sum in two steps, so no group sits in one task: rows are dealt into ``buckets`` ranges of the
    64-bit ``order`` (the hash of a unique key, so even and without ties), summed inside each range, and each range starts after the totals of
    those before it. One row per group and range is all that the second window sees.
    """
    cut = F.floor(F.col(order).cast("double") / F.lit(2.0 ** 64 / buckets) + buckets / 2).cast("int")
    return running(df.withColumn("_range", F.greatest(F.lit(0), F.least(cut, F.lit(buckets - 1)))), group, order, size, out)


def with_numbers(df: DataFrame, group: list[str], out: str) -> DataFrame:
    """Adds ``out``: 0, 1 .. for the rows of ``group``, in the order of ``_row``.

    ``_row`` is a stored monotonically_increasing_id; each partition that it names is numbered by itself, so a group of any size
    is spread as the rows are.
    """
    return running(df.withColumn("_range", F.shiftright("_row", 33).cast("int")).withColumn("_one", F.lit(1)), group, "_row", "_one", out).drop("_one")


def running(df: DataFrame, group: list[str], order: str, size: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of ``group`` before this one by ``order``; ``_range`` (dropped) rises with it and says what is summed together."""
    totals = df.groupBy(*group, "_range").agg(F.sum(size).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"),
                           F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    same = F.col("_r") == F.col("_range")
    for i, c in enumerate(group):
        same = same & F.col(f"_g{i}").eqNullSafe(F.col(c))
    return (df.join(totals, same).withColumn(out, F.col("_base") + F.col("_in"))
            .drop("_range", "_r", "_base", "_in", *[f"_g{i}" for i in range(len(group))]))
