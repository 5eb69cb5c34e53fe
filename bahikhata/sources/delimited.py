"""Delimited files: lines in the order of their file, and records whose quoted fields may hold line breaks.

A file is read in byte ranges, one large file by many tasks. Whether a line begins inside quotes depends on all lines before it. Each line alone says what it does to
either state: it keeps both, turns both round, or ends in one whatever came; so the state is that of the last line of the third kind, turned by the
number of turns since, and both are running values. They are worked out inside each byte range for either state at its beginning, once; one row a range then says
which held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bahikhata.operators.stages import kept

#: A quoted field is open where a line starts or behind a comma; two quotes inside it are one.
_INSIDE = r'(?:[^"]++|"")*+'
_FIELD = rf',("{_INSIDE}"[^,]*|[^",][^,]*|)'
#: Lines that a record may span; an open quote that isn't closed within them is a malformed row.
MOST_LINES = 10_000


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, at, line): the lines of text files; ``at`` rises with their order in a file, ``block`` is the byte range that a line begins in."""
    return kept(_read(spark, path))


def _read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _ends_open(text: Column) -> Column:
    """Whether a text that begins outside quotes ends inside them: what is left of its quoted fields opens one."""
    return F.regexp_replace(text, f'(^|,)"{_INSIDE}"', "$1x").rlike('(^|,)"')


def records(lined: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """(file, row_idx, record): lines joined while a quote is open; a record keeps its line breaks. An open quote at the end of a file, or over more than ``most`` lines, is an error."""
    text, c = F.col("line"), F.col
    tail = F.regexp_replace(text, f'^{_INSIDE}"', "x")
    quoted = F.contains(text, F.lit('"'))
    rows = lined.withColumns({"_out": quoted & _ends_open(text), "_in": F.when(quoted & text.rlike(f'^{_INSIDE}"'), _ends_open(tail)).otherwise(True)})
    turns, fixed = c("_out") & ~c("_in"), c("_out") == c("_in")
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_turns": F.coalesce(F.sum(turns.cast("int")).over(before), F.lit(0)), "_n": F.count(F.lit(1)).over(before)})
    rows = rows.withColumn("_fixed", F.last(F.when(fixed, F.struct(c("_out").cast("int").alias("state"), c("_turns").alias("turns"))), True).over(before))
    # Where the range begins outside quotes (0) and where it begins inside (1): whether the line does, the records begun before it, the last line that began one.
    inside = {i: F.coalesce((c("_fixed.state") + c("_turns") - c("_fixed.turns")) % 2, (c("_turns") + i) % 2) == 1 for i in (0, 1)}
    rows = rows.withColumns({f"_inside{i}": inside[i] for i in inside}).drop("_fixed", "_turns")
    rows = kept(rows.withColumns({name: e for i in inside for name, e in (
        (f"_begun{i}", F.coalesce(F.sum((~c(f"_inside{i}")).cast("int")).over(before), F.lit(0))), (f"_began{i}", F.last(F.when(~c(f"_inside{i}"), c("_n")), True).over(before)))}))
    ended = lambda i: F.struct(F.when(c(f"_inside{i}"), c("_in")).otherwise(c("_out")).alias("inside"), (c(f"_begun{i}") + (~c(f"_inside{i}")).cast("int")).alias("begun"), F.when(c(f"_inside{i}"), c(f"_began{i}")).otherwise(c("_n")).alias("began"))
    ranges = rows.groupBy("file", "block").agg(F.max_by(F.struct((c("_n") + 1).alias("n"), ended(0).alias("e0"), ended(1).alias("e1")), "at").alias("_e"))
    # The ranges of a file are few: what each begins with comes from those before it.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turned = c("_e.e0.inside") & ~c("_e.e1.inside")
    ranges = ranges.withColumns({"_turns": F.coalesce(F.sum(turned.cast("int")).over(earlier), F.lit(0)), "_lines": F.coalesce(F.sum("_e.n").over(earlier), F.lit(0))})
    ranges = ranges.withColumn("_fixed", F.last(F.when(c("_e.e0.inside") == c("_e.e1.inside"), F.struct(c("_e.e0.inside").cast("int").alias("state"), c("_turns").alias("turns"))), True).over(earlier))
    ranges = ranges.withColumn("_from", (F.coalesce("_fixed.state", F.lit(0)) + c("_turns") - F.coalesce("_fixed.turns", F.lit(0))) % 2 == 1)
    ranges = ranges.withColumn("_end", F.when(c("_from"), c("_e.e1")).otherwise(c("_e.e0")))
    ranges = ranges.select("file", "block", "_from", "_lines", F.coalesce(F.sum("_end.begun").over(earlier), F.lit(0)).alias("_records"), F.last(c("_end.began") + c("_lines"), True).over(earlier).alias("_last"))
    rows = rows.join(ranges, ["file", "block"])
    told = lambda name: F.when(c("_from"), c(f"{name}1")).otherwise(c(f"{name}0"))
    rows = rows.select("file", "at", "line", "_in", "_out", told("_inside").alias("_inside"), (c("_records") + told("_begun")).alias("row_idx"), (c("_n") + c("_lines")).alias("_n"), F.coalesce(told("_began") + c("_lines"), c("_last")).alias("_began"))
    rows = rows.withColumn("_open", F.when(c("_inside"), c("_in")).otherwise(c("_out")))
    where = F.concat(F.lit("malformed row "), (c("row_idx") + (~c("_inside")).cast("int")).cast("string"), F.lit(" in "), c("file"))
    long = c("_inside") & (c("_n") - c("_began") >= most)
    rows = rows.withColumn("line", F.when(long, F.raise_error(where)).when(~F.is_valid_utf8("line"), F.raise_error(where)).otherwise(c("line")))
    rows = rows.withColumn("row_idx", c("row_idx") - c("_inside").cast("int"))
    # A line that is a record stays where it is; only lines of longer ones meet.
    alone = ~c("_inside") & ~c("_open")
    whole = rows.where(~alone).groupBy("file", "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("record"), F.max(F.struct("at", "_open"))["_open"].alias("open"))
    where = F.concat(F.lit("malformed row "), (c("row_idx") + 1).cast("string"), F.lit(" in "), c("file"))
    whole = whole.select("file", "row_idx", F.when(c("open"), F.raise_error(where)).otherwise(c("record")).alias("record"))
    return whole.unionByName(rows.where(alone).select("file", "row_idx", c("line").alias("record")))


def fields(record: Column) -> Column:
    """The trimmed fields of a record; a quote in a field that doesn't begin with one stands for itself."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(1))
    return F.transform(found, lambda c: F.trim(F.when(c.startswith('"'), F.replace(F.regexp_replace(c, f'(?s)^"({_INSIDE})"', "$1"), F.lit('""'), F.lit('"'))).otherwise(c)))


def csv_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row_idx, cells) of ragged files without a fixed header; empty lines are skipped but counted, a malformed row is an error."""
    rows = records(_read(spark, path))
    record = F.regexp_replace("record", "^\\ufeff", "")
    return rows.select("file", F.col("row_idx").cast("int").alias("row_idx"), record.alias("record")).where("record <> ''").select("file", "row_idx", fields(F.col("record")).alias("cells"))
