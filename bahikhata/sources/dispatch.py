"""Folders of mixed files: each file goes to the readers of its kind, and the first reader that gives rows is the file's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bahikhata.operators.balances import sided
from bahikhata.operators.scans import scanned
from bahikhata.operators.stages import kept
from bahikhata.sources import delimited, fixed, lines, pages, statements, text_lines, workbooks

# Kinds of files by the end of their names, in the order in which their readers are tried.
KINDS = {"csv": ("csv",), "xlsx": ("workbook",), "txt": ("lines", "fields")}
#: Folders whose names the driver holds.
MOST_FOLDERS = 10_000
COLUMNS = ("file", "row_idx", "date", "narration", "reference", "debit", "credit", "balance")


def kind_of(path: Column) -> Column:
    """The end of a file's name in lower case, or null for one that no reader takes."""
    end = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(end.isin(*KINDS), end)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind) of the files at ``path``; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), kind_of(F.col("path")).alias("kind"))


def chosen(readers: list[tuple[str, DataFrame]]) -> DataFrame:
    """COLUMNS and ``source`` of the rows of each file's first reader, in the order of the list, that gives any."""
    each = [rows.select("file", F.col("row_idx").cast("long").alias("row_idx"), *COLUMNS[2:], F.lit(name).alias("source"), F.lit(i).alias("_tier")) for i, (name, rows) in enumerate(readers)]
    every = kept(reduce(DataFrame.unionByName, each))
    first = every.groupBy("file").agg(F.min("_tier").alias("_tier"))
    return every.join(first, ["file", "_tier"]).select(*COLUMNS, "source")


def of_text(lined: DataFrame, last_year: str = "2099") -> list[tuple[str, DataFrame]]:
    """Readers of text (file, row_idx, line): a transaction a line, else a field a line."""
    fields = lines.rejoined(lined, last_year)
    last = F.element_at("amounts", -1)
    parts = fields.select("file", "row_idx", "date", "narration", F.coalesce("reference", F.lit("")).alias("reference"), F.slice("amounts", F.lit(1), F.size("amounts") - 1).alias("amounts"), last.alias("balance"), F.lit(False).alias("dr"), F.lit(False).alias("cr"))
    return [("lines", text_lines.transactions(lined, last_year)), ("fields", sided(kept(parts)))]


def of_items(items: DataFrame) -> list[tuple[str, DataFrame]]:
    """Readers of pages of text items: columns by places, else lines of fixed width."""
    at = kept(pages.placed(items))
    rows = lambda df: df.withColumnRenamed("row", "row_idx")
    return [("pages", rows(pages.page_transactions(items)[0])), ("fixed", rows(fixed.transactions(at)[0]))]


def report(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, kind, source, rows): what became of each file; source is null where no reader gave rows, and kind too where none takes it."""
    got = rows.groupBy("file").agg(F.first("source").alias("source"), F.count("*").alias("rows"))
    return files.join(got, "file", "left").select("file", "kind", "source", F.coalesce("rows", F.lit(0)).alias("rows"))


def folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The transactions of all files at ``path``, and the report."""
    files = kept(listed(spark, path))
    paths = {kind: [r["file"] for r in files.where(F.col("kind") == kind).select(F.regexp_replace("file", "[^/]+$", "*." + "".join(f"[{c}{c.upper()}]" for c in kind)).alias("file")).distinct().limit(MOST_FOLDERS + 1).collect()] for kind in KINDS}
    if any(len(p) > MOST_FOLDERS for p in paths.values()):
        raise ValueError(f"files lie in more than {MOST_FOLDERS} folders; give a path for each part")
    readers = []
    if paths["csv"]:
        readers.append(("csv", statements.statement_rows(delimited.csv_cells(spark, paths["csv"]))))
    if paths["xlsx"]:
        readers.append(("workbook", workbooks.workbook_rows(workbooks.workbook_cells(spark, paths["xlsx"]))))
    if paths["txt"]:
        readers += of_text(numbered(delimited.lines(spark, paths["txt"])))
    rows = chosen(readers) if readers else spark.createDataFrame([], "file string, row_idx long, date date, narration string, reference string, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), source string")
    return rows, report(files, rows)


def numbered(lined: DataFrame) -> DataFrame:
    """(file, row_idx, line) of ``delimited.lines``: row_idx counts a file's lines from 0."""
    return scanned(lined, ["file"], "at", sums={"row_idx": F.lit(1)}, stretch=F.col("block")).select("file", "row_idx", "line")
