"""Workbooks (.xlsx): sheets as ragged cells, and the first sheet that holds transactions.

Only the unpacking of a file is Python, a row at a time and in batches; headers, types and choice of the sheet are Spark's.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bahikhata.functions.dates import parse_date
from bahikhata.sources.statements import statement_rows

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ROW, _CELL, _V, _T = (_MAIN + n for n in ("row", "c", "v", "t"))
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_SCHEMA = "file string, sheet int, sheet_name string, row_idx int, cells array<string>"
_BATCH = 2000


def _tree(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else ElementTree.Element("none")


def _text(node) -> str:
    return "".join([t.text or "" for t in node.iter(_T)])


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a date: built-in formats 14 to 22, and own ones with a year or day in them."""
    tree = _tree(book, "xl/styles.xml")
    own = {int(f.get("numFmtId")) for f in tree.iter(f"{_MAIN}numFmt") if re.search("[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
    cells = tree.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if 14 <= int(x.get("numFmtId", 0)) <= 22 or int(x.get("numFmtId", 0)) in own}


def _value(cell, strings: list[str], dates: set[int]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _text(cell)
    raw = cell.findtext(_V) or ""
    if kind == "s":
        return strings[int(raw)]
    if kind in ("str", "b", "e", "d") or not raw:
        return raw
    number = float(raw)
    if int(cell.get("s", 0)) in dates:
        return (datetime(1899, 12, 30) + timedelta(days=number)).strftime("%Y-%m-%d")
    return str(int(number)) if number == int(number) else repr(round(number, 10))


def _column(ref: str) -> int:
    at = 0
    for c in ref:
        if c.isdigit():
            break
        at = at * 26 + ord(c) - 64
    return at - 1


def _rows(book: zipfile.ZipFile, name: str, strings: list[str], dates: set[int]) -> Iterator[tuple[int, list[str]]]:
    with book.open(name) as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag == _ROW:
                cells: list[str] = []
                for i, c in enumerate(row.iter(_CELL)):
                    ref = c.get("r")
                    at = _column(ref) if ref else i
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = _value(c, strings, dates)
                yield int(row.get("r", 0)) - 1, cells
                row.clear()


def _sheets(file: str, content: bytes) -> Iterator[tuple]:
    """The rows of a file's sheets in workbook order; what can't be read ends its sheet, or its file."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        links = {r.get("Id"): r.get("Target") for r in _tree(book, "xl/_rels/workbook.xml.rels")}
        named = [(s.get("name"), links.get(s.get(_LINK), "")) for s in _tree(book, "xl/workbook.xml").iter(f"{_MAIN}sheet")]
        strings = [_text(s) for s in _tree(book, "xl/sharedStrings.xml").iter(f"{_MAIN}si")]
        dates = _date_styles(book)
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError):
        return
    for i, (name, target) in enumerate(named):
        try:
            for n, (at, cells) in enumerate(_rows(book, target.lstrip("/") if target.startswith("/") else f"xl/{target}", strings, dates)):
                yield file, i, name, at if at >= 0 else n, cells
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, OverflowError):
            continue


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("sheet", pa.int32()), ("sheet_name", pa.string()), ("row_idx", pa.int32()), ("cells", pa.list_(pa.string()))])
    for batch in batches:
        for file, content in zip(batch.column("path"), batch.column("content")):
            rows = _sheets(file.as_py(), content.as_py())
            while held := list(islice(rows, _BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, sheet_name, row_idx, cells) of workbooks. A file is read whole by one task, many files by many.

    Cells that show a date are given as yyyy-mm-dd. Sheets and files that can't be read give the rows before the fault, or none.
    """
    return cells_of(spark.read.format("binaryFile").load(path))


def cells_of(files: DataFrame) -> DataFrame:
    """The cells of workbooks given as rows of (path, content)."""
    return files.select("path", "content").mapInArrow(_unpacked, _SCHEMA)


def workbook_rows(cells: DataFrame) -> DataFrame:
    """The transactions of each file's first sheet, in workbook order, that has any, with ``sheet``."""
    split = lambda part: F.element_at(F.split("file", "\n"), part)
    keyed = cells.select(F.concat_ws("\n", "file", F.col("sheet").cast("string")).alias("file"), "row_idx", "cells")
    rows = statement_rows(keyed).withColumn("sheet", split(2).cast("int")).withColumn("file", split(1))
    return rows.join(rows.groupBy("file").agg(F.min("sheet").alias("sheet")), ["file", "sheet"])


def reimported(cells: DataFrame) -> DataFrame:
    """Transactions of the sheet "Transactions" of exported workbooks, in its order, with ids ri_0, ri_1, ...

    A file needs the columns date, narration, vendor and account head, else it gives no rows. A row without date and narration is left out.
    What the sheet leaves open: a row with a vendor or head is classified by its user, with full confidence.
    """
    rows = cells.where("sheet_name = 'Transactions'").select("file", "row_idx", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("cells"))
    # The first row's places of the columns go along with the rows behind it: files are unpacked once.
    names = ("date", "narration", "reference", "debit", "credit", "balance", "vendor", "account head", "type", "status", "confidence", "tags", "bank name", "account no")
    low = F.transform("cells", lambda c: F.lower(c))
    in_order = Window.partitionBy("file").orderBy("row_idx")
    places = F.when(F.col("_row") == 1, F.struct(F.col("row_idx").alias("row"), *[F.array_position(low, n).cast("int").alias(n) for n in names]))
    rows = rows.withColumn("_row", F.row_number().over(in_order)).withColumn("_at", F.first(places, True).over(in_order))
    place = lambda name: F.col(f"_at.`{name}`")
    rows = rows.where((F.col("row_idx") > F.col("_at.row")) & (F.least(*[place(n) for n in ("date", "narration", "vendor", "account head")]) > 0))

    def cell(name: str) -> Column:
        return F.coalesce(F.get("cells", place(name) - 1), F.lit(""))

    def amount(name: str) -> Column:
        return F.nullif(F.regexp_replace(cell(name), "[^0-9.-]", "").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    word, known = F.lower(cell("status")), (cell("vendor") != "") | (cell("account head") != "")
    status = F.when(word == "suspense", "Suspense").when(word == "classified", "Classified").when(word.isin("needs_review", "review"), "NeedsReview").otherwise(F.when(known, "Classified").otherwise("Unreviewed"))
    kind = F.initcap(F.lower(cell("type")))
    rows = rows.where((cell("date") != "") | (cell("narration") != "")).withColumn("status", status)
    done = F.col("status") == "Classified"
    n = F.row_number().over(in_order) - 1
    return rows.select(
        "file", F.concat(F.lit("ri_"), n.cast("string")).alias("id"), parse_date(cell("date")).alias("date"), cell("narration").alias("narration"), cell("reference").alias("reference"), amount("debit").alias("debit"), amount("credit").alias("credit"),
        amount("balance").alias("balance"), cell("vendor").alias("vendor"), cell("account head").alias("account_head"), F.when(kind.isin("Payment", "Receipt", "Contra", "Journal"), kind).otherwise("Payment").alias("txn_type"), "status",
        F.coalesce(cell("confidence").try_cast("double"), F.when(done, 1.0).otherwise(0.0)).alias("confidence"), F.when(done, "user").otherwise("").alias("classification_source"),
        F.filter(F.transform(F.split(cell("tags"), ";"), lambda t: F.trim(t)), lambda t: t != "").alias("tags"), cell("bank name").alias("bank_name"), cell("account no").alias("account_no"))
