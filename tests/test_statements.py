"""Banks, positioned tables, workbooks, reversed statements and batches against known values."""

import zipfile
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from bahikhata.operators import balances, banks, migrated
from bahikhata.sources import lines, positions, workbooks


def test_banks(spark):
    cases = [
        ("IFSC: SBIN0001234", "", "", [], ("State Bank of India", 0.98, "ifsc_labeled", False)),
        ("", "mail us at care@rblbank.com", "", [], ("RBL Bank", 0.95, "domain", False)),
        ("Bank of India Ltd", "", "", [], ("Bank of India", 0.855, "phrase", False)),
        ("Central Bank of India", "", "", [], ("Central Bank of India", 0.95, "phrase", False)),
        ("HDFC STATEMENT", "", "", [], ("HDFC Bank", 0.85, "abbrev_exact", False)),
        ("BOI", "", "", [], ("Bank of Baroda", 0.72, "abbrev_fuzzy", False)),
        ("x", "UPIAB/410969711856/CR/MRRAJES/SCBL/9773690640-2@y", "", [], ("", 0.0, "none", False)),
        ("x", "BULK POSTING-ACHCrHDFCBANKLTD-", "", [], ("", 0.0, "none", False)),
        ("x", "y", "Mahanager Co-operative bank.pdf", [], ("Mahanagar Co-operative Bank", 0.65, "filename", False)),
        ("x", "y", "", ["UTIB0000001 a", "b utib0000002"], ("Axis Bank", 0.55, "narration_ifsc", True)),
        ("x", "y", "", ["UTIB0000001 a"], ("", 0.0, "none", False)),
        (None, None, None, None, ("", 0.0, "none", False)),
    ]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, header_text string, text string, filename string, narrations array<string>")
    got = banks.with_bank(rows).orderBy("i").collect()
    assert [(r.bank_name, round(r.confidence, 4), r.method, r.needs_review) for r in got] == [c[4] for c in cases]


def test_bank_metadata(spark):
    said = "Account No: 50100123456789\nBranch Name: MG  Road, Pune\nIFSC : HDFC0001234\nPeriod: 01/04/2024 to 31/03/2025\nStatement ID: ABC-123456"
    r = spark.range(1).select(banks.metadata(F.lit(said)).alias("m"), banks.match_bank(F.lit("kotak bank")).alias("b"), banks.match_bank(F.lit("nothing here")).alias("n")).first()
    assert tuple(r.m) == ("5010XXXXXX6789", "HDFC0001234", "MG Road", "01/04/2024 to 31/03/2025", "ABC-123456") and (r.b, r.n) == ("Kotak Mahindra Bank", "")


def items(spark, rows):
    return spark.createDataFrame(rows, "file string, page int, row int, x double, w double, text string")


def test_positioned_header(spark):
    rows = [("a", 1, 0, 10.0, 30.0, "Account statement"), *[("a", 1, 2, x, w, t) for x, w, t in ((10.0, 20.0, "Txn"), (35.0, 20.0, "Date"), (150.0, 60.0, "Narration"), (300.0, 40.0, "Debit"), (400.0, 40.0, "Credit"), (500.0, 50.0, "Balance"))],
            *[("b", 1, 1, x, 40.0, t) for x, t in ((10.0, "Date"), (150.0, "Particulars"), (300.0, "DEBIT/"), (345.0, "CREDIT(Rs)"), (500.0, "Balance"))], ("c", 1, 0, 10.0, 5.0, "Date")]
    found = {r.file: (r.header_row, r.columns) for r in positions.header_of(items(spark, rows)).collect()}
    assert found["a"][0] == 2 and found["a"][1]["narration"] == 150.0 and (found["a"][1]["debit"], found["a"][1]["credit"]) == (300.0, 400.0)
    assert found["b"][0] == 1 and "debit" not in found["b"][1] and found["b"][1]["debitcredit"] == 300.0 and "c" not in found
    fences = {r.field: (r.x_min, r.x_max) for r in positions.bounds(positions.header_of(items(spark, rows)).where("file = 'a'")).collect()}
    assert fences["narration"] == (93.0, 225.0) and fences["balance"] == (450.0, float("inf"))


def test_cell_values(spark):
    rows = [("a", 1, 0, 10.0, 1.0, "Val"), ("a", 1, 0, 12.0, 1.0, "05/01/2024"), ("a", 1, 0, 60.0, 1.0, "(-)"), ("a", 1, 0, 62.0, 1.0, "4,85,878.84"), ("a", 1, 1, 60.0, 1.0, "12.50"), ("a", 1, 1, 62.0, 1.0, "7.25"), ("a", 1, 1, 10.0, 1.0, " x ")]
    fences = spark.createDataFrame([("a", "date", 0.0, 50.0), ("a", "balance", 50.0, float("inf"))], "file string, field string, x_min double, x_max double")
    got = {(r.row, r.field): r.cell for r in positions.cell_values(items(spark, rows), fences).collect()}
    assert got == {(0, "date"): "05/01/2024", (0, "balance"): "(-) 4,85,878.84", (1, "balance"): "7.25", (1, "date"): "x"}


def test_columns_without_header(spark):
    def page(file, columns, n):
        return [(file, 1, r, x, 10.0, t) for r in range(n) for x, t in columns]
    five = ((12.0, "05/01/2024"), (103.0, "NEFT PAYMENT"), (201.0, "123456789012.00"), (300.0, "Rs.500.25"), (402.0, "1,000.00"), (498.0, "2,295.02Cr"))
    plain = ((12.0, "5-1-24"), (103.0, "PAID TO A"), (300.0, "500.00"), (498.0, "700.00"))
    rows = page("a", five, 3) + page("b", plain, 2) + page("one", plain, 1) + page("only balance", (plain[0], plain[1], plain[3]), 3) + page("undated", plain[1:], 3)
    got = {r.file: r.columns for r in positions.inferred_columns(items(spark, rows)).collect()}
    assert got == {"a": {"date": 10.0, "narration": 100.0, "reference": 200.0, "debit": 300.0, "credit": 400.0, "balance": 500.0}, "b": {"date": 10.0, "narration": 100.0, "debit": 300.0, "balance": 500.0}}
    assert positions.inferred_columns(items(spark, rows).limit(0)).count() == 0


def test_reversed_statement(spark):
    d = Decimal
    rows = [("up", 1, date(2024, 1, 1), [d(100)], False, False, d(100)), ("up", 2, date(2024, 1, 2), [d(30)], False, False, d(70)), ("up", 3, None, [d(5), d(20)], False, False, d(90)), ("up", 4, date(2024, 1, 3), [d(7)], True, False, None),
            ("down", 1, date(2024, 1, 3), [d(40)], False, False, d(60)), ("down", 2, date(2024, 1, 2), [d(100)], False, False, d(100)), ("down", 3, None, [], False, False, d(0)), ("none", 1, None, [d(9), d(8)], None, None, None)]
    lines = spark.createDataFrame(rows, "file string, row_idx int, date date, amounts array<decimal(18,2)>, dr boolean, cr boolean, balance decimal(18,2)")
    got = {(r.file, r.row_idx): (r.debit, r.credit) for r in balances.sided(lines).collect()}
    assert got == {("up", 1): (None, d(100)), ("up", 2): (d(30), None), ("up", 3): (None, d(20)), ("up", 4): (d(7), None), ("down", 1): (d(40), None), ("down", 2): (None, d(100)), ("down", 3): (None, None), ("none", 1): (None, d(9))}


def test_batches(spark):
    files = spark.createDataFrame([(1, "/a/X.PDF"), (2, "/a/x.pdf"), (3, "/a/.csv"), (4, "y.b.csv"), (5, None)], "ord int, path string")
    assert tuple(migrated.batch_summary(migrated.batch_plan(files, ["pdf", "csv"])).first()) == (2, 2, 1)


def sheet(rows):
    cells = ("".join(f"<row>{''.join(r)}</row>" for r in rows))
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'


def test_workbooks(spark, tmp_path):
    main, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    said = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    number = lambda ref, v, style=0: f'<c r="{ref}" s="{style}"><v>{v}</v></c>'
    rows = [[said("A1", "Date"), said("B1", "Narration"), said("C1", "Debit"), said("D1", "Credit"), said("E1", "Balance")],
            [number("A2", 45292, 1), '<c r="B2" t="s"><v>0</v></c>', number("D2", 500.5), number("E2", 1500.5)], [number("A3", 45293, 1), said("B3", "RENT"), number("C3", 200), number("E3", 1300.5)]]
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        names = "".join(f'<sheet name="s{i}" sheetId="{i}" r:id="r{i}"/>' for i in (1, 2, 3))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets>{names}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2, 3))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><r><t>SAL</t></r><r><t>ARY</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", "<broken")
        z.writestr("xl/worksheets/sheet2.xml", sheet(rows))
        z.writestr("xl/worksheets/sheet3.xml", sheet(rows))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    cells = workbooks.workbook_cells(spark, f"file://{tmp_path}/*.xlsx")
    assert [r.cells for r in cells.where("sheet = 1 and row_idx = 1").collect()] == [["2024-01-01", "SALARY", "", "500.5", "1500.5"]]
    got = workbooks.workbook_rows(cells).orderBy("row_idx").collect()
    d = Decimal
    assert [(r.sheet, r.date, r.narration, r.debit, r.credit, r.balance) for r in got] == [(1, date(2024, 1, 1), "SALARY", None, d("500.50"), d("1500.50")), (1, date(2024, 1, 2), "RENT", d("200.00"), None, d("1300.50"))]


def test_lines_of_one_field(spark):
    said = ["Statement", "01/01/2024", "PAID", "9", "12.50", "100.00", "02/01/2024", "02/01/2024", "1,234,567", "7654321", "22,95,856.02Cr", "Particulars", "UPI A", "Page No2", "Rs.75", "UPI B", "Call us at 1", "03/01/2024", "5.00", "04/01/2024", "0.00", "1.00", "2.00"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(said)] + [("g", 0, "text"), ("g", 1, None), ("g", 2, "")], "file string, row_idx int, line string")
    got = [(str(r.date), r.narration, r.reference, [float(a) for a in r.amounts]) for r in lines.rejoined(df).orderBy("row_idx").collect()]
    assert got == [("2024-01-01", "PAID", None, [12.5, 100.0]), ("2024-01-02", "UPI A UPI B", "1234567", [75.0, 2295856.02]), ("2024-01-04", "TRANSACTION", None, [1.0, 2.0])]


def test_amounts_that_begin_like_a_channel_code(spark, tiny):
    """Orders 1007 and 11110: amounts of 11111 and more are amounts, with and without Cr; a channel code is left out."""
    said = ["01/01/2024", "PAID", "111115.72", "11111-CentralData", "1008.25", "02/01/2024", "PAID", "78.05", "11111.25Cr", "03/01/2024", "11111", "1,11,118.00", "Page 1 of 2"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(said)], "file string, row_idx int, line string")
    assert [[float(a) for a in r.amounts] for r in lines.rejoined(df).orderBy("row_idx").collect()] == [[111115.72, 1008.25], [78.05, 11111.25], [11111.0, 111118.0]]
