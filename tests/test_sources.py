import json
import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bahikhata.sources import delimited, dispatch, statements, text_lines
from bahikhata.streaming import imports

CSV = """Account Name: SOMEONE
Account No: 1234
Period: Jan

Date,Narration,Value Dt,Chq/Ref No.,Withdrawal Amt.,Deposit Amt.,Closing Balance
01/01/2024,SALARY CREDIT,01/01/2024,REF1,,"50,000.00","1,35,000.00"
02/01/2024,ATM WDL,02/01/2024,REF2,"10,000.00",,"1,25,000.00"
,CONTINUED LINE,,,,,
03/01/2024,"NEFT, CR",03/01/2024,REF3,,"80,000.00","2,05,000.00"
Total,,,,,,
"""


def test_csv_statement(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    rows = statements.statement_rows(delimited.csv_cells(spark, f"file://{tmp_path}/a.csv")).orderBy("row_idx").collect()
    assert [(r.date, r.narration, r.debit, r.credit, r.balance) for r in rows] == [
        (date(2024, 1, 1), "SALARY CREDIT", None, Decimal("50000.00"), Decimal("135000.00")), (date(2024, 1, 2), "ATM WDL CONTINUED LINE", Decimal("10000.00"), None, Decimal("125000.00")),
        (date(2024, 1, 3), "NEFT, CR", None, Decimal("80000.00"), Decimal("205000.00"))]


def test_no_header_no_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Name,Group\nX,Y\n")
    assert statements.statement_rows(delimited.csv_cells(spark, f"file://{tmp_path}/b.csv")).count() == 0


def test_columns_from_content(spark, tmp_path):
    (tmp_path / "d.csv").write_text('01/01/2024,SALARY CREDIT,,"50,000.00","1,35,000.00"\n02/01/2024,ATM WDL,"10,000.00",,"1,25,000.00"\n03/01/2024,"NEFT, CR",,"80,000.00","2,05,000.00"\n')
    (tmp_path / "e.csv").write_text("Txn Date,What,Withdrawal,Left\n01/01/2024,RENT,100.00,900.00\n02/01/2024,TEA,50.00,850.00\n03/01/2024,BUS,25.00,825.00\n")
    (tmp_path / "f.csv").write_text("Name,Group\nX,Y\nV,W\nT,U\n")
    cells = delimited.csv_cells(spark, f"file://{tmp_path}/*.csv")
    rows = [(r.file[-5], r.narration, r.debit, r.credit, r.balance) for r in statements.statement_rows(cells).orderBy("file", "row_idx").collect()]
    amount = lambda x: None if x is None else Decimal(x)
    assert rows == [(f, n, amount(d), amount(c), amount(b)) for f, n, d, c, b in (
        ("d", "SALARY CREDIT", None, "50000.00", "135000.00"), ("d", "ATM WDL", "10000.00", None, "125000.00"), ("d", "NEFT, CR", None, "80000.00", "205000.00"),
        ("e", "RENT", "100.00", None, "900.00"), ("e", "TEA", "50.00", None, "850.00"), ("e", "BUS", "25.00", None, "825.00"))]
    assert [r.file[-5] for r in statements.files_without_rows(cells).collect()] == ["f"]


def test_signed_column(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Date,Details,Debit/Credit,Balance\n05/01/2024,A,-100.00,900.00\n06/01/2024,B,+50.00,950.00\n")
    rows = statements.statement_rows(delimited.csv_cells(spark, f"file://{tmp_path}/c.csv")).orderBy("row_idx").collect()
    assert [(r.debit, r.credit) for r in rows] == [(Decimal("100.00"), None), (None, Decimal("50.00"))]


def test_ledgers_and_rules(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Name,Under\nCash,Cash-in-Hand\n ,X\n")
    assert [tuple(r) for r in statements.ledgers(delimited.csv_cells(spark, f"file://{tmp_path}/l.csv")).select("name", "group").collect()] == [("Cash", "Cash-in-Hand")]
    (tmp_path / "r.json").write_text(json.dumps({"version": 1, "rules": [{"pattern": "A \"B\"", "vendor": "V", "account_head": "H", "txn_type": "Payment"}]}))
    assert statements.rules_json(spark, f"file://{tmp_path}/r.json").first().pattern == 'A "B"'


def test_voucher_grid(spark):
    cells = spark.createDataFrame([("f", 0, ["Date", "Particulars", "Vch Type", "Vch No", "Debit", "Credit"]), ("f", 1, ["05/01/2024", "X", "Payment", "12", "1,000.00", ""]), ("f", 2, ["", "Y", "", "", "5.00", ""]), ("f", 3, ["06/01/2024", "Z", "Receipt", "13", "", "70.00"])], "file string, row_idx int, cells array<string>")
    rows = statements.tally_vouchers(cells).orderBy("row_idx").collect()
    assert [(r.amount, r.narration, r.voucher_no) for r in rows] == [(Decimal("1000.00"), "X", "12"), (Decimal("70.00"), "Z", "13")]


def test_rows_are_anchored_at_their_first_item(spark):
    items = spark.createDataFrame([("f", 1, t, float(x), float(y), 1.0) for t, x, y in (("b", 50, 10), ("a", 10, 14), ("c", 10, 16), ("d", 60, 20))], "file string, page int, text string, x double, y double, w double")
    rows = statements.clustered(items).orderBy("row")
    assert [[i.text for i in r.items] for r in rows.collect()] == [["a", "b"], ["c", "d"]]
    flat = rows.select("file", "page", "row", F.explode("items").alias("i")).select("file", "page", "row", "i.*")
    bounds = spark.createDataFrame([("f", "date", 0.0, 30.0), ("f", "narration", 30.0, 99.0)], "file string, field string, x_min double, x_max double")
    assert {(r.row, r.field): r.cell for r in statements.assigned(flat, bounds).collect()} == {(0, "date"): "a", (0, "narration"): "b", (1, "date"): "c", (1, "narration"): "d"}


def test_recognised_text(spark):
    said = ["Date Narration Amount Balance", "01/01/2024 OPENING SALARY 50,000.00 1,35,000.00", "02/01/2024 ATM WDL 10,000.00 1,25,000.00", "03/01/2024 NEFT CR 80,000.00 2,05,000.00", "abc", "TO  FRIEND", "7 eleven", "04/01/2024 UPI 209474387500bhaji 610.00 2,04,390.00",
            "05/01/2024 UPIAR/Cashfree/cfmer.33421130 40.00 2,04,350.00", "06/01/2024 N121243012696624CONNEXIONS 2024 2277239107622.0 350 50.00 2,04,400.00", "07/01/2024 nothing here"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(said)] + [("g", 0, said[2]), ("g", 1, said[1])], "file string, row_idx int, line string")
    rows = text_lines.transactions(df).orderBy("file", "row_idx").collect()
    money = lambda x: None if x is None else float(x)
    assert [(r.file, r.narration, r.reference, money(r.debit), money(r.credit), money(r.balance)) for r in rows] == [
        ("f", "OPENING SALARY", "", None, 50000.0, 135000.0), ("f", "ATM WDL", "", 10000.0, None, 125000.0), ("f", "NEFT TO FRIEND", "", None, 80000.0, 205000.0), ("f", "UPI209474387500", "bhaji", 610.0, None, 204390.0),
        ("f", "UPIAR/Cashfree/cfmer.33421130", "", 40.0, None, 204350.0), ("f", "N121243012696624CONNEXIONS 2024 2277239107622.0 350", "121243012696624", None, 50.0, 204400.0),
        ("g", "ATM WDL", "", 10000.0, None, 125000.0), ("g", "OPENING SALARY", "", None, 50000.0, 135000.0)]


def brute_records(text):
    """Records by one walk over all characters: a quote opens at the start of a field and closes at one that isn't doubled."""
    records, start, inside, fresh, i = [], 0, False, True, 0
    while i < len(text):
        c = text[i]
        if inside and c == '"':
            if text[i + 1:i + 2] == '"':
                i += 1
            else:
                inside = False
        elif not inside and c == '"' and fresh:
            inside = True
        elif not inside and c == "\n":
            records.append(text[start:i])
            start = i + 1
        fresh = not inside and c in ",\n"
        i += 1
    return records + ([text[start:]] if start < len(text) else []), inside


def test_quoted_line_breaks_over_byte_ranges(spark, tmp_path):
    """One file read in ranges of a few hundred bytes gives what one walk over its characters gives."""
    rng = random.Random(9)
    cell = lambda: rng.choice(["a", "", 'x"y', '"q,1"', '"two\nlines"', '"say ""hi""\n\n,"', 'p"', '"a"b', '"""\n"""', "plain text"])
    text = "\n".join(",".join(cell() for _ in range(rng.randrange(1, 7))) for _ in range(900)) + "\n"
    want, inside = brute_records(text)
    assert not inside and any("\n" in r for r in want)
    (tmp_path / "big.csv").write_text(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lined = delimited.lines(spark, f"file://{tmp_path}/big.csv")
        assert lined.select("block").distinct().count() > 20
        got = [r.record for r in delimited.records(lined).orderBy("row_idx").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want


def test_malformed_rows_are_errors(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,3\n')
    (tmp_path / "bytes.csv").write_bytes(b"a,b\n1,\xff\n")
    for name in ("open", "bytes"):
        with pytest.raises(Exception, match="malformed row 2"):
            delimited.csv_cells(spark, f"file://{tmp_path}/{name}.csv").collect()
    (tmp_path / "long.csv").write_text('"' + "x\n" * 50 + '"\n')
    with pytest.raises(Exception, match="malformed row 1"):
        delimited.records(delimited.lines(spark, f"file://{tmp_path}/long.csv"), most=20).collect()


def test_opening_and_closing_of_sheets(spark):
    def grid(file, rows):
        return [(file, i, r.split("|")) for i, r in enumerate(rows)]
    head = "Date|Narration|Debit|Credit|Balance"
    rows = grid("a", ["Opening Balance|5.50||||", head, "|b/f|||100.00", "01/01/2024|X|10.00||90.00", "|closing b/f|||90.00", "|late opening note|||80.00", "|closing again|||70.00"])
    rows += grid("b", ["x|closing balance|1.00|2.00", head, "01/01/2024|Y|10.00 Cr||90.00", "02/01/2024|Z||5.00 Dr|85.00", "||||60.00"])
    found, stated = statements.sheets(spark.createDataFrame(rows, "file string, row_idx int, cells array<string>"))
    money = lambda x: None if x is None else float(x)
    assert [(r.file, r.narration, money(r.debit), money(r.credit)) for r in found.orderBy("file", "row_idx").collect()] == [("a", "X late opening note closing again", 10.0, None), ("b", "Y", None, 10.0), ("b", "Z", 5.0, None)]
    assert sorted((r.file, money(r.opening), money(r.closing)) for r in stated.collect()) == [("a", 100.0, 90.0), ("b", 60.0, 2.0)]


def test_ledger_lists_with_their_own_headers(spark):
    rows = [("a", 0, ["Under", "Name"]), ("a", 1, ["Cash", "Till"]), ("b", 0, ["name", "x"]), ("b", 1, ["Bank", "y"]), ("c", 0, ["Title"]), ("c", 1, ["none"])]
    assert sorted(tuple(r) for r in statements.ledgers(spark.createDataFrame(rows, "file string, row_idx int, cells array<string>")).collect()) == [("a", "Till", "Cash"), ("b", "Bank", "")]


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.CSV").write_text("no reader for capitals in a glob")
    (tmp_path / "in" / "b.csv").write_text(CSV)
    (tmp_path / "in" / "c.txt").write_text("01/01/2024 SALARY 50,000.00 1,35,000.00\n02/01/2024 ATM WDL 10,000.00 1,25,000.00\n")
    (tmp_path / "in" / "d.txt").write_text("01/01/2024\nPAID\n12.50\n100.00\n02/01/2024\nGOT\n7.50\n107.50\n")
    (tmp_path / "in" / "e.txt").write_text("nothing\n")
    (tmp_path / "in" / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "g.xlsx").write_bytes(b"no zip")
    rows, report = dispatch.folder(spark, f"file://{tmp_path}/in")
    got = {(r.file[-5:], r.source): r.rows for r in report.collect()}
    assert got == {("a.CSV", None): 0, ("b.csv", "csv"): 3, ("c.txt", "lines"): 2, ("d.txt", "fields"): 2, ("e.txt", None): 0, ("f.pdf", None): 0, (".xlsx", None): 0}
    assert {(r.narration, r.debit is None) for r in rows.where("source = 'fields'").collect()} == {("PAID", True), ("GOT", True)}


def test_stream_keeps_rows_once(spark, tmp_path):
    schema = "client_id long, date_raw string, narration string, debit decimal(18,2), credit decimal(18,2)"
    land, table, mark = (f"file://{tmp_path}/{x}" for x in ("land", "table", "mark"))
    for rows in ([(1, "01/01/2024", "a", Decimal(5), None), (1, "01/01/2024", "a", Decimal(5), None)], [(1, "01/01/2024", "a", Decimal(5), None), (2, "01/01/2024", "a", Decimal(5), None)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(land)
        imports.import_stream(imports.landing(spark, land, schema), table, mark).awaitTermination()
    assert sorted(r.client_id for r in spark.read.parquet(table).collect()) == [1, 2]


def test_text_lines_overdrawn_and_late_years(spark):
    said = ["01/01/2251 ORDER N1 10.00 5.00", "02/01/2251 ORDER N2 8.00 -3.00", "03/01/2251 ORDER N3 10.00 -13.00"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(said)], "file string, row_idx long, line string")
    rows = text_lines.transactions(df, "9999").orderBy("row_idx").collect()
    assert [(r.date.year, r.narration, int(r.debit or 0), int(r.balance)) for r in rows] == [(2251, "ORDER N1", 0, 5), (2251, "ORDER N2", 8, -3), (2251, "ORDER N3", 10, -13)]
    assert all(r.date is None for r in text_lines.transactions(df).collect())


def test_fields_of_late_years(spark):
    said = ["01/01/2251", "ORDER N1", "10.00", "5.00", "02/01/2251", "ORDER N2", "8.00", "13.00"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(said)], "file string, row_idx long, line string")
    assert [len(rows.collect()) for _, rows in dispatch.of_text(df, "9999")] == [0, 2]


def test_records_tell_each_line_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n')
    found = delimited.records(delimited.lines(spark, f"file://{tmp_path}/a.csv"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "_out#" in plan and "regexp_replace" not in plan  # what a line does to quotes was once worked out anew for each running value
    assert {r.record for r in found.collect()} == {"a,b", '1,"x\ny"'}
