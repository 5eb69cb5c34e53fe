"""Statement pages: the row reader against a plain loop, small statements by hand, and scans against plain windows."""

import random
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from bahikhata.operators import repairs, stages
from bahikhata.operators.scans import scanned
from bahikhata.sources import fixed, pages, statements

TYPED = "file string, row long, header_row long, day date, narration string, reference string, balance decimal(18,2), only boolean, debit decimal(18,2), credit decimal(18,2)"


def read(rows):
    """The rows of one file in order, with what a reader carries along: (transactions, opening, closing)."""
    txns, opening, closing, waiting, before, code, last = [], None, None, None, [], None, None
    for r in rows:
        day, text, debit, credit, balance = r["day"], r["narration"], r["debit"], r["credit"], r["balance"]
        low, bare = text.lower(), r["only"] and balance is not None
        if bare and any(w in low for w in pages.CLOSING_WORDS):
            closing = balance if closing is None else closing
            continue
        if bare and any(w in low for w in pages.OPENING_WORDS):
            opening = balance if opening is None else opening
            continue
        if bare and not text:
            if last and last["balance"] is None:
                last["balance"] = balance
            elif opening is None:
                opening = balance
            continue
        if text in ("Grand Total", "Page 2 of 9"):
            continue
        if day is None:
            if r["only"] and text:
                if not txns and balance is None:
                    before.append(text)
                elif balance is None and text.upper() in ("UPI", "NEFT-"):
                    code = text
                elif txns:
                    last["narration"] = f"{last['narration']} {text}".strip()
                    if last["balance"] is None:
                        last["balance"] = balance
            continue
        said = " ".join([*before, *([code] if code else []), *([text] if text else [])])
        before, code = [], None
        if debit is None and credit is None:
            if said:
                waiting = {"date": day, "narration": said, "reference": r["reference"], "balance": balance} if balance is not None else None
            continue
        last = {"row": r["row"], "date": day, "narration": said, "reference": r["reference"], "balance": balance}
        if waiting and not said:
            last |= waiting
        waiting = None
        last |= {"debit": debit, "credit": credit}
        txns.append(last)
    return txns, opening, closing


def test_rows_against_a_loop(spark):
    rng = random.Random(11)
    rows = []
    for f in range(8):
        for i in range(140):
            maybe = lambda share, f: f() if rng.random() < share else None
            money = lambda: Decimal(rng.randrange(1, 99999)) / 100
            debit, credit = maybe(0.3, money), maybe(0.2, money)
            text = rng.choice(["", "", "", "PAID", "Rent x", "UPI", "NEFT-", "Grand Total", "by opening deposit", "sum c/f", "Page 2 of 9", "more words"])
            rows.append({"file": str(f), "row": i, "header_row": 0, "day": maybe(0.5, lambda: date(2024, 1, 1) + timedelta(rng.randrange(90))), "narration": text, "reference": rng.choice(["", "R1"]),
                         "balance": maybe(0.5, money), "only": debit is None and credit is None, "debit": debit, "credit": credit})
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in TYPED.split(", ")) for r in rows], TYPED).repartition(3)
    found, stated = pages.transactions(df)
    got = {(r.file, r.row): (r.date, r.narration, r.reference, r.debit, r.credit, r.balance) for r in found.collect()}
    ends = {r.file: (r.opening, r.closing) for r in stated.collect()}
    want = {f: read([r for r in rows if r["file"] == f]) for f in map(str, range(8))}
    assert got == {(f, t["row"]): (t["date"], t["narration"], t["reference"], t["debit"], t["credit"], t["balance"]) for f, (txns, _, _) in want.items() for t in txns}
    assert ends == {f: (o, c) for f, (_, o, c) in want.items()}


def items(rows, file="f", page=1):
    return [(file, page, t, float(x), float(i * 12), 20.0) for i, r in enumerate(rows) for x, t in r]


ITEM = "file string, page int, text string, x double, y double, w double"
HEAD = [(10, "Date"), (100, "Narration"), (280, "Chq/Ref No."), (360, "Withdrawal Amt."), (440, "Deposit Amt."), (520, "Closing Balance")]


def found(spark, rows):
    txns, stated = pages.page_transactions(spark.createDataFrame(rows, ITEM))
    money = lambda x: None if x is None else float(x)
    return [(str(r.date), r.narration, r.reference, money(r.debit), money(r.credit), money(r.balance)) for r in txns.orderBy("file", "row").collect()], {r.file: (money(r.opening), money(r.closing)) for r in stated.collect()}


def test_statements_by_hand(spark):
    first = items([[(10, "HDFC Bank")], [(10, "Statement of Account")], HEAD, [(10, "01/01/2024"), (100, "SALARY CREDIT ACME"), (280, "SAL001"), (440, "50000.00"), (520, "135000.00")],
                   [(10, "02/01/2024"), (100, "ATM WDL BANDRA"), (360, "10000.00"), (520, "125000.00")]], "a", 1)
    first += items([HEAD, [(10, "05/01/2024"), (100, "SWIGGY"), (360, "850.00"), (520, "124150.00")], [(100, "ORDER")], [(100, "Closing Balance"), (520, "124150.00")], [(100, "Grand Total"), (360, "10850.00"), (440, "50000.00")]], "a", 2)
    bank = [[(10, "Date"), (100, "Narration"), (300, "Debit"), (380, "Credit"), (450, "Balance")]]
    waits = items([*bank, [(10, "01/01/2024"), (100, "NEFT FROM RAJESH"), (450, "1,25,000.00")], [(10, "01/01/2024"), (380, "25000.00")], [(10, "02/01/2024"), (100, "ATM WDL DADAR"), (300, "10000.00"), (450, "1,15,000.00")]], "b")
    broken = items([*bank, [(10, "25 May"), (100, "NEFT FROM X"), (380, "5.00")], [(10, "2024"), (100, "Y")], [(10, "03/Apr/20"), (100, "CASH"), (300, "7.00 Cr")], [(10, "25")], [(10, "26/05/2024"), (100, "RENT"), (300, "9.00")], [(10, "2024"), (300, "1.00")]], "c")
    got, stated = found(spark, first + waits + broken)
    assert got == [("2024-01-01", "SALARY CREDIT ACME", "SAL001", None, 50000.0, 135000.0), ("2024-01-02", "ATM WDL BANDRA", "", 10000.0, None, 125000.0), ("2024-01-05", "SWIGGY ORDER", "", 850.0, None, 124150.0),
                   ("2024-01-01", "NEFT FROM RAJESH", "", None, 25000.0, 125000.0), ("2024-01-02", "ATM WDL DADAR", "", 10000.0, None, 115000.0),
                   ("2024-05-25", "NEFT FROM X Y", "", None, 5.0, None), ("2025-04-03", "CASH", "", None, 7.0, None), ("2024-05-26", "RENT", "", 9.0, None, None)]
    assert stated["a"] == (None, 124150.0)


def test_pages_without_a_header(spark):
    """Columns from the content; the words and then the movement of the balance say the side."""
    rows = [[(10, f"{d:02d}/01/2024"), (100, text), (360, f"{amount}.00"), (440, "0.00"), (520, f"{balance}.00")] for d, text, amount, balance in
            ((1, "OPENING TRADE", 100, 900), (2, "CASH WD MAIN ROAD", 100, 800), (3, "REFUND SHOP", 50, 850), (4, "NOTHING SAID", 25, 875), (5, "NOTHING SAID", 75, 800))]
    got, _ = found(spark, items(rows))
    assert [(g[1], g[3], g[4]) for g in got] == [("OPENING TRADE", 100.0, None), ("CASH WD MAIN ROAD", 100.0, None), ("REFUND SHOP", None, 50.0), ("NOTHING SAID", None, 25.0), ("NOTHING SAID", 75.0, None)]


def test_scans_equal_windows(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5003).alias("at"), F.when(F.col("id") % 11 < 2, F.col("id")).alias("v")).repartition(5)
    before = Window.partitionBy("g").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("g", "at", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("s"), F.last("v", True).over(before).alias("l"), F.min("v").over(before).alias("m"))
    got = scanned(rows, ["g"], "at", sums={"s": F.col("v")}, lasts={"l": F.col("v")}, mins={"m": F.col("v")}, stretch=97).select("g", "at", "s", "l", "m")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def chain(rows, opening):
    running, out = opening, []
    for debit, credit, balance in rows:
        *now, what = repairs.step(running, debit, credit, balance)
        running = now[2]
        out.append((*now, what))
    return out


def test_misread_digits(spark):
    """One pass over a file against stretches of seven rows, with errors that nothing explains and rows without a balance."""
    rng = random.Random(4)
    files = {}
    for f in range(6):
        balance, rows = 5_000_000, []
        for _ in range(100):
            amount, up = rng.randrange(100, 999_999), rng.random() < 0.5
            balance += amount if up else -amount
            seen = amount
            if rng.random() < 0.2:
                digits = list(str(amount))
                digits[rng.randrange(len(digits))] = rng.choice("0123456789")
                seen = int("".join(digits))
            rows.append((None if up else seen, seen if up else None, None if rng.random() < 0.03 * (f % 3) else balance + (rng.choice([300, 70_000_000]) if rng.random() < 0.05 else 0)))
        files[str(f)] = rows
    dec = lambda x: None if x is None else Decimal(x) / 100
    df = spark.createDataFrame([(f, i * 3, *map(dec, r)) for f, rows in files.items() for i, r in enumerate(rows)], "file string, row long, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2)")
    openings = spark.createDataFrame([(f, dec(5_000_000)) for f in "0123"] + [("4", None)], "file string, opening decimal(18,2)")
    got = {(r.file, r.row): (r.debit, r.credit, r.balance, r.repaired) for r in repairs.repaired(df, openings, stretch=21).collect()}
    want = {(f, i * 3): (*map(dec, r[:3]), r[3]) for f, rows in files.items() for i, r in enumerate(chain(rows, 5_000_000 if f in "0123" else None))}
    assert got == want and {w[3] for w in want.values()} == {"", "amount", "balance"}
    assert repairs.recovered(206_000, 256_000) and not repairs.recovered(74_965_700, 14_965_700) and not repairs.recovered(56_000, 256_000) and not repairs.recovered(50_000, -50_000)


def test_fixed_width_by_hand(spark):
    head = "Date        Narration             Chq     Withdrawal        Deposit       Balance"
    lines = ["Some Bank", head, "-" * 60, "01-01-2024  Opening Balance                                           1,000.00Cr", "01-01-2024  SALARY                                       500.00       1,500.00Cr",
             "02/01/2024  ATM WDL                       200.00                      1,300.00Cr", "02/01/2024  MISPLACED                                    100.00       1,200.00 Dr", "99/99/2024  NO DAY  5.00  1.00Cr", "03-01-2024  NO AMOUNT  1,200.00Cr",
             "03-01-2024  CHQ 12.00                     300.00                        900.00Cr", "31-01-2024  Closing Balance 900.00Cr"]
    one = ["Date Details Amount Balance", "01-01-2024 UPI-CR/123456789/X 5.00 105.00Cr", "02-01-2024 PAID 123456789012.55 7.50 97.50Cr", "03-01-2024 SOMETHING 2.50 100.00Cr", "x", "y"]
    ragged = [(f, 1, t, float(x), i * 12.0, 5.0) for f, rows in (("a", lines), ("b", one)) for i, t in enumerate(rows) for x in (10,)]
    ragged += [("c", 1, t, float(x), i * 12.0, 5.0) for i, t in enumerate(lines) for x in (10, 200)]
    txns, stated = fixed.transactions(pages.placed(spark.createDataFrame(ragged, ITEM)))
    money = lambda x: None if x is None else float(x)
    got = [(r.file, r.narration, r.reference, money(r.debit), money(r.credit), money(r.balance)) for r in txns.orderBy("file", "row").collect()]
    assert got == [("a", "SALARY", "", None, 500.0, 1500.0), ("a", "ATM WDL", "", 200.0, None, 1300.0), ("a", "MISPLACED", "", 100.0, None, 1200.0), ("a", "CHQ", "12", 300.0, None, 900.0),
                   ("b", "UPI-CR/123456789/X", "123456789", None, 5.0, 105.0), ("b", "PAID 123456789012.55", "", 7.5, None, 97.5), ("b", "SOMETHING", "", None, 2.5, 100.0)]
    assert [(r.file, money(r.opening), money(r.closing)) for r in stated.collect()] == [("a", 1000.0, 900.0)]


def test_a_misread_balance_at_a_stretchs_end_runs_no_wave(spark, monkeypatch):
    """Behind it a stretch is wrong from its start to its end; the stretches behind that must not run again one by one."""
    runs = []
    monkeypatch.setattr(repairs, "kept", lambda df: runs.append(1) or df.checkpoint())
    stages.shared_dir(spark)
    seen = [("a", i, None, "10.00", f"{1000 + 10 * (i + 1) + (600_000 if i == 9 else 0)}.00") for i in range(140)]
    df = spark.createDataFrame(seen, "file string, row long, debit string, credit string, balance string").withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("debit", "credit", "balance")})
    openings = spark.createDataFrame([("a", "1000.00")], "file string, opening string").withColumn("opening", F.col("opening").cast("decimal(18,2)"))
    got = {r.row: (int(r.balance), r.repaired) for r in repairs.repaired(df, openings, stretch=10).collect()}
    assert got == {i: (1000 + 10 * (i + 1), "balance" if i == 9 else "") for i in range(140)} and len(runs) <= 16


def test_fixed_width_balances_below_nothing(spark):
    texts = ["Date  Particulars   Txn Amount  Balance", "01-01-2024  Opening Balance   10.00Cr"] + [f"{i:02d}-01-2024  ORDER {i}   8.00   {18 - 8 * i}.00Dr" for i in range(2, 7)]
    items = spark.createDataFrame([("a", 1, 12.0 * i, 10.0, 500.0, t) for i, t in enumerate(texts)], "file string, page int, y double, x double, w double, text string")
    rows = fixed.transactions(pages.placed(items))[0].orderBy("row").collect()
    assert [(int(r.debit), int(r.balance), r.narration) for r in rows] == [(8, 18 - 8 * i, f"ORDER {i}") for i in range(2, 7)]


def test_kept_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x
    rows = stages.kept(spark.range(100).select(counted("id").alias("id")))
    assert rows.count() == 100 and rows.agg(F.sum("id")).first()[0] == 4950
    assert seen.value == 100


def test_items_of_a_page_against_a_loop(spark):
    rng = random.Random(5)
    for tolerance in (5.0, 12.0):
        items = [("f", p, f"t{i}", float(rng.randint(0, 9)), float(rng.choice((rng.randint(0, 60), rng.randint(0, 400)))), 1.0) for p in range(3) for i in range(60)]
        found = {(r.page, r.row): [i.text for i in r["items"]] for r in statements.clustered(spark.createDataFrame(items, ITEM), tolerance).collect()}
        want = {}
        for p in range(3):
            row, start = -1, None
            for y, x, text in sorted((i[4], i[3], i[2]) for i in items if i[1] == p):
                if start is None or y - start > tolerance:
                    row, start = row + 1, y
                want.setdefault((p, row), []).append((x, text))
        assert found == {k: [t for _, t in sorted(v)] for k, v in want.items()}


def test_cells_need_no_shuffle_of_items(spark):
    rows = spark.createDataFrame([("a", 0, 5, [(10.0, "01/01/2024", 5.0), (100.0, "x", 5.0)])], "file string, page int, row long, items array<struct<x:double,text:string,w:double>>")
    columns = spark.createDataFrame([("a", 1, True, "date", 0.0, 50.0), ("a", 1, True, "narration", 50.0, float("inf"))], "file string, header_row long, two_sided boolean, field string, x_min double, x_max double")
    cells = pages.cells_of(rows, columns)
    assert [(r.row, r.date, r.narration, r.debit) for r in cells.collect()] == [(5, "01/01/2024", "x", "")]
    assert not any("items" in line and "Exchange" in line for line in cells._jdf.queryExecution().executedPlan().toString().splitlines())
