"""Known values and row-by-row checks of what SQL can't say."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from bahikhata.functions import amounts, dates, text
from bahikhata.operators import balances, classify, duplicates, export, filters, groups, gst, recon, store
from bahikhata.plans.queries import bank_and_vouchers, coarse


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("day,narration,debit,credit,want", [("01/01/2024", "SALARY CREDIT", None, "50000", "75f7d949"), ("", "", None, None, "b21e1f5c"), ("01/01/2024", "ATM WDL", "5000", None, "cc231c89")])
def test_hash_vectors(spark, day, narration, debit, credit, want):
    dec = lambda v: F.lit(v).cast("decimal(18,2)")
    assert one(spark, text.txn_hash(F.lit(day), F.lit(narration), dec(debit), dec(credit))) == want


@pytest.mark.parametrize("value,want", [(1234567.5, "12,34,567.50"), (0, "0.00"), (999, "999.00"), (-100000, "-1,00,000.00"), (12345678901.25, "12,34,56,78,901.25")])
def test_indian_grouping(spark, value, want):
    assert one(spark, amounts.format_indian(F.lit(value).cast("decimal(18,2)"))) == want


@pytest.mark.parametrize("top,want", [(0, 1.0), (1, 1.0), (1.5, 2.0), (4.2, 5.0), (70, 100.0), (2000, 2000.0)])
def test_axis(spark, top, want):
    assert one(spark, amounts.nice_axis_max(F.lit(float(top)))) == want


def test_sheet_days(spark):
    assert one(spark, dates.excel_date(F.lit(45292.7))) == date(2024, 1, 1) and one(spark, dates.excel_date(F.lit(10.0))) is None


@pytest.mark.parametrize("narration,want", [
    ("UPI/000000000001/SHARMA TRADERS/PAYMENT", "SHARMA TRADERS"), ("NEFT CR-000000000002-MEHTA AND SONS", "MEHTA AND SONS"), ("IMPS P2A 000000000004 RAVI KUMAR", "RAVI KUMAR"), ("RTGS/HDFC0001234/PATEL STEEL WORKS", "PATEL STEEL WORKS"),
    ("UPI123456789012 a@ybl", ""), ("", ""), ("BY CASH", "CASH")])
def test_party_names(narration, want):
    assert classify.party_name(narration) == want


def txns(spark, rows):
    """(ord, narration, debit, credit, balance)"""
    df = spark.createDataFrame([(1, o, 7, "05/01/2024", n, "", d, c, b, "Unreviewed") for o, n, d, c, b in rows], "client_id long, ord long, account long, date_raw string, narration string, reference string, debit double, credit double, balance double, status string")
    df = df.withColumn("date", F.lit("2024-01-05").cast("date")).withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("debit", "credit", "balance")})
    return df.withColumns({"vendor": F.lit(""), "account_head": F.lit(""), "txn_type": F.lit("Unknown"), "confidence": F.lit(0.0), "classification_source": F.lit(""), "tags": F.array().cast("array<string>"), "dup_flag": F.lit(False)})


def test_running_balance_equals_the_loop(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        amount = rnd.randint(1, 500)
        out = rnd.random() < 0.5
        rows.append((i, "x", amount if out else None, None if out else amount, rnd.randint(0, 9000) if rnd.random() < 0.4 else None))
    rows = [tuple(None if v is None else (v if j < 2 else float(v)) for j, v in enumerate(r)) for r in rows]
    first = next(r for r in rows if r[4] is not None)
    run = first[4] - ((first[3] or 0) - (first[2] or 0))
    want = []
    for _, _, d, c, b in rows:
        want.append(run)
        run = b if b is not None else run - (d or 0) + (c or 0)
    got = [float(r.prev_balance) for r in balances.previous_balance(txns(spark, rows)).orderBy("ord").collect()]
    assert got == want


def test_direction_is_swapped_by_the_balance(spark):
    rows = [(1, "a", None, 100.0, 1000.0), (2, "b", 50.0, None, 1050.0), (3, "c", 10.0, None, 1040.0)]
    assert [(r.debit, r.credit, r.swapped) for r in balances.directed(txns(spark, rows)).orderBy("ord").collect()][1][2]


def test_classified_rows(spark):
    rules = spark.createDataFrame([(1, 0, "uber", "Uber", "Travel", "Payment", 1), (2, 1, "UBER TRIP", "", "Client Travel", "", 5)], "id long, client_id long, pattern string, vendor string, account_head string, txn_type string, priority int")
    rows = [(1, "UBER TRIP 1", 10.0, None, None), (2, "SWIGGY ORDER", 20.0, None, None), (3, "UPI/ABC/SHARMA TRADERS/X", None, 30.0, None), (4, "MYSTERY SHOP VISIT", 5.0, None, None), (5, "CASH DEP", None, 9.0, None)]
    base = txns(spark, rows)
    base = base.withColumn("status", F.when(F.col("ord") == 5, "Manual").otherwise(F.col("status")))
    got = {r.ord: (r.vendor, r.account_head, r.txn_type, r.confidence, r.status, r.classification_source) for r in classify.classified(base, rules).collect()}
    assert got[1] == ("", "Client Travel", "Payment", 0.9, "Classified", "rule")
    assert got[2] == ("Swiggy", "Food Expense", "Payment", 0.45, "Classified", "keyword")
    assert got[3] == ("SHARMA TRADERS", "SHARMA TRADERS", "Receipt", 0.45, "Classified", "keyword")
    assert got[4] == ("MYSTERY SHOP VISIT", "", "Payment", 0.0, "Unreviewed", "")
    assert got[5][4] == "Manual" and got[5][3] == 0.0
    again = classify.classified(classify.classified(base, rules).drop("changed", "tag", "party"), rules)
    assert not any(r.changed for r in again.collect())


@pytest.mark.parametrize("head,debit,credit,want", [("Sales Accounts", None, 5.0, "Sales Accounts"), ("Salaries", 5.0, None, "Indirect Expenses"), ("", 20000.0, None, "Sundry Creditors"), ("", None, 20000.0, "Sundry Debtors"), ("", None, 5.0, "Indirect Income"), ("", 10.0, None, "Indirect Expenses"), ("GST Payable", 1.0, None, "Duties & Taxes")])
def test_groups(spark, head, debit, credit, want):
    rows = txns(spark, [(1, "x", debit, credit, None)]).withColumn("account_head", F.lit(head))
    assert groups.with_group(rows).first().ledger_group == want
    given = spark.createDataFrame([(head.lower() or "none", "Mine")], "head string, group string")
    assert groups.with_group(rows, given).first().ledger_group == ("Mine" if head else want)


def test_gst_of_an_invoice(spark):
    g = gst.analysed(txns(spark, [(1, "IGST 18% GST 27ABCDE1234F1Z5 GOOGLE", 118.0, None, None), (2, "nothing", 1.0, None, None)])).orderBy("ord").collect()
    assert (g[0].gst.gst_rate, g[0].gst.gst_type, g[0].gst.gst_amount, g[0].gst.suggested_ledger, g[0].gst.confidence) == (18.0, "IGST", 18.0, "IGST Input (18%)", 0.99)
    assert g[1].gst is None


def test_like_duplicates_equal_the_loop(spark, tiny):
    rows = duplicates.like_narrations(coarse(spark, tiny)).collect()
    sets = {r.ord: {w for w in "".join(c if c.isalnum() else " " for c in r.narration.upper()).split() if len(w.encode()) >= 4} for r in rows}
    buckets = {}
    for r in sorted(rows, key=lambda r: r.ord):
        if not r.dup_hash and not r.dup_ref and r.status != "Manual":
            buckets.setdefault((r.account, r.date, r.debit or r.credit, r.debit is not None), []).append(r.ord)
    flagged = set()
    for ords in buckets.values():
        for i, a in enumerate(ords):
            for b in ords[i + 1:]:
                if a not in flagged and b not in flagged and sets[a] and sets[b] and len(sets[a] & sets[b]) / max(len(sets[a]), len(sets[b])) >= 0.5:
                    flagged.add(b)
    assert {r.ord for r in rows if r.dup_like} == flagged


def test_greedy_matches_equal_the_loop(spark):
    rnd = random.Random(9)
    pairs = list({(b, v): (b, v, rnd.choice([0.4, 0.5, 0.9])) for b, v in ((rnd.randint(0, 25), rnd.randint(0, 25)) for _ in range(160))}.values())
    used_b, used_v, want = set(), set(), set()
    for b, v, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if b not in used_b and v not in used_v:
            used_b.add(b)
            used_v.add(v)
            want.add((b, v, s))
    got = recon.greedy(spark.createDataFrame(pairs, "b long, v long, score double"))
    assert {(r.b, r.v, r.score) for r in got.collect()} == want


def test_report_uses_each_row_once(spark, tiny):
    bank, vouchers = bank_and_vouchers(spark, tiny)
    rows = recon.report(bank, vouchers).collect()
    b, v = [r.b for r in rows if r.b is not None], [r.v for r in rows if r.v is not None]
    assert sorted(b) == sorted(r.b for r in bank.collect()) and sorted(v) == sorted(r.v for r in vouchers.collect())
    assert recon.report_lines(recon.report(bank, vouchers)).first().line.count('"') == 8


def test_legs_balance(spark):
    rows = txns(spark, [(1, "a", 10.0, None, None), (2, "b", None, 20.0, None)])
    legs = export.journal_legs(rows, "Bank A/c").collect()
    assert sum(r.dr for r in legs) == sum(r.cr for r in legs) == 30.0 and {r.journal_no for r in legs} == {"BSP-00001", "BSP-00002"}


def test_published_table_is_swapped(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "client_id long, id string, v string")
    store.publish(first, path)
    new = store.upserted(spark.read.parquet(path).select(first.columns), spark.createDataFrame([(2, "b", "y"), (3, "c", "z")], first.schema), ["client_id", "id"])
    store.publish(new, path)
    assert sorted((r.client_id, r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]
    more = store.inserted(first, spark.createDataFrame([(1, "a", "q"), (4, "d", "n"), (4, "d", "o")], first.schema), ["client_id", "id"], "v")
    assert sorted((r.client_id, r.v) for r in more.collect()) == [(1, "x"), (2, "x"), (4, "n")]


def test_main_filter_words(spark):
    rows = txns(spark, [(1, "a b", 1.0, None, None), (2, "", None, 2.0, None)])
    ids = lambda *w: sorted(r.ord for r in filters.main_filter(rows, list(w)).collect())
    assert ids() == ids("anything") == [1, 2] and ids("credits") == [2] and ids("debits") == [1] and ids("needs_review") == [2] and ids("duplicates") == []


def test_date_buckets_lose_no_pair(spark):
    rnd = random.Random(2)
    day = date(2024, 1, 1)
    bank = [(i, day + timedelta(rnd.randint(0, 40)), float(rnd.choice([100, 100.4, 101, 0, 99.2, 5000])), "ABCD", "") for i in range(60)]
    vouchers = [(i, day + timedelta(rnd.randint(0, 40)), float(rnd.choice([100, 100.5, 101.9, 0, 98.9, 5049.9])), "ABCD EFGH", "") for i in range(60)]
    b = spark.createDataFrame(bank, "b long, date date, amount double, narration string, reference string").withColumn("account", F.lit(1)).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    v = spark.createDataFrame(vouchers, "v long, date date, amount double, narration string, voucher_no string").withColumn("account", F.lit(1)).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    near = lambda x, y: (x == y == 0) or (x > 0 and y > 0 and round(abs(x - y) * 100) * 100 <= round(max(x, y) * 100))
    want = {(x[0], y[0]) for x in bank for y in vouchers if abs((x[1] - y[1]).days) <= 6 and near(x[2], y[2])}
    assert {(r.b, r.v) for r in recon.candidates(b, v).collect()} == want


def test_recon_candidates_are_shuffled_and_not_broadcast(spark):
    """Spark's estimates don't see the buckets that a row stands in, so a side that looks small may be too large for the driver."""
    bank = spark.range(30).selectExpr("1L AS account", "id AS b", "date'2024-01-01' AS date", "CAST(id + 1 AS decimal(18,2)) AS amount", "'RENT' AS narration", "'' AS reference")
    vouchers = bank.selectExpr("account", "b AS v", "date", "amount", "narration", "'' AS voucher_no")
    pairs = recon.candidates(bank, vouchers)
    assert pairs.where("b = v").count() == 30
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_least_rung_is_the_first_that_holds_a_word(spark):
    rungs = [["OLA/", "XYZ"], ["RENT", "OLA"], ["RENTAL", "A.B"], ["LA/R"]]
    texts = ["RENTAL", "PAY OLA/RENT", "OLAX A.B", "A-B", "", "LA/R", "A.B XYZ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [next((i for i, ws in enumerate(rungs) if any(w in t for w in ws)), None) if t else None for t in texts]
    assert [r[0] for r in rows.select(classify.least_rung(F.col("t"), rungs)).collect()] == want
