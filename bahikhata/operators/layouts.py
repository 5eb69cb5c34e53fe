"""Files of accounting programs: journals, voucher documents, the sections of the report, and workbooks.

A document is rows of (client_id, section, ord, line): written sorted, a client's parts in order make its file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bahikhata.functions.amounts import format_indian
from bahikhata.operators import analytics, groups
from bahikhata.operators.export import csv_field, escaped, numbered, voucher_element, voucher_xml
from bahikhata.operators.filters import classification_basis, export_voucher, party_group, posting_ledger


def _day(pattern: str) -> Column:
    return F.coalesce(F.date_format("date", pattern), F.lit(""))


def _legs(txns: DataFrame, bank_ledger: str, narrations: bool) -> DataFrame:
    """Two rows a transaction, ``leg`` 1 the bank's: a receipt debits the bank, anything else credits it."""
    amount = F.format_string("%.2f", F.coalesce("debit", "credit", F.lit(0)).cast("double"))
    receipt, none = export_voucher(tally=False) == "Receipt", F.lit("0.00")

    def leg(no: int, ledger: Column, kind: str, debit: Column) -> Column:
        return F.struct(F.lit(no).cast("long").alias("leg"), ledger.alias("ledger"), F.lit(kind).alias("kind"),
                        F.when(debit, amount).otherwise(none).alias("dr"), F.when(debit, none).otherwise(amount).alias("cr"))
    legs = F.array(leg(1, F.lit(bank_ledger), "Bank", receipt), leg(2, posting_ledger(), "Expense", ~receipt))
    rows = txns.withColumn("_said", F.col("narration") if narrations else F.lit(""))
    return rows.select("*", F.explode(legs).alias("_l")).select("*", "_l.*").drop("_l")


def _laid(legs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return legs.select("client_id", "ord", "leg", *[c.alias(n) for n, c in columns.items()])


def zoho(txns: DataFrame, bank_ledger: str, currency: str = "INR", gst: bool = False, narrations: bool = True) -> DataFrame:
    """K7: with ``gst`` the posting leg carries gst_type and gst_rate, where a row has both."""
    c, empty = F.col, F.lit("")
    taxed = (c("leg") == 2) & c("gst_type").isNotNull() & c("gst_rate").isNotNull() if gst else F.lit(False)
    tax = lambda v: F.when(taxed, v).otherwise("") if gst else empty
    return _laid(_legs(numbered(txns, "BSP-"), bank_ledger, narrations), {
        "JournalDate": _day("yyyy-MM-dd"), "JournalNumber": c("journal_no"), "Notes": c("_said"), "ReferenceNumber": c("reference"), "CurrencyCode": F.lit(currency),
        "Account": c("ledger"), "AccountType": c("kind"), "ContactName": c("vendor"), "Description": c("_said"), "Debit": c("dr"), "Credit": c("cr"), "Tags": empty,
        "TaxName": tax(c("gst_type")) if gst else empty, "TaxType": tax(F.when(c("debit").isNotNull(), "Purchase Tax").otherwise("Sales Tax")),
        "TaxPercentage": tax(F.format_string("%.2f", c("gst_rate"))) if gst else empty})


def quickbooks(txns: DataFrame, bank_ledger: str, narrations: bool = True) -> DataFrame:
    """K8"""
    c = F.col
    return _laid(_legs(numbered(txns, "BSP"), bank_ledger, narrations), {
        "Date": _day("MM/dd/yyyy"), "JournalNo": c("journal_no"), "Memo": c("_said"), "AccountName": c("ledger"), "Debit": c("dr"), "Credit": c("cr"), "Name": c("vendor")})


def odoo(txns: DataFrame, bank_ledger: str, narrations: bool = True) -> DataFrame:
    """K9: journal entries aren't numbered, so nothing is shuffled."""
    c = F.col
    return _laid(_legs(txns, bank_ledger, narrations), {
        "date": _day("yyyy-MM-dd"), "move_type": F.lit("entry"), "name": c("_said"), "partner_id/name": c("vendor"), "account_id/code": c("ledger"),
        "debit": c("dr"), "credit": c("cr"), "narration": c("_said"), "ref": c("reference")})


def _framed(body: DataFrame, head: Column, foot: Column) -> DataFrame:
    """``body`` of (client_id, section, ord, line) between each client's first and last lines."""
    edges = F.array(*[F.struct(F.lit(n).alias("section"), F.lit(0).cast("long").alias("ord"), line.alias("line")) for n, line in ((0, head), (9, foot))])
    return body.unionByName(body.select("client_id").distinct().select("client_id", F.explode(edges).alias("e")).select("client_id", "e.*"))


def tally(txns: DataFrame, bank_ledger: str, company: str = "", opening: DataFrame | None = None, masters: bool = True, narrations: bool = True) -> DataFrame:
    """K6: each client's document: ledgers by name (1), the opening journal (2), vouchers (3).

    A ledger takes the group of its first row; one that is only a party's name goes by the voucher. ``opening`` has (client_id, balance).
    Needs ``ledger_group`` for the masters.
    """
    wrap = lambda inner: F.concat(F.lit('        <TALLYMESSAGE xmlns:UDF="TallyUDF">'), inner, F.lit("</TALLYMESSAGE>"))
    vouchers = voucher_xml(txns if narrations else txns.withColumn("narration", F.lit("")), bank_ledger)
    body = vouchers.select("client_id", F.lit(3).alias("section"), F.col("ord").cast("long").alias("ord"), wrap(F.col("xml")).alias("line"))
    if masters:
        party = groups.party_group(F.col("account_head"), F.col("vendor"), export_voucher(tally=True) == "Receipt")
        posted = txns.select("client_id", "ord", posting_ledger().alias("ledger"), F.coalesce(party, F.col("ledger_group")).alias("parent"))
        first = posted.groupBy("client_id", "ledger").agg(F.min_by("parent", "ord").alias("parent"))
        if bank_ledger:
            banks = txns.select("client_id").distinct().select("client_id", F.lit(bank_ledger).alias("ledger"), F.lit("Bank Accounts").alias("parent"))
            first = banks.unionByName(first.where(F.col("ledger") != bank_ledger))
        name = escaped(F.col("ledger"))
        line = wrap(F.concat(F.lit('<LEDGER NAME="'), name, F.lit('" ACTION="Create"><NAME>'), name, F.lit("</NAME><PARENT>"), escaped(F.col("parent")), F.lit("</PARENT></LEDGER>")))
        n = F.row_number().over(Window.partitionBy("client_id").orderBy("ledger")).cast("long")
        body = body.unionByName(first.select("client_id", F.lit(1).alias("section"), n.alias("ord"), line.alias("line")))
    if opening is not None:
        start = txns.groupBy("client_id").agg(F.min_by("date", "ord").alias("date")).join(opening, "client_id").where("balance is not null")
        amount = F.format_string("%.2f", F.col("balance").cast("double"))
        said = F.lit("Opening Balance" if narrations else "")
        line = wrap(voucher_element(F.lit("Journal"), said, F.lit(bank_ledger), F.lit("Capital Account"), amount))
        body = body.unionByName(start.select("client_id", F.lit(2).alias("section"), F.lit(1).cast("long").alias("ord"), line.alias("line")))
    head = F.lit("\n".join(('<?xml version="1.0" encoding="UTF-8"?>', "<ENVELOPE>", "  <HEADER>", "    <TALLYREQUEST>Import Data</TALLYREQUEST>", "  </HEADER>", "  <BODY>", "    <IMPORTDATA>", "      <REQUESTDESC>", "        <REPORTNAME>Vouchers</REPORTNAME>", "        <STATICVARIABLES><SVCURRENTCOMPANY>")))
    head = F.concat(head, escaped(F.lit(company)), F.lit("</SVCURRENTCOMPANY></STATICVARIABLES>\n      </REQUESTDESC>\n      <REQUESTDATA>"))
    return _framed(body, head, F.lit("      </REQUESTDATA>\n    </IMPORTDATA>\n  </BODY>\n</ENVELOPE>"))


def generic_xml(txns: DataFrame, bank_ledger: str, **about: str) -> DataFrame:
    """``about`` may give company, gstin, year and state."""
    receipt, post, bank = export_voucher(tally=False) == "Receipt", posting_ledger(), F.lit(bank_ledger)
    fields = {"Date": _day("yyyy-MM-dd"), "Narration": F.col("narration"), "Reference": F.col("reference"), "VoucherType": export_voucher(tally=False),
              "Amount": F.format_string("%.2f", F.coalesce("debit", "credit", F.lit(0)).cast("double")), "DebitLedger": F.when(receipt, bank).otherwise(post),
              "CreditLedger": F.when(receipt, post).otherwise(bank), "Vendor": F.col("vendor"), "Status": status_word()}
    tags = [F.concat(F.lit(f"      <{n}>"), escaped(F.coalesce(v, F.lit(""))), F.lit(f"</{n}>")) for n, v in fields.items()]
    line = F.concat_ws("\n", F.lit("    <Transaction>"), *tags, F.lit("    </Transaction>"))
    body = txns.select("client_id", F.lit(3).alias("section"), F.col("ord").cast("long").alias("ord"), line.alias("line"))
    top = (("Company", "company"), ("GSTIN", "gstin"), ("FinancialYear", "year"), ("StateCode", "state"))
    named = [F.concat(F.lit(f"  <{n}>"), escaped(F.lit(about.get(k, ""))), F.lit(f"</{n}>")) for n, k in top]
    head = F.concat_ws("\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<BankStatementExport>'), *named, F.concat(F.lit("  <BankLedger>"), escaped(bank), F.lit("</BankLedger>")), F.lit("  <Transactions>"))
    return _framed(body, head, F.lit("  </Transactions>\n</BankStatementExport>"))


def status_word() -> Column:
    return F.when(F.col("status") == "NeedsReview", "needs_review").otherwise(F.lower("status"))


def report_rows(txns: DataFrame) -> DataFrame:
    """K4, K5: the twenty columns of the report's first section. Needs ``ledger_group``."""
    c = F.col
    head = F.coalesce(groups.party_group(c("account_head"), c("vendor"), c("txn_type") == "Receipt"), c("ledger_group"))
    source = c("classification_source")
    columns = {
        "Date": _day("dd/MM/yyyy"), "Narration": c("narration"), "Reference": c("reference"), "Debit": c("debit"), "Credit": c("credit"), "Balance": c("balance"), "Vendor": c("vendor"),
        "Account Head": c("account_head"), "Ledger for Posting": posting_ledger(), "Expense Head": head, "Party Group": party_group(), "Type": c("txn_type"), "Status": status_word(),
        "Tags": F.array_join("tags", "; "), "Confidence": F.format_string("%.2f", "confidence"), "Classification Source": source, "Classification Reason": classification_basis(),
        "Classified By": F.coalesce(F.nullif(source, F.lit("")), F.lit("local")), "Bank Name": c("bank_name"), "Account No": c("account_no")}
    return txns.select("client_id", "ord", *[v.alias(n) for n, v in columns.items()])


def report_heads(txns: DataFrame) -> DataFrame:
    """K4, K5: (client_id, section, head, amount): credits by head of receipts (4) and debits by head of payments (5)."""
    named = F.lower("account_head")
    receipt = ((F.col("txn_type") == "Receipt") | named.contains("income")) & F.col("credit").isNotNull()
    payment = ((F.col("txn_type") == "Payment") | named.contains("expense")) & F.col("debit").isNotNull()
    sides = F.filter(F.array(F.when(receipt, F.struct(F.lit(4).alias("section"), F.col("credit").alias("a"))), F.when(payment, F.struct(F.lit(5).alias("section"), F.col("debit").alias("a")))), lambda s: s.isNotNull())
    rows = txns.where(F.col("account_head") != "").select("client_id", F.col("account_head").alias("head"), F.explode(sides).alias("s"))
    return rows.groupBy("client_id", F.col("s.section").alias("section"), "head").agg(F.sum("s.a").alias("amount"))


def report_summary(txns: DataFrame, balances: DataFrame, bank_ledger: str) -> DataFrame:
    """K4, K5: (client_id, ord, label, value): twelve lines a client. ``balances`` has (client_id, client_name, file_name, opening, closing)."""
    sums = txns.groupBy("client_id").agg(F.coalesce(F.sum("credit"), F.lit(0)).alias("cr"), F.coalesce(F.sum("debit"), F.lit(0)).alias("dr"), analytics.count_if(F.col("dup_flag")).alias("dups"),
                                         analytics.count_if(F.array_contains("tags", "GST")).alias("gst")).join(balances, "client_id", "left")
    money = lambda c: F.coalesce(format_indian(c.cast("decimal(18,2)")), F.lit(""))
    cr, dr, opening, stated = F.col("cr"), F.col("dr"), F.col("opening"), F.col("closing")
    calc = F.round(opening + cr - dr, 0)
    gap = F.abs(calc - stated)
    verdict = F.when(gap < 0.5, "RECONCILED").when(gap.isNotNull(), F.concat(F.lit("MISMATCH (diff: "), F.format_string("%.2f", gap.cast("double")), F.lit(")"))).otherwise("N/A")
    lines = (("Client", F.coalesce("client_name", F.lit(""))), ("Bank Ledger", F.lit(bank_ledger)), ("File", F.coalesce("file_name", F.lit(""))), ("Total Receipts (Credit)", money(cr)), ("Total Payments (Debit)", money(dr)),
             ("Net", money(cr - dr)), ("Opening Balance", money(opening)), ("Closing Balance (Stated)", money(stated)), ("Closing Balance (Calc.)", money(calc)), ("Reconciliation", verdict),
             ("Duplicate Transactions", F.col("dups").cast("string")), ("GST Transactions", F.col("gst").cast("string")))
    each = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("ord"), F.lit(n).alias("label"), v.alias("value")) for i, (n, v) in enumerate(lines)])
    return sums.select("client_id", F.explode(each).alias("l")).select("client_id", "l.*")


def report(txns: DataFrame, balances: DataFrame, accounts: DataFrame, bank_ledger: str) -> DataFrame:
    """K4: each client's report: transactions (1), summary (2), accounts (3, where a client has more than one), receipt heads (4), payment heads (5).

    ``accounts`` has (client_id, bank_name, account_no, opening, closing, n). A section's title and heading have ord -1 and 0.
    """
    money = lambda c: F.coalesce(format_indian(c.cast("decimal(18,2)")), F.lit(""))
    csv = lambda cells: F.concat_ws(",", *[csv_field(F.coalesce(c, F.lit(""))) for c in cells])
    part = lambda rows, section, n, cells: rows.select("client_id", section.alias("section"), n.cast("long").alias("ord"), csv(cells).alias("line"))
    rows = report_rows(txns)
    names = rows.columns[2:]
    heads = report_heads(txns)
    by_amount = F.row_number().over(Window.partitionBy("client_id", "section").orderBy(F.desc("amount"), "head"))
    several = accounts.join(accounts.groupBy("client_id").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "client_id", "left_semi")
    at = F.row_number().over(Window.partitionBy("client_id").orderBy("bank_name", "account_no"))
    clients = txns.select("client_id").distinct()
    always = ((1, -1, "=== TRANSACTIONS ==="), (1, 0, ",".join(names)), (2, -1, "=== SUMMARY ==="), (4, -1, "=== RECEIPT HEADS ==="), (4, 0, "Account Head,Amount"), (5, -1, "=== PAYMENT HEADS ==="), (5, 0, "Account Head,Amount"))
    listed = ((3, -1, "=== BANK ACCOUNT BREAKDOWNS ==="), (3, 0, "Bank Name,Account No,Opening Balance,Closing Balance,Transactions"))
    out = part(rows, F.lit(1), F.col("ord"), [money(F.col(n)) if n in ("Debit", "Credit", "Balance") else F.col(n) for n in names])
    out = out.unionByName(part(report_summary(txns, balances, bank_ledger), F.lit(2), F.col("ord"), [F.col("label"), F.col("value")]))
    out = out.unionByName(part(several.withColumn("_at", at), F.lit(3), F.col("_at"), [F.col("bank_name"), F.col("account_no"), money(F.col("opening")), money(F.col("closing")), F.col("n").cast("string")]))
    out = out.unionByName(part(heads.withColumn("_at", by_amount), F.col("section"), F.col("_at"), [F.col("head"), money(F.col("amount"))]))
    for whose, lines in ((clients, always), (several.select("client_id").distinct(), listed)):
        each = F.array(*[F.struct(F.lit(n).alias("section"), F.lit(o).cast("long").alias("ord"), F.lit(line).alias("line")) for n, o, line in lines])
        out = out.unionByName(whose.select("client_id", F.explode(each).alias("t")).select("client_id", "t.*"))
    return out


def written(document: DataFrame, path: str) -> None:
    """Each client's lines under ``path/client_id=..``, in parts whose names follow their order."""
    document.repartitionByRange("client_id", "section", "ord").sortWithinPartitions("client_id", "section", "ord").select("client_id", "line").write.mode("overwrite").partitionBy("client_id").text(path)


SHEETS = ("Transactions", "Summary", "Receipt Heads", "Payment Heads")
_BOOK = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _bound(rows: pd.DataFrame) -> pd.DataFrame:
    """One workbook of the row elements of its sheets."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPES}.worksheet+xml"/>' for i in range(1, len(SHEETS) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_RELS}"><Relationship Id="r0" Type="{_LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_BOOK}" xmlns:r="{_LINK}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(SHEETS, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_RELS}">' + "".join(f'<Relationship Id="r{i}" Type="{_LINK}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(SHEETS) + 1)) + "</Relationships>")
        for i in range(1, len(SHEETS) + 1):
            own = rows[rows["sheet"] == i].sort_values("ord")["row"]
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_BOOK}"><sheetData>{"".join(own)}</sheetData></worksheet>')
    return pd.DataFrame({"client_id": [rows["client_id"].iloc[0]], "book": [rows["book"].iloc[0]], "content": [out.getvalue()]})


def _row(cells: list[Column], numbers: tuple[int, ...] = ()) -> Column:
    """A row element; characters that XML forbids become spaces. Only rows with a sign that needs it are taken apart, and empty texts are cells without content."""
    forbidden = "\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF"
    clean = lambda c: escaped(F.regexp_replace(c, f"[{forbidden}]", " "))
    as_text = [F.coalesce(c.cast("string"), F.lit("")) for c in cells]

    def row(written: Callable[[Column], Column]) -> Column:
        parts = [F.lit("<row>")]
        for i, (c, text) in enumerate(zip(cells, as_text)):
            if i in numbers:
                parts.append(F.when(c.isNull(), "<c/>").otherwise(F.concat(F.lit("<c><v>"), c.cast("string"), F.lit("</v></c>"))))
            else:
                parts.append(F.when(text == "", "<c/>").otherwise(F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), written(text), F.lit("</t></is></c>"))))
        return F.concat(*parts, F.lit("</row>"))
    plain = ~F.concat(*[t for i, t in enumerate(as_text) if i not in numbers]).rlike(f"[&<>\"'{forbidden}]")
    return F.when(plain, row(lambda c: c)).otherwise(row(clean))


def workbooks(txns: DataFrame, balances: DataFrame, bank_ledger: str, most: int = 100_000) -> DataFrame:
    """K5: (client_id, book, content): a client's report as .xlsx files of at most ``most`` transactions each, the sums in book 0.

    Rows are made by Spark; a task only zips one book, whose size ``most`` bounds.
    """
    n = F.regexp_extract("journal_no", "([0-9]+)", 1).cast("long")
    rows = numbered(txns, "").withColumn("_n", n)
    named = report_rows(rows.withColumn("ord", F.col("_n")))
    names = named.columns[2:]
    book = F.floor((F.col("ord") - 1) / most)
    one = named.select("client_id", book.alias("book"), F.lit(1).alias("sheet"), "ord", _row([F.col(c) for c in names], (3, 4, 5)).alias("row"))
    sums = report_summary(txns, balances, bank_ledger).select("client_id", F.lit(0).cast("long").alias("book"), F.lit(2).alias("sheet"), "ord", _row([F.col("label"), F.col("value")]).alias("row"))
    place = F.row_number().over(Window.partitionBy("client_id", "section").orderBy(F.desc("amount"), "head")).cast("long")
    heads = report_heads(txns).select("client_id", F.lit(0).cast("long").alias("book"), (F.col("section") - 1).alias("sheet"), place.alias("ord"), _row([F.col("head"), F.col("amount")], (1,)).alias("row"))
    named_once = F.array(F.struct(F.lit(1).alias("sheet"), _row([F.lit(c) for c in names]).alias("row")), *[F.when(F.col("book") == 0, F.struct(F.lit(n).alias("sheet"), _row([F.lit("Account Head"), F.lit("Amount")]).alias("row"))) for n in (3, 4)])
    top = one.select("client_id", "book").distinct().select("client_id", "book", F.explode(named_once).alias("t")).where("t is not null")
    body = one.unionByName(sums).unionByName(heads).unionByName(top.select("client_id", "book", "t.sheet", F.lit(0).cast("long").alias("ord"), "t.row"))
    return body.groupBy("client_id", "book").applyInPandas(_bound, "client_id long, book long, content binary")


#: The programs by number: name, file extension, layout.
TARGETS = (("Tally Prime / ERP9", "xml", tally), ("Zoho Books", "csv", zoho), ("QuickBooks", "csv", quickbooks), ("Odoo", "csv", odoo), ("Excel / CSV", "csv", report), ("Generic XML", "xml", generic_xml))


def target(number: int) -> tuple:
    """An unknown number asks for the generic document."""
    return TARGETS[number] if 0 <= number < len(TARGETS) else TARGETS[-1]
