"""Accounting exports: double-entry legs, ledger masters, voucher XML and the sections of the CSV report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bahikhata.operators.filters import export_voucher, posting_ledger


def numbered(txns: DataFrame, prefix: str, source: DataFrame | None = None) -> DataFrame:
    """Adds journal_no, counted within each client in statement order.

    Counted by stretches of ord and added up, so a client of any size spreads over many tasks. The counts are made on ``source``, which has
    the same rows of (client_id, ord) and may be cheaper to read than ``txns``.
    """
    rows = txns.withColumn("_part", F.floor(F.col("ord") / 100_000))
    sums = (txns if source is None else source).withColumn("_part", F.floor(F.col("ord") / 100_000)).groupBy("client_id", "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("client_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("client_id", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    n = F.col("_base") + F.row_number().over(Window.partitionBy("client_id", "_part").orderBy("ord"))
    return rows.join(sums, ["client_id", "_part"]).withColumn("journal_no", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 5, "0"))).drop("_part", "_base")


def journal_legs(txns: DataFrame, bank_ledger: str, prefix: str = "BSP-", source: DataFrame | None = None) -> DataFrame:
    """Two legs a transaction: a receipt debits the bank, anything else credits it."""
    rows = numbered(txns, prefix, source).withColumn("amount", F.coalesce("debit", "credit", F.lit(0)).cast("double")).withColumn("receipt", export_voucher(tally=False) == "Receipt")

    def leg(no: int, ledger: Column, kind: str, debit: Column) -> Column:
        return F.struct(F.lit(no).cast("long").alias("leg"), ledger.alias("ledger"), F.lit(kind).alias("account_type"), F.when(debit, F.col("amount")).otherwise(0.0).alias("dr"), F.when(debit, 0.0).otherwise(F.col("amount")).alias("cr"))
    legs = F.array(leg(1, F.lit(bank_ledger), "Bank", F.col("receipt")), leg(2, posting_ledger(), "Expense", ~F.col("receipt")))
    return rows.select("client_id", "ord", "date", "journal_no", F.explode(legs).alias("l")).select("client_id", "ord", "date", "journal_no", "l.*")


def ledger_masters(txns: DataFrame) -> DataFrame:
    """Each client's distinct posting ledgers with the group of its first row, and how many rows post to it."""
    return txns.groupBy("client_id", posting_ledger().alias("ledger")).agg(F.min_by("ledger_group", "ord").alias("parent"), F.count("*").alias("n"))


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def voucher_element(kind: Column, said: Column, debit: Column, credit: Column, amount: Column) -> Column:
    """A voucher of the ledger program that debits one ledger and credits another."""
    def entry(ledger: Column, positive: str, value: Column) -> Column:
        return F.concat(F.lit("<ALLLEDGERENTRIES.LIST><LEDGERNAME>"), escaped(ledger), F.lit(f"</LEDGERNAME><ISDEEMEDPOSITIVE>{positive}</ISDEEMEDPOSITIVE><AMOUNT>"), value, F.lit("</AMOUNT></ALLLEDGERENTRIES.LIST>"))
    return F.concat(F.lit('<VOUCHER VCHTYPE="'), kind, F.lit('" ACTION="Create"><DATE>'), F.coalesce(F.date_format("date", "yyyyMMdd"), F.lit("")), F.lit("</DATE><NARRATION>"), escaped(F.coalesce(said, F.lit(""))),
                    F.lit("</NARRATION><VOUCHERTYPENAME>"), kind, F.lit("</VOUCHERTYPENAME>"), entry(debit, "Yes", F.concat(F.lit("-"), amount)), entry(credit, "No", amount), F.lit("</VOUCHER>"))


def voucher_xml(txns: DataFrame, bank_ledger: str) -> DataFrame:
    """One voucher element a transaction: a receipt debits the bank, a contra debits it against cash, all else credits it.

    Without ``bank_ledger`` the row's bank names it.
    """
    kind = export_voucher(tally=True)
    bank = F.lit(bank_ledger) if bank_ledger else F.coalesce(F.concat(F.nullif("bank_name", F.lit("")), F.lit(" A/c")), F.lit("Bank Account"))
    amount = F.format_string("%.2f", F.coalesce("debit", "credit", F.lit(0)).cast("double"))
    debit = F.when(kind.isin("Receipt", "Contra"), bank).otherwise(posting_ledger())
    credit = F.when(kind == "Receipt", posting_ledger()).when(kind == "Contra", "Cash").otherwise(bank)
    return txns.select("client_id", "ord", kind.alias("voucher"), voucher_element(kind, F.col("narration"), debit, credit, amount).alias("xml"))


def heads(txns: DataFrame) -> DataFrame:
    """Receipt and payment totals by posting ledger: the last two sections of the report."""
    receipt = ((F.col("txn_type") == "Receipt") | F.lower("account_head").contains("income")) & F.col("credit").isNotNull()
    payment = ((F.col("txn_type") == "Payment") | F.lower("account_head").contains("expense")) & F.col("debit").isNotNull()
    side = F.when(receipt, "receipt").when(payment, "payment")
    rows = txns.withColumn("side", side).where("side is not null")
    return rows.groupBy("side", posting_ledger().alias("ledger")).agg(F.sum(F.coalesce("credit", "debit")).cast("double").alias("amount"), F.count("*").alias("n"))


def preview(txns: DataFrame) -> DataFrame:
    """Counts by voucher type."""
    return txns.groupBy(export_voucher(tally=True).alias("voucher")).agg(F.count("*").alias("n"), F.sum(F.coalesce("debit", "credit")).cast("double").alias("amount"))


def csv_field(text: Column) -> Column:
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(txns: DataFrame) -> DataFrame:
    """One generic CSV line a transaction: date, voucher, debit ledger, credit ledger, amount, narration."""
    credit = F.col("credit").isNotNull()
    bank, post = F.lit("Bank A/c"), posting_ledger()
    cells = [F.date_format("date", "yyyy-MM-dd"), export_voucher(tally=False), F.when(credit, bank).otherwise(post), F.when(credit, post).otherwise(bank), F.format_string("%.2f", F.coalesce("debit", "credit", F.lit(0)).cast("double")), F.col("narration")]
    return txns.select("client_id", "ord", F.concat_ws(",", *[csv_field(c) for c in cells]).alias("line"))


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Each section as its own CSV folder under ``path``, with a byte-order mark left to the reader's tool."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
