"""Canonical transactions over the star-schema tables: the same rows that ``plans.sql`` builds in SQL.

A row of ``events`` becomes a bank transaction: the event's number picks a narration pattern, its type the
direction, its user the account. Balances are stated on two rows of three and wrong on one row in 41.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: {r} is a twelve-digit reference made of the event's number.
NARRATIONS = (
    "UPI/{r}/SHARMA TRADERS/PAYMENT",
    "NEFT CR-{r}-MEHTA AND SONS",
    "ATM WDL {r} MG ROAD",
    "INT.CR ON SAVINGS",
    "SMS CHARGES Q1",
    "GST PAYMENT CHALLAN {r}",
    "TDS PMT 281 {r}",
    "SALARY MARCH STAFF",
    "OFFICE RENT APRIL",
    "HPCL PETROL PUMP {r}",
    "AIRTEL BROADBAND BILL {r}",
    "MSEDCL BILL {r}",
    "LIC PREMIUM {r}",
    "SWIGGY ORDER {r}",
    "CHAI AND SNACKS",
    "BIGBASKET {r}",
    "BEAUTY PARLOUR",
    "DTDC COURIER {r}",
    "XEROX AND PRINTING",
    "APOLLO PHARMACY {r}",
    "AMAZON PAY {r}",
    "GOOGLE WORKSPACE IGST 18% GST",
    "UBER TRIP {r}",
    "IRCTC TICKET {r}",
    "AUDIT FEES FY24",
    "CAR LOAN INSTALMENT {r}",
    "ZERODHA BROKING {r}",
    "DIVIDEND TATA STEEL",
    "DIGITAL MARKETING SERVICES",
    "RTGS/{r}/27ABCDE1234F1Z5/PATEL STEEL",
    "IMPS P2A {r} RAVI KUMAR",
    "CHQ 004512 CLEARED",
    "CASH DEP BRANCH",
    "TRF TO SAVINGS",
    "OPENING BALANCE",
    "Closing Balance",
    "Page 2 of 9",
    "UTR: HDFCR52024{r} VENDOR",
    "FOREIGN REMITTANCE SWIFT",
    "X",
    "CGST 9% SGST 9% 18% GST INVOICE {r}",
    "NACH DR BAJAJ FINSERV EMI {r}",
)
BANKS = ("HDFC Bank", "State Bank of India", "Union Bank", "Kotak Bank")


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, ord, id, account, date, date_raw, narration, reference, debit, credit, balance, bank_name, ..."""
    n = F.col("event_id")
    ref = F.lpad(n.cast("string"), 12, "0")
    pattern = F.element_at(F.array(*[F.lit(x) for x in NARRATIONS]), (n % len(NARRATIONS) + 1).cast("int"))
    amount = money(F.col("value"))
    out = F.col("event_type").isin("purchase", "click", "error")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 5 + 1).alias("client_id"), n.alias("ord"), F.concat(F.lit("t_"), n.cast("string")).alias("id"), F.col("user_id").alias("account"),
        F.to_date("ts").alias("date"), F.date_format("ts", "dd/MM/yyyy").alias("date_raw"), F.replace(pattern, F.lit("{r}"), ref).alias("narration"),
        F.when(n % 4 == 0, ref).otherwise("").alias("reference"), F.when(out, amount).alias("debit"), F.when(~out, amount).alias("credit"),
        F.element_at(F.array(*[F.lit(x) for x in BANKS]), (F.col("user_id") % 4 + 1).cast("int")).alias("bank_name"), F.concat(F.lit("5010"), F.lpad(F.col("user_id").cast("string"), 10, "0")).alias("account_no"),
        F.when(n % 7 == 3, "Suspense").when(n % 11 == 5, "Manual").when(n % 13 == 1, "NeedsReview").otherwise("Unreviewed").alias("status"))
    net = F.coalesce("credit", money(F.lit(0))) - F.coalesce("debit", money(F.lit(0)))
    running = F.sum(net).over(Window.partitionBy("account").orderBy("ord")) + 1000 + F.when(F.col("ord") % 41 == 0, 500).otherwise(0)
    return rows.withColumn("balance", F.when(F.col("ord") % 3 != 1, money(running)))
