"""Dashboard aggregates over transactions. Money stays decimal until the last projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bahikhata.operators.filters import needs_review

DEBIT, CREDIT = "coalesce(debit, 0)", "coalesce(credit, 0)"


def total(expr: str | Column) -> Column:
    return F.coalesce(F.sum(F.expr(expr) if isinstance(expr, str) else expr), F.lit(0)).cast("double")


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1)).cast("long")


def summary(txns: DataFrame) -> DataFrame:
    suspense = F.col("status") == "Suspense"
    return txns.agg(
        total(CREDIT).alias("total_credit"), total(DEBIT).alias("total_debit"), total(f"{CREDIT} - {DEBIT}").alias("net_flow"),
        F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("ord"))).cast("double").alias("closing_balance"), F.count("*").alias("txn_count"),
        F.countDistinct(F.nullif(F.col("vendor"), F.lit(""))).alias("vendor_count"), count_if(suspense).alias("suspense_count"),
        total(F.when(suspense, F.coalesce("debit", "credit"))).alias("suspense_amount"), count_if(needs_review()).alias("review_count"),
        count_if(F.col("dup_flag")).alias("duplicate_count"), count_if(F.arrays_overlap("tags", F.array(F.lit("GST"), F.lit("TAX")))).alias("gst_count"))


def monthly(txns: DataFrame) -> DataFrame:
    return txns.where("date is not null").groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(total(CREDIT).alias("credits"), total(DEBIT).alias("debits"))


def top_heads(txns: DataFrame, label: Column, n: int = 10) -> DataFrame:
    """The n largest labels by debit, with their share of the n (half away from zero). Ties go by name."""
    top = txns.where("debit is not null").groupBy(label.alias("label")).agg(F.sum("debit").alias("amount")).orderBy(F.desc("amount"), "label").limit(n)
    share = F.round(F.col("amount").cast("double") / F.sum("amount").over(Window.partitionBy()).cast("double") * 100, 0)
    return top.select("label", F.col("amount").cast("double").alias("amount"), F.coalesce(share, F.lit(0)).cast("long").alias("pct"))


def top_vendors(txns: DataFrame, n: int = 10) -> DataFrame:
    sums = txns.where("vendor <> ''").groupBy("vendor").agg(F.sum(F.expr(DEBIT)).alias("d"), F.sum(F.expr(CREDIT)).alias("c"))
    return sums.orderBy(F.desc(F.col("d") + F.col("c")), "vendor").limit(n).select("vendor", F.col("d").cast("double").alias("debit"), F.col("c").cast("double").alias("credit"))


def cashflow(txns: DataFrame, points: int = 150) -> DataFrame:
    """Every step-th stated balance of each account, scaled to 0..1 within the account."""
    of = Window.partitionBy("account")
    rows = txns.where("balance is not null").withColumn("n", F.row_number().over(of.orderBy("ord")) - 1).withColumn("all", F.count("*").over(of))
    step = F.greatest(F.floor(F.col("all") / points), F.lit(1))
    rows = rows.where(F.col("n") % step == 0)
    low, high = F.min("balance").over(of), F.max("balance").over(of)
    norm = (F.col("balance") - low).cast("double") / F.greatest((high - low).cast("double"), F.lit(1.0))
    return rows.select("account", "ord", F.round(norm, 6).alias("norm"))


def insights(txns: DataFrame) -> DataFrame:
    """Largest debit and credit (the last of equals) with 45 characters of narration, averages and counts."""
    def of(side: str, short: str) -> list[Column]:
        live = F.col(side) > 0
        top = F.max_by(F.substring("narration", 1, 45), F.when(live, F.struct(F.col(side), F.col("ord"))))
        n = F.count(F.when(live, 1))
        return [F.max(F.when(live, F.col(side))).cast("double").alias(f"max_{short}"), top.alias(f"max_{short}_narration"), n.alias(f"{short}_count"),
                F.round(F.sum(side).cast("double") / F.nullif(n, F.lit(0)), 2).alias(f"avg_{short}")]
    return txns.agg(*of("debit", "dr"), *of("credit", "cr"))


def meta(txns: DataFrame) -> DataFrame:
    """One row: the bank and account (or that there are several) and the period."""
    one = lambda c, many: F.when(F.countDistinct(c) == 1, F.max(c)).otherwise(many)
    return txns.agg(one("bank_name", "Multiple Banks").alias("bank"), one("account_no", "Multiple Accounts").alias("account"), F.min("date").alias("period_from"), F.max("date").alias("period_to"))


def per_account(txns: DataFrame) -> DataFrame:
    """Opening (first row's previous balance), closing (last stated), count and totals of each account."""
    return txns.groupBy("account").agg(
        F.min_by("prev_balance", "ord").cast("double").alias("opening"), F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("ord"))).cast("double").alias("closing"),
        F.count("*").alias("n"), total(CREDIT).alias("credits"), total(DEBIT).alias("debits"))


def statement_check(accounts: DataFrame) -> DataFrame:
    """per_account() rows with the closing that opening and totals give, to the rupee, and whether the stated one differs."""
    calc = F.round(F.col("opening") + F.col("credits") - F.col("debits"), 0)
    return accounts.select("account", calc.alias("calc_closing"), (F.abs(F.col("closing") - calc) >= 0.5).alias("mismatch"))


def bars(monthly_rows: DataFrame) -> DataFrame:
    """Shares of a round axis maximum, and donut angles as a running sum over the months' debits."""
    from bahikhata.functions.amounts import nice_axis_max

    every = Window.partitionBy()
    top = F.max(F.greatest("credits", "debits")).over(every)
    order = every.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    sweep = F.col("debits") / F.sum("debits").over(every) * 360
    rows = monthly_rows.withColumn("axis_max", nice_axis_max(top)).withColumn("_sweep", sweep)
    return rows.select("month", "axis_max", F.round(F.col("credits") / F.col("axis_max"), 6).alias("credit_bar"), F.round(F.col("debits") / F.col("axis_max"), 6).alias("debit_bar"),
                       F.round(F.coalesce(F.sum("_sweep").over(order), F.lit(0.0)), 4).alias("start_angle"), F.round("_sweep", 4).alias("sweep_angle"))
