"""Running balances of an account in statement order: windows over (account, ord), never a driver loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bahikhata.functions.text import txn_hash
from bahikhata.operators.scans import scanned

NET = "coalesce(credit, cast(0 as decimal(18,2))) - coalesce(debit, cast(0 as decimal(18,2)))"


def previous_balance(txns: DataFrame) -> DataFrame:
    """Adds opening and prev_balance: the last stated balance before the row plus the net of unstated rows since."""
    net = F.expr(NET)
    first = txns.where("balance is not null and (debit is not null or credit is not null)").groupBy("account").agg(F.min_by(F.col("balance") - net, "ord").alias("opening"))
    rows = scanned(txns, ["account"], "ord", sums={"_unstated": F.when(F.col("balance").isNull(), net).otherwise(0)})
    rows = scanned(rows, ["account"], "ord", lasts={"_at": F.when(F.col("balance").isNotNull(), F.struct("balance", "_unstated"))}).join(first, "account", "left")
    prev = F.coalesce("_at.balance", "opening") + F.col("_unstated") - F.coalesce("_at._unstated", F.lit(0))
    return rows.withColumn("prev_balance", prev.cast("decimal(18,2)")).withColumn("opening", F.col("opening").cast("decimal(18,2)")).drop("_unstated", "_at")


def directed(txns: DataFrame) -> DataFrame:
    """Swaps debit and credit where the balance moved the other way; adds ``swapped``."""
    rows = scanned(txns, ["account"], "ord", lasts={"_prev": F.col("balance")})
    moved = F.col("balance") - F.col("_prev")
    near = lambda a, d: F.abs(d) < F.greatest(F.lit(1), a * F.lit("0.02").cast("decimal(3,2)"))
    to_credit = F.coalesce(F.col("credit").isNull() & near(F.col("debit"), moved - F.col("debit")), F.lit(False))
    to_debit = F.coalesce(F.col("debit").isNull() & near(F.col("credit"), moved + F.col("credit")), F.lit(False))
    rows = rows.withColumn("_c", to_credit).withColumn("_d", to_debit)
    return rows.withColumns({"debit": F.when(F.col("_c"), None).when(F.col("_d"), F.col("credit")).otherwise(F.col("debit")),
                             "credit": F.when(F.col("_d"), None).when(F.col("_c"), F.col("debit")).otherwise(F.col("credit")), "swapped": F.col("_c") | F.col("_d")}).drop("_c", "_d", "_prev")


def validated(txns: DataFrame) -> DataFrame:
    """Adds balance_ok: stated balance within 1 of the last stated one plus the row's net; null if none is stated."""
    rows = scanned(txns, ["account"], "ord", lasts={"_prev": F.col("balance")})
    judged = F.col("balance").isNotNull() & F.expr("debit is not null or credit is not null")
    gap = F.abs(F.col("_prev") + F.expr(NET) - F.col("balance"))
    return rows.withColumn("balance_ok", F.when(judged, F.coalesce(gap <= 1, F.lit(True)))).drop("_prev")


def opening_rows(txns: DataFrame) -> DataFrame:
    """One row an account: the balance before its first row, if that states one."""
    first = txns.groupBy("account").agg(F.min_by(F.struct("balance", F.expr(NET).alias("net")), "ord").alias("f"))
    return first.select("account", (F.col("f.balance") - F.col("f.net")).cast("decimal(18,2)").alias("balance")).where("balance is not null")


def with_opening(txns: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """``txns`` with is_opening_balance, and before each account's first row the opening one: its balance without its amount, or, if it lacks either, what ``stated`` (account,
    opening) says; none if that says nothing. Its id is made of the first row's hash, so the same statement makes the same row again."""
    first = txns.groupBy("account").agg(F.min_by(F.struct(*[c for c in txns.columns if c != "account"]), "ord").alias("f")).select("account", "f.*")
    derived = F.when(F.expr("balance is not null and (debit is not null or credit is not null)"), F.col("balance") - F.expr(NET))
    if stated is not None:
        first = first.join(stated.select("account", F.col("opening").alias("_stated")), "account", "left")
        derived = F.coalesce(derived, F.col("_stated"))
    first = first.withColumn("_balance", derived.cast("decimal(18,2)")).where("_balance is not null")
    own = {"id": F.concat(F.lit("opening_balance_"), txn_hash(F.col("date_raw"), F.col("narration"), F.col("debit"), F.col("credit"))), "ord": F.col("ord") - 1, "narration": F.lit("Opening Balance"), "balance": F.col("_balance"), "date_raw": F.lit(""), "reference": F.lit("")}
    kept = ("account", "client_id", "bank_name", "account_no")
    made = first.select(*[own.get(c, F.col(c) if c in kept else F.lit(None)).cast(txns.schema[c].dataType).alias(c) for c in txns.columns])
    return txns.withColumn("is_opening_balance", F.lit(False)).unionByName(made.withColumn("is_opening_balance", F.lit(True)))


def sided(lines: DataFrame) -> DataFrame:
    """Adds debit and credit to lines of (file, row_idx, date, amounts, dr, cr, balance) by how the balance moved.

    A file whose first dated line is later than its last runs backwards and is read from its end. A line without a balance counts as
    zero. One amount: its mark decides, else the movement within 2 %, else it is a credit. Several: the one nearest to the
    movement within 2 %, else the first if the balance fell and the last if it rose; none if it stood still. The first line is a credit.
    """
    at = F.when(F.col("date").isNotNull(), F.col("row_idx"))
    ends = lines.groupBy("file").agg((F.min_by("date", at) > F.max_by("date", at)).alias("_back"))
    rows = lines.join(ends, "file").withColumn("_at", F.when(F.coalesce("_back", F.lit(False)), -F.col("row_idx")).otherwise(F.col("row_idx"))).drop("_back")
    balance = F.coalesce("balance", F.lit(0).cast("decimal(18,2)"))
    rows = scanned(rows, ["file"], "_at", lasts={"_before": balance}).withColumn("_moved", balance - F.col("_before")).drop("_before")
    moved, first, last = F.col("_moved"), F.get("amounts", F.lit(0)), F.element_at("amounts", -1)
    within = lambda gap, amount: F.abs(gap) < amount * F.lit("0.02").cast("decimal(3,2)")
    gaps = F.transform("amounts", lambda x, i: F.struct(F.abs(F.abs(moved) - x).alias("gap"), i.alias("i"), x.alias("x")))
    best = F.array_min(gaps)
    chosen = F.when(within(best["gap"], F.greatest(best["x"], F.lit(1))), best["x"]).when(moved < 0, first).otherwise(last)
    one = F.size("amounts") == 1
    down = F.when(one, F.coalesce(F.col("dr"), F.lit(False)) | (~F.coalesce(F.col("cr"), F.lit(False)) & ~within(moved - first, first) & within(moved + first, first))).otherwise(moved < 0)
    amount = F.when(one, first).when((F.size("amounts") > 1) & moved.isNull(), first).when((F.size("amounts") > 1) & (moved != 0), chosen)
    down = F.coalesce(down, F.lit(False))
    rows = rows.withColumns({"_amount": F.when(amount > 0, amount).cast("decimal(18,2)"), "_down": down})
    return rows.withColumns({"debit": F.when(F.col("_down"), F.col("_amount")), "credit": F.when(~F.col("_down"), F.col("_amount"))}).drop("_at", "_moved", "_amount", "_down")
