"""Statements whose text has one field a line, joined to one row a transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bahikhata.functions.dates import parse_date

# Headings that stand alone on a line, and words of footers and notices.
HEADINGS = ("date", "type", "particulars", "debit", "credit", "balance", "channel", "cheque", "reference", "txn", "value", "valuedate", "description", "chq", "ref", "s.no", "sr.no", "sl.no", "serial", "withdrawal", "deposit", "dr", "cr", "amount", "narration", "details")
NOTICES = (
    "for any queries", "customer service", "customers outside india", "system generated output", "requires no signature", "requested to immediately notify", "avail our loan", "missed call", "important information",
    "important safety tips", "grievance", "nodal officer", "commonly used abbreviation", "deposit insurance", "dicgc", "phishing", "fraudulent", "never ask", "never share your card", "never sign blank cheque", "end of the statement",
    "end of statement", "legends for transactions", "legends used in", "unless the constituent notifies", "value date is the effective", "closing balance displayed", "contact the branch", "toll-free", "toll free", "welcome letter",
    "www.dicgc.org", "important message", "found the account correct", "suspicious device", "blank cheque", "call us at", "contact us", "escalate your concern", "nodaldesk@", "banker@", "does not send requests",
    "sensitive financial information", "brought forward",
)
STARTS = ("page no", "11111", "statement for account", "idbi bank", "our toll")


def rejoined(lines: DataFrame, last_year: str = "2099") -> DataFrame:
    """(file, row_idx, date, narration, reference, amounts) of lines (file, row_idx, line); the balance is the last amount.

    A line that is a date begins a transaction, unless nothing but dates and numbers of reference came since the last: then it is its value date.
    Of other lines, figures with Cr or Dr are the balance (the last counts), six or more bare digits a reference (the first counts), lines of over 80 %
    digits amounts of more than 0 and less than 2,000,000,000, all else narration. Of lines that are neither figures nor a date, headings,
    notices, page marks and channel codes are left out; so are lines of one or two bytes, transactions of fewer than two amounts and what stands before the
    first date.
    """
    t = F.col("t")
    rows = lines.select("file", "row_idx", F.trim("line").alias("t")).withColumn("l", F.lower("t"))
    page = F.contains("l", F.lit("page")) & F.contains("l", F.lit("of"))
    notice = page | F.col("l").rlike("^(" + "|".join(s.replace(".", r"\.") for s in STARTS) + ")") | F.contains("l", F.lit("?identity")) | F.col("l").rlike("|".join(n.replace(".", r"\.") for n in NOTICES)) | F.col("l").isin(*HEADINGS)
    bare = F.trim(F.regexp_replace(t, r"(?i)^rs\.?", ""))
    solid = F.regexp_replace(bare, r"\s", "")
    plain = F.replace(bare, F.lit(","), F.lit(""))
    number = lambda c: F.when(c.rlike(r"^[0-9]*\.?[0-9]*$"), c.try_cast("decimal(18,2)"))
    fit = lambda c: F.when((c > 0) & (c < 2_000_000_000), c)
    signed = F.when(t.rlike(r"(?i)^[0-9,.]+\s*(cr|dr)$"), fit(number(F.replace(F.regexp_replace(t, r"(?i)\s*(cr|dr)$", ""), F.lit(","), F.lit("")))))
    figures = F.length(F.regexp_replace(solid, "[^0-9,.]", "")) > 0.8 * F.length(solid)
    kind = F.when(F.col("date").isNotNull(), "date").when(F.col("balance").isNotNull(), "balance").when(F.replace(t, F.lit(","), F.lit("")).rlike("^[0-9]{6,}$"), "reference").when(figures, F.when(fit(number(plain)).isNotNull(), "amount").otherwise("none")).otherwise("text")
    rows = rows.where(F.octet_length("l") > 2).withColumns({"date": parse_date(t, last_year), "balance": signed})
    # Figures and dates first: an amount of 11111 isn't the channel code that begins so.
    rows = rows.where(F.col("date").isNotNull() | F.col("balance").isNotNull() | figures | ~notice).withColumns({"kind": kind, "amount": fit(number(plain))})
    order = Window.partitionBy("file").orderBy("row_idx")
    before = F.last(F.when(~F.col("kind").isin("reference", "none"), F.col("kind")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("begins", (F.col("kind") == "date") & ~F.coalesce(before == "date", F.lit(False)))
    # Texts before the first date don't keep it from beginning a transaction.
    rows = rows.withColumn("txn", F.sum(F.col("begins").cast("int")).over(order)).where("txn > 0")
    of = lambda k, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("row_idx", c)))), lambda x: x[c])
    found = rows.groupBy("file", "txn").agg(F.min("row_idx").alias("row_idx"), F.min_by("date", F.when(F.col("begins"), F.col("row_idx"))).alias("date"), F.array_join(of("text", "t"), " ").alias("narration"), F.get(of("reference", "t"), F.lit(0)).alias("reference"),
                                            of("amount", "amount").alias("paid"), F.max_by("balance", F.when(F.col("kind") == "balance", F.col("row_idx"))).alias("balance"))
    amounts = F.concat("paid", F.filter(F.array("balance"), lambda b: b.isNotNull()))
    return found.select("file", "row_idx", "date", F.coalesce(F.nullif("narration", F.lit("")), F.lit("TRANSACTION")).alias("narration"), F.replace("reference", F.lit(","), F.lit("")).alias("reference"), amounts.alias("amounts")).where("size(amounts) >= 2")
