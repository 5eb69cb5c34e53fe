"""GST analysis of transactions as one struct column; null where nothing speaks of GST."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bahikhata.functions.amounts import plain_number
from bahikhata.functions.text import contains_any, first_case
from bahikhata.operators.ledger_words import GST_RATES, GST_VENDORS

GSTIN = r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]"


def analysed(txns: DataFrame) -> DataFrame:
    """Adds ``gst``, step by step so that no expression is repeated in the plan."""
    rows = txns.withColumn("_text", F.concat_ws(" ", "narration", "reference", "vendor"))
    text, upper = F.col("_text"), F.upper("_text")
    said = first_case([(text.rlike(rf"(?i)\b{rate}\s*%?\s*(gst|tax)\b|gst\s*@?\s*{rate}\b"), F.lit(float(rate))) for rate in GST_RATES])
    which = first_case([(contains_any(upper, words), F.lit(i)) for i, (_, _, _, words) in enumerate(GST_VENDORS)])
    rows = rows.withColumns({
        "_said": said, "_which": which, "_gstins": F.array_distinct(F.regexp_extract_all(text, F.lit(GSTIN), F.lit(0))),
        "_component": F.when(text.rlike(r"(?i)\bIGST\b"), "IGST").when(text.rlike(r"(?i)\bCGST\b|\bSGST\b|\bUTGST\b"), "CGST+SGST"),
        "_mention": text.rlike(r"(?i)\bGST\b|\bIGST\b|\bCGST\b|\bSGST\b")})
    of = lambda i: F.get(F.array(*[F.lit(v[i]) for v in GST_VENDORS]), F.col("_which"))
    rows = rows.withColumn("_rate", F.coalesce("_said", of(0))).withColumn("_kind", F.coalesce("_component", of(1), F.when(F.col("_rate").isNotNull(), "CGST+SGST")))
    rate, kind, debit, credit = F.col("_rate"), F.col("_kind"), F.col("debit"), F.col("credit")
    tax = F.when(rate > 0, F.round(F.coalesce(debit, credit).cast("double") * rate / (100 + rate), 2))
    side = F.when(debit.isNotNull() & credit.isNull(), "Input").otherwise("Output")
    rows = rows.withColumns({"_side": side, "_whole": plain_number(rate), "_half": plain_number(rate / 2)})
    one = F.concat(F.lit("IGST "), "_side", F.lit(" ("), "_whole", F.lit("%)"))
    two = F.concat(F.lit("CGST "), "_side", F.lit(" ("), "_half", F.lit("%) + SGST "), "_side", F.lit(" ("), "_half", F.lit("%)"))
    ledger = F.when((kind == "EXEMPT") | (rate == 0), None).when(kind == "IGST", one).when(kind.isNotNull() & rate.isNotNull(), two)
    found, hit = F.size("_gstins") > 0, F.col("_which").isNotNull()
    points = sum((F.when(c, w).otherwise(0) for c, w in ((found, 35), (F.col("_component").isNotNull(), 20), (F.col("_said").isNotNull(), 20), (hit, 15), (F.col("_mention"), 10))), F.lit(0))
    speaks = F.col("_mention") | hit | found | F.col("_said").isNotNull()
    answer = F.struct(rate.alias("gst_rate"), kind.alias("gst_type"), tax.alias("gst_amount"), F.col("_gstins").alias("gstins"), of(2).alias("expense_ledger"), ledger.alias("suggested_ledger"), (F.least(points, F.lit(99)) / 100.0).alias("confidence"))
    return rows.withColumn("gst", F.when(speaks, answer)).drop("_text", "_said", "_which", "_gstins", "_component", "_mention", "_rate", "_kind", "_side", "_whole", "_half")
