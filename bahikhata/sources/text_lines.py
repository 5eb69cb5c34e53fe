"""Statements as recognised text, one transaction a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bahikhata.functions.amounts import let
from bahikhata.functions.dates import parse_date
from bahikhata.operators.balances import sided
from bahikhata.operators.scans import scanned
from bahikhata.operators.stages import kept

# The day that begins a transaction, an amount (short ones need a decimal point), marks of the side, what is dropped from narrations, and a payment's id.
_DAY = r"^([0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4})\b"
_AMOUNT = r"\b(?:[0-9]{1,4}(?:,[0-9]{2,3})*\.[0-9]{1,2}|[0-9]{5,}(?:\.[0-9]{1,2})?)\b"
_SIDE = r"(?i)\b(?:DR|CR)\b\.?"
_STRAY = r"[^A-Za-z0-9_\s/\-.@&]"
_PAYMENT = r"(?i)^UPI\s*([0-9]{6,})(.*)$"
#: Digits before the point and value that an amount has at most, characters of a narration with its further lines, and bytes of a line that counts.
DIGITS, MOST, NARRATION, LEAST = 8, 100_000_000, 200, 5
_MONEY = "decimal(18,2)"


def amounts_of(text: Column) -> Column:
    """array<struct<said, amount>>: the amounts of a line, without years, parts of a unit, and digits glued to what stands before them."""
    # A blank in front makes the character before the first match a blank as well.
    found = F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(rf"(\S?)({_AMOUNT})"), F.lit(0))
    exact = F.transform(found, lambda f: F.regexp_extract(f, rf"^(\S?)({_AMOUNT})$", 2))
    pairs = F.arrays_zip(found.alias("f"), exact.alias("said"))
    value = lambda z: F.struct(z["said"], F.replace(z["said"], F.lit(","), F.lit("")).try_cast("decimal(38,2)").alias("amount"), (z["f"] != z["said"]).alias("glued"))
    good = lambda z: (z["amount"] >= 1) & ~((F.length(z["said"]) == 4) & z["amount"].between(1900, 2100)) & (F.contains(z["said"], F.lit(".")) | ~z["glued"])
    return F.filter(F.transform(pairs, value), good)


def _tokens(rest: Column) -> Column:
    return F.split(F.regexp_replace(rest, _AMOUNT, "\x01$0\x01"), "\x01")


def transactions(lines: DataFrame, last_year: str = "2099") -> DataFrame:
    """(file, row_idx, date, narration, reference, debit, credit, balance) of lines (file, row_idx, line); days are of years up to ``last_year``.

    A line that begins with a day is a transaction: its last amount is the balance, those before it are candidates; longer runs of digits are no amounts. The narration is the rest;
    a UPI narration keeps its id and gives what follows to the reference, others give their longest run of nine digits and more. Lines without a day and without amounts, of
    four bytes and more and not beginning with a digit, go on with the narration, up to NARRATION characters. The side is the mark's, else the movement's, in the order of time
    (``balances.sided``): a file whose first day is later than its last is read from its end.
    """
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    rows = lines.select("file", F.col("row_idx").cast("long").alias("row_idx"), line.alias("line")).where(F.octet_length("line") >= LEAST)
    day = F.regexp_extract("line", _DAY, 1)
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.substring("line", F.length("day") + 1, F.length("line")), r"[|\\{}\[\]]", " "), r"\s+", " "))
    rows = rows.withColumn("day", day).withColumn("rest", F.when(F.col("day") != "", rest).otherwise(F.col("line"))).withColumn("all", amounts_of(F.col("rest")))
    # A minus before the balance at the end of a line says that it is overdrawn, and is no word of the narration.
    end = F.try_element_at("all", F.lit(-1))["said"]
    rows = rows.withColumn("overdrawn", F.coalesce((F.col("day") != "") & F.endswith(F.concat(F.lit(" "), "rest"), F.concat(F.lit(" -"), end)), F.lit(False)))
    rows = rows.withColumn("rest", F.when(F.col("overdrawn"), F.concat(F.left("rest", F.length("rest") - F.length(end) - 1), end)).otherwise(F.col("rest")))
    digits = lambda a: F.length(F.regexp_replace(F.substring_index(a["said"], ".", 1), "[^0-9]", ""))
    rows = rows.withColumn("found", F.filter("all", lambda a: (digits(a) <= DIGITS) & (a["amount"] <= MOST)))
    begins = (F.col("day") != "") & (F.size("found") > 0)
    more = (F.col("day") == "") & (F.size("all") == 0) & (F.octet_length("line") > 3) & ~F.col("line").rlike("^[0-9]")
    rows = rows.withColumn("begins", begins).where(F.col("begins") | more)
    # What an amount covers leaves the narration, once for each time it was found.
    taken = F.transform("found", lambda a: a["said"])
    cut = F.aggregate(_tokens(F.col("rest")), F.struct(taken.alias("left"), F.lit("").alias("text")), lambda s, t: let(F.array_position(s["left"], t), lambda at: F.when(at > 0, F.struct(
        F.concat(F.slice(s["left"], F.lit(1), at.cast("int") - 1), F.slice(s["left"], at.cast("int") + 1, F.size(s["left"]))).alias("left"), s["text"].alias("text"))).otherwise(F.struct(s["left"].alias("left"), F.concat(s["text"], t).alias("text")))))["text"]
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, _SIDE, ""), _STRAY, " "), r"\s+", " "))
    rows = rows.withColumn("said", F.when(F.col("begins"), F.when(bare == "", "(OCR)").otherwise(bare)).otherwise(F.col("line")))
    upi = F.col("said").rlike(_PAYMENT)
    runs = F.regexp_extract_all("said", F.lit("([0-9]{9,})"), F.lit(1))
    longest = F.get(F.filter(runs, lambda r: F.length(r) == F.array_max(F.transform(runs, lambda x: F.length(x)))), F.lit(0))
    name = F.when(upi, F.concat(F.lit("UPI"), F.regexp_extract("said", _PAYMENT, 1))).otherwise(F.col("said"))
    suffix = F.when(upi, F.nullif(F.trim(F.regexp_extract("said", _PAYMENT, 2)), F.lit("")))
    own = F.when(upi, F.when(F.length(F.regexp_extract("said", _PAYMENT, 1)) >= 9, F.regexp_extract("said", _PAYMENT, 1))).otherwise(longest)
    rows = rows.withColumns({"name": F.when(F.col("begins"), name).otherwise(F.col("line")), "reference": F.coalesce(suffix, own, F.lit(""))})
    rows = scanned(rows, ["file"], "row_idx", sums={"txn": F.col("begins").cast("int")}).withColumn("txn", F.col("txn") + F.col("begins").cast("int")).where("txn > 0")
    words = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "name"))), lambda x: x["name"])
    marks = F.transform(F.split(F.upper("rest"), " "), lambda w: F.rtrim(w, F.lit(".")))
    of = lambda c, name: F.max(F.when(F.col("begins"), c)).alias(name)
    amounts = F.transform("found", lambda a: a["amount"].cast(_MONEY))
    # A narration of several lines is cut after each of them, so its first line alone may be longer.
    cut = F.aggregate(F.slice(words, 2, F.size(words)), F.get(words, F.lit(0)), lambda t, w: F.left(F.trim(F.concat_ws(" ", t, w)), F.lit(NARRATION)))
    txns = rows.groupBy("file", "txn").agg(F.min("row_idx").alias("row_idx"), of(parse_date(F.col("day"), last_year), "date"), cut.alias("narration"), of(F.col("reference"), "reference"), of(amounts, "every"),
                                           of(F.col("overdrawn"), "overdrawn"), of(F.array_contains(marks, "DR"), "dr"), of(F.array_contains(marks, "CR"), "cr"))
    txns = kept(txns.select("file", "row_idx", "date", "narration", "reference", F.slice("every", F.lit(1), F.size("every") - 1).alias("amounts"), F.when(F.col("overdrawn"), -F.element_at("every", -1)).otherwise(F.element_at("every", -1)).cast(_MONEY).alias("balance"), "dr", "cr"))
    return sided(txns).select("file", "row_idx", "date", "narration", "reference", "debit", "credit", "balance")
