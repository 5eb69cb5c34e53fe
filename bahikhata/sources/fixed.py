"""Statements whose pages are lines of fixed width: one text item a row, columns by the place in the line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bahikhata.functions.amounts import let
from bahikhata.functions.dates import parse_date
from bahikhata.operators.scans import scanned
from bahikhata.operators.stages import kept
from bahikhata.sources.pages import says

# Words of narrations that say the side, a list for each pattern of words that must all be there.
DEBIT_WORDS = (("upi-dr",), ("upi dr",), ("/dr/",), ("-dr-",), ("neft", "dr"), ("rtgs", "dr"), ("cash wd",), ("atm wd",), ("by debit",), ("chg dr",))
CREDIT_WORDS = (("upi-cr",), ("upi cr",), ("/cr/",), ("-cr-",), ("neft", "cr"), ("rtgs", "cr"), ("interest",), ("refund",), ("reversal",), ("salary",), ("by cr",))
#: Rows that are looked at, rows at least, the share of them that must fit and the width of a fit.
SAMPLE, LEAST, SHARE, WIDTH = 30, 5, 0.85, 5.0
#: More digits before the point than an amount has.
REFERENCE_DIGITS = 10
_AMOUNT = r"[0-9][0-9,]*\.[0-9]+"
_DATE = r"^([0-9]{2})[-/\x{2212}\x{2013}]([0-9]{2})[-/\x{2212}\x{2013}]([0-9]{4})"
_MONEY = "decimal(18,2)"


def lines_of(items: DataFrame) -> DataFrame:
    """(file, row, line): the leftmost item of each row of ``pages.placed`` items."""
    return items.groupBy("file", "row").agg(F.min(F.struct("x", "text"))["text"].alias("line"))


def fitting(items: DataFrame) -> DataFrame:
    """(file) of files whose items of a row begin at one place: SHARE of the first SAMPLE rows, of LEAST at least."""
    rows = items.groupBy("file", "row").agg((F.max("x") - F.min("x")).alias("span")).where(F.col("row") < SAMPLE)
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("span") < WIDTH).alias("fit")).where((F.col("n") >= LEAST) & (F.col("fit") >= SHARE * F.col("n"))).select("file")


def layouts(lines: DataFrame) -> DataFrame:
    """(file, header_row, out_at, middle): the first heading of SAMPLE rows; where the column of withdrawals begins and where it ends, both null if one column holds all amounts."""
    low = F.lower("line")
    has = lambda *words: F.lit(False) if not words else low.rlike("|".join(words))
    at = lambda a, b: F.coalesce(F.nullif(F.instr(low, F.lit(a)), F.lit(0)), F.instr(low, F.lit(b))) - 1
    two = has("withdrawal", "debit") & has("deposit", "credit")
    one = has("amount", "amt") & ~has("withdrawal", "deposit")
    out_at, in_at = at("withdrawal", "debit"), at("deposit", "credit")
    heads = lines.where((F.col("row") < SAMPLE) & F.contains(low, F.lit("date")) & F.contains(low, F.lit("balance")) & (two | one))
    shape = F.struct(F.col("row").alias("header_row"), F.when(two, out_at).alias("out_at"), F.when(two, F.floor((out_at + in_at) / 2)).cast("int").alias("middle"))
    return heads.groupBy("file").agg(F.min_by(shape, "row").alias("h")).select("file", "h.*")


def amounts_in(text: Column) -> Column:
    """array<struct<at, said, amount>> of the amounts in a text: digits and commas with one or two decimals, more than nothing."""
    def placed(parts: Column, found: Column) -> Column:
        ends = F.aggregate(found, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda seen, f: F.struct(
            (seen["i"] + 1).alias("i"), (seen["at"] + F.length(F.get(parts, seen["i"])) + F.length(f)).alias("at"), F.concat(seen["all"], F.array(seen["at"] + F.length(F.get(parts, seen["i"])))).alias("all")))["all"]
        return F.transform(found, lambda f, i: F.struct(F.get(ends, i).alias("at"), f.alias("said"), F.replace(f, F.lit(","), F.lit("")).try_cast(_MONEY).alias("amount")))
    all_ = let(F.struct(F.split(text, _AMOUNT, -1).alias("parts"), F.regexp_extract_all(text, F.lit(f"({_AMOUNT})"), F.lit(1)).alias("found")), lambda z: placed(z["parts"], z["found"]))
    return F.filter(all_, lambda a: a["said"].rlike(r"\.[0-9]{1,2}$") & (a["amount"] > 0))


def digits_before(said: Column) -> Column:
    return F.length(F.regexp_replace(F.substring_index(said, ".", 1), "[^0-9]", ""))


def transactions(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, row, date, narration, reference, debit, credit, balance), and (file, opening, closing), of files that fit.

    A line begins with a day and ends with a balance (with a minus if overdrawn) and Cr or Dr; what stands between is the narration up to the first amount. With two columns
    an amount left of the middle between their headings is a debit, one before the first of them or of too many digits a reference. With one column the last amount counts and words of the narration
    say the side. Then the balance has the last word: a side is changed if the balance moved the other way by the amount, within 2 %.
    """
    lines = lines_of(items.join(fitting(items), "file", "left_semi"))
    lines = lines.join(layouts(lines), "file").where("row > header_row").withColumn("line", F.trim("line"))
    lines = lines.withColumn("day", parse_date(F.concat_ws("-", *[F.regexp_extract("line", _DATE, i) for i in (1, 2, 3)]))).where(F.col("line").rlike(_DATE) & F.col("day").isNotNull())
    ended = lines.where(F.lower("line").rlike("(cr|dr)$")).withColumn("base", F.rtrim(F.left("line", F.length("line") - 2)))
    ended = ended.withColumn("stated", F.element_at(F.concat(F.array(F.lit(None).cast("struct<at:int,said:string,amount:decimal(18,2)>")), amounts_in(F.col("base"))), -1)).where("stated is not null")
    # Amounts have no sign; a balance may be overdrawn: a minus right before it, behind a blank.
    overdrawn = (F.col("stated.at") > 1) & (F.substring("base", F.col("stated.at") - 1, F.lit(2)) == " -")
    start = F.lit(11)
    inner = F.when(F.col("stated.at") > start, F.substring("line", start + 1, F.col("stated.at") - start)).otherwise(F.substring("line", start + 1, F.length("line")))
    rows = ended.select("file", "row", "day", "out_at", "middle", F.when(overdrawn, -F.col("stated.amount")).otherwise(F.col("stated.amount")).cast(_MONEY).alias("balance"), inner.alias("text")).withColumns({"low": F.lower("text"), "found": amounts_in(F.col("text"))})
    opening, closing = F.col("low").rlike("opening bal|op bal"), F.col("low").rlike("closing bal|cl bal")
    rows = kept(rows.withColumn("states", F.when(opening, "opening").when(closing, "closing")))
    stated = rows.where("states is not null").groupBy("file").agg(*[F.max_by("balance", F.when(F.col("states") == s, F.col("row"))).alias(s) for s in ("opening", "closing")])
    rows = rows.where("states is null")
    two = F.col("middle").isNotNull()
    place = lambda a: start + a["at"]
    long = lambda a: digits_before(a["said"]) > REFERENCE_DIGITS
    referred = F.filter("found", lambda a: long(a) | (place(a) < F.col("out_at") - 5))
    moved = F.filter("found", lambda a: ~long(a) & (place(a) >= F.col("out_at") - 5))
    last = lambda xs: F.try_element_at(xs, F.lit(-1))["amount"]
    first = F.get(referred, F.lit(0))
    number = F.when(long(first), F.round(first["amount"], 0).cast("decimal(18,0)").cast("string")).otherwise(F.replace(F.replace(first["said"], F.lit(".00"), F.lit("")), F.lit(","), F.lit("")))
    single = F.filter("found", lambda a: ~long(a))
    only = F.try_element_at(single, F.lit(-1))
    before = F.when(two, F.coalesce(F.get("found", F.lit(0))["at"], F.length("text"))).otherwise(only["at"])
    rows = rows.withColumns({"narration": F.trim(F.left("text", before)), "one": F.when(~two, only["amount"])})
    low = F.lower("narration")
    up = ~two & says(low, CREDIT_WORDS) & ~says(low, DEBIT_WORDS)
    bounded = F.regexp_extract("narration", r"(?<![^/\- ])([0-9]{9,})(?![^/\- ])", 1)
    rows = rows.select("file", "row", F.col("day").alias("date"), "narration", F.when(two, F.coalesce(number, F.lit(""))).otherwise(bounded).alias("reference"),
                       F.when(two, last(F.filter(moved, lambda a: place(a) < F.col("middle")))).when(~up, F.col("one")).alias("debit"), F.when(two, last(F.filter(moved, lambda a: place(a) >= F.col("middle")))).when(up, F.col("one")).alias("credit"), "balance")
    return by_movement(rows.where("debit is not null or credit is not null"), stated), stated


def by_movement(rows: DataFrame, stated: DataFrame) -> DataFrame:
    """Sides changed where the balance moved the other way; the first row is held against the opening balance, if one is stated."""
    rows = scanned(rows, ["file"], "row", lasts={"_last": F.col("balance")}).join(stated.select("file", F.col("opening").alias("_opening")), "file", "left")
    moved = F.col("balance") - F.coalesce("_last", "_opening")
    near = lambda gap, a: F.coalesce(F.abs(gap) < F.greatest(F.lit(1), a * F.lit("0.02").cast("decimal(3,2)")), F.lit(False))
    up, down = F.col("credit").isNull() & near(moved - F.col("debit"), F.col("debit")), F.col("debit").isNull() & near(moved + F.col("credit"), F.col("credit"))
    return rows.withColumns({"_up": up, "_down": down}).select("file", "row", "date", "narration", "reference", F.when(F.col("_up"), None).when(F.col("_down"), F.col("credit")).otherwise(F.col("debit")).alias("debit"),
                                                              F.when(F.col("_down"), None).when(F.col("_up"), F.col("debit")).otherwise(F.col("credit")).alias("credit"), "balance")
