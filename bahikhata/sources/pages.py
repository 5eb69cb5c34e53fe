"""Statement pages end to end: from text items with places to transactions.

Items (file, page, y, x, w, text) are put into rows, a header row or the content gives the columns (``sources.positions``), and the rows of
a file are read in order. What a reader would carry from row to row (the last transaction, buffered words, a row that waits for its amount) is
told by counts: the transactions and the dated rows before a row number the stretches between them, and what is carried into a stretch is an aggregate of
it. Counts and last values come from ``scans.scanned``, so a long file is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bahikhata.functions.amounts import let, parse_amount
from bahikhata.functions.dates import parse_date
from bahikhata.functions.text import is_noise_row
from bahikhata.operators.scans import scanned
from bahikhata.operators.stages import kept
from bahikhata.sources import positions
from bahikhata.sources.cells import CLOSING_WORDS, OPENING_WORDS, holds, typed
from bahikhata.sources.statements import clustered

# Words that stand on a row of their own before the row they belong to, the same with "-" or "/" behind, and those that end the transactions.
TYPE_CODES = ("UPI", "NEFT", "IMPS", "RTGS", "CHQ", "CASH", "ATM", "POS", "ECS", "EMI", "SWP", "RFD", "REV", "CLG", "NACH", "TRF", "FT", "DD", "SI")
OPEN_TYPE_CODES = ("UPI", "NEFT", "IMPS", "RTGS", "CHQ", "CASH", "ATM", "POS", "ECS", "EMI", "TRF", "NACH", "DD")
ENDINGS = ("statement of fixed deposit", "fixed deposit a/c", "summary of tds")
# Words of narrations that say the side, a list for each pattern of words that must all be there.
DEBIT_WORDS = (("upi-dr",), ("upi dr",), ("/dr/",), ("-dr/",), ("-dr-",), ("neft", "dr"), ("rtgs", "dr"), ("cash wd",), ("atm wd",))
CREDIT_WORDS = (("upi-cr",), ("upi cr",), ("/cr/",), ("-cr/",), ("-cr-",), ("neft", "cr"), ("rtgs", "cr"), ("interest",), ("refund",), ("reversal",), ("salary",))

_FIELDS = ("date", "narration", "reference", "debit", "credit", "balance", "debitcredit")


def says(text: Column, patterns: tuple[tuple[str, ...], ...]) -> Column:
    found = F.lit(False)
    for words in patterns:
        every = F.lit(True)
        for w in words:
            every = every & F.contains(text, F.lit(w))
        found = found | every
    return found


def placed_rows(items: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(file, page, row, items): the rows of a file numbered through from 0, page after page."""
    rows = kept(clustered(items, tolerance))
    sizes = rows.groupBy("file", "page").agg((F.max("row") + 1).alias("n"))
    before = Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return rows.join(base, ["file", "page"]).select("file", "page", (F.col("_base") + F.col("row")).alias("row"), "items")


def each_item(rows: DataFrame) -> DataFrame:
    """(file, page, row, x, w, text)"""
    return rows.select("file", "page", "row", F.explode("items").alias("i")).select("file", "page", "row", "i.x", "i.w", "i.text")


def placed(items: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(file, page, row, x, w, text): the items of ``placed_rows``."""
    return each_item(placed_rows(items, tolerance))


def columns_of(items: DataFrame) -> DataFrame:
    """(file, header_row, columns, field, x_min, x_max): from the header row, else from the content (header_row -1)."""
    heads = positions.header_of(items)
    guessed = positions.inferred_columns(items).join(heads.select("file"), "file", "left_anti")
    guessed = guessed.select("file", F.lit(-1).cast("long").alias("header_row"), F.array_sort(F.map_values("columns")).alias("fences"), "columns")
    known = heads.select("file", F.col("header_row").cast("long").alias("header_row"), "fences", "columns").unionByName(guessed)
    return known.join(positions.bounds(known), "file").select("file", "header_row", F.map_contains_key("columns", "credit").alias("two_sided"), "field", "x_min", "x_max")


def cells_of(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(file, row, header_row, two_sided, date, narration, reference, debit, credit, balance, debitcredit) of the rows (``placed_rows``) below the header, as text.

    A row holds its items, so only the few rows that end a file are grouped.
    """
    places = F.collect_list(F.struct("field", F.col("x_min").cast("double").alias("x_min"), F.col("x_max").cast("double").alias("x_max")))
    head = columns.groupBy("file", "header_row", "two_sided").agg(places.alias("_places"))
    below = rows.join(head, "file").where("row > header_row")
    line = F.lower(F.array_join(F.transform("items", lambda i: i["text"]), " "))
    ends = below.select("file", "row", line.alias("line")).where(holds(F.col("line"), ENDINGS) | (F.contains("line", F.lit("additions")) & F.contains("line", F.lit("deductions"))))
    ends = ends.groupBy("file").agg(F.min("row").alias("_end"))
    texts = lambda p: F.transform(F.filter("items", lambda i: (i["x"] >= p["x_min"]) & (i["x"] < p["x_max"])), lambda i: i["text"])
    cell = lambda p: let(texts(p), lambda t: F.when(F.size(t) > 0, F.struct(p["field"].alias("field"), positions.cell_value(p["field"], t).alias("cell"))))
    found = below.select("file", "row", "header_row", "two_sided", F.filter(F.transform("_places", cell), lambda c: c.isNotNull()).alias("_cells")).where("size(_cells) > 0")
    found = found.join(ends, "file", "left").where("_end is null or row < _end").withColumn("_cells", F.map_from_entries("_cells"))
    return found.select("file", "row", *[F.coalesce(F.try_element_at("_cells", F.lit(f)), F.lit("")).alias(f) for f in _FIELDS], "header_row", "two_sided")


def stitched(rows: DataFrame) -> DataFrame:
    """Rows whose date breaks off ("25 May", "03/Apr/20") joined with the next row, if that completes it: two to four digits and no amount.

    A row that could complete a date is grouped with the row before it, and the two part again if it doesn't.
    """
    end = F.trim("date").rlike("^[0-9]{2,4}$") & parse_amount(F.col("debit")).isNull() & parse_amount(F.col("credit")).isNull() & parse_amount(F.col("balance")).isNull()
    kept = [c for c in rows.columns if c not in ("file", "_owner")]
    both = rows.withColumn("_end", end).withColumn("_owner", F.when(F.col("_end"), F.col("row") - 1).otherwise(F.col("row")))
    pick = lambda is_end, name: F.max(F.when(F.col("_end") == is_end, F.struct(*kept))).alias(name)
    pairs = both.groupBy("file", "_owner").agg(pick(False, "a"), pick(True, "b"))
    day, more = F.trim("a.date"), F.trim("b.date")
    bare = day.rlike(r"^[0-9]+\s+[\p{L}]+$")
    cut = day.rlike(r"^[0-9]+[/\-.][\p{L}]+[/\-.][0-9]{1,3}$")
    whole = F.when(bare, F.concat(day, F.lit(" "), more)).when(cut, F.concat(day, more))
    # Only a broken date before a row that could end it is looked at.
    pairs = pairs.withColumn("_whole", F.when(F.col("b").isNotNull() & (bare | cut), whole))
    found = F.when(F.col("_whole").isNotNull(), parse_date(F.col("_whole")))
    pairs = pairs.withColumn("_found", found)
    pairs = pairs.withColumn("_fits", F.when(F.col("_found").isNotNull(), ~F.coalesce(F.col("_found") == parse_date(day), F.lit(False))))
    whole, fits = F.col("_whole"), F.coalesce("_fits", F.lit(False))
    one = F.struct(*[F.when(fits, whole).otherwise(F.col("a.date")).alias("date") if c == "date" else F.trim(F.concat_ws(" ", F.nullif(F.trim("a.narration"), F.lit("")), F.nullif(F.trim("b.narration"), F.lit("")))).alias(c) if c == "narration" else F.col(f"a.{c}").alias(c) for c in kept])
    apart = F.filter(F.array("a", "b"), lambda x: x.isNotNull())
    return pairs.select("file", F.explode(F.when(fits, F.array(one)).otherwise(apart)).alias("z")).select("file", "z.*")


def transactions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The transactions (file, row, header_row, date, narration, reference, debit, credit, balance) of ``typed`` rows, and (file, opening, closing).

    A dated row with an amount is a transaction. A dated row with a narration and a balance waits: the next dated row with an amount and no narration completes it,
    any other dated row with a narration drops it. Undated words before the first transaction, or a type code later on, go before the narration of the next dated
    row; other undated words are added to the transaction before. A balance alone belongs to the transaction before if that has none, else the first one is the opening balance;
    the first row of a balance with words for an opening or a closing is that, and no such row is anything else. Totals and headings are left out.
    """
    text, low = F.col("narration"), F.lower("narration")
    bare = F.col("only") & F.col("balance").isNotNull()
    closing, opening = bare & holds(low, CLOSING_WORDS), bare & holds(low, OPENING_WORDS)
    dated, noise = F.col("day").isNotNull(), (text != "") & is_noise_row(text)
    moved = F.col("debit").isNotNull() | F.col("credit").isNotNull()
    kind = (F.when(closing, "closing").when(opening, "opening").when(bare & (text == ""), "balance").when(noise, "none")
            .when(dated, F.when(moved, "push").otherwise("dated")).when(F.col("only") & (text != ""), "words").otherwise("none"))
    rows = rows.withColumn("kind", kind).where("kind <> 'none'")
    rows = scanned(rows, ["file"], "row", sums={"pushes": (F.col("kind") == "push").cast("int"), "days": F.col("kind").isin("push", "dated").cast("int")})
    rows = kept(rows)
    code = F.upper(text).isin(*TYPE_CODES) | F.upper(text).isin(*[f"{w}{e}" for w in OPEN_TYPE_CODES for e in "-/"])
    first = (F.col("pushes") == 0) & F.col("balance").isNull()
    rows = rows.withColumn("kind", F.when(F.col("kind") == "words", F.when(first, "before").when(code & F.col("balance").isNull(), "code").when(F.col("pushes") > 0, "after").otherwise("none")).otherwise(F.col("kind")))
    if_ = lambda c, k: F.when(F.col("kind").isin(k) if isinstance(k, str) else F.col("kind").isin(*k), c)
    joined = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(if_(F.struct("row", "narration"), k))), lambda x: x["narration"]), " ")
    # The dated row that ends a stretch between dated rows, with the words that stood before it.
    values = ["row", "header_row", "day", "narration", "reference", "debit", "credit", "balance", "pushes"]
    days = rows.groupBy("file", "days").agg(F.max(if_(F.struct(*values), ("push", "dated"))).alias("z"), joined("before").alias("words"), F.max_by(if_(text, "code"), if_(F.col("row"), "code")).alias("code")).where("z is not null")
    days = days.select("file", "z.*", F.concat_ws(" ", F.nullif("words", F.lit("")), "code", F.nullif("z.narration", F.lit(""))).alias("said"))
    paid = F.col("debit").isNotNull() | F.col("credit").isNotNull()
    waits = ~paid & (F.col("said") != "") & F.col("balance").isNotNull()
    note = F.struct(waits.alias("waits"), "day", F.col("said").alias("narration"), "reference", "balance")
    days = scanned(days, ["file"], "row", lasts={"held": F.when(paid | (F.col("said") != ""), note)})
    done = F.coalesce((F.col("said") == "") & F.col("held.waits"), F.lit(False))
    of = lambda c, own: F.when(done, F.col(f"held.{c}")).otherwise(own)
    found = days.where(paid).select("file", "row", "header_row", (F.col("pushes") + 1).alias("pushes"), of("day", F.col("day")).alias("date"), of("narration", F.col("said")).alias("narration"), of("reference", F.col("reference")).alias("reference"), "debit", "credit",
                                    F.when(done, F.col("held.balance")).otherwise(F.col("balance")).alias("own"))
    # What follows a transaction up to the next one.
    later = rows.where("kind in ('after', 'balance') and pushes > 0").groupBy("file", "pushes").agg(joined("after").alias("words"), F.min_by("balance", F.when(F.col("balance").isNotNull(), F.col("row"))).alias("next"), F.min(F.when(F.col("balance").isNotNull(), F.col("row"))).alias("next_row"))
    found = found.join(later, ["file", "pushes"], "left")
    used = found.where("own is null and next is not null").select("file", F.col("next_row").alias("row"))
    starts = rows.where("kind in ('opening', 'balance')").join(used, ["file", "row"], "left_anti").groupBy("file").agg(F.min_by("balance", "row").alias("opening"))
    ends = rows.where("kind = 'closing'").groupBy("file").agg(F.min_by("balance", "row").alias("closing"))
    found = found.select("file", "row", "header_row", "date", F.concat_ws(" ", F.nullif("narration", F.lit("")), F.nullif("words", F.lit(""))).alias("narration"), "reference", "debit", "credit", F.coalesce("own", "next").alias("balance"))
    return found, starts.join(ends, "file", "full")


def stated_above(items: DataFrame, columns: DataFrame) -> DataFrame:
    """(file, opening, closing) of the rows above a header that name them: the first amount of the first such row, and the last."""
    head = columns.select("file", "header_row").distinct()
    above = items.join(head, "file").where("row < header_row").groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("all"))
    texts = F.transform("all", lambda i: i["text"])
    amounts = F.filter(F.transform(texts, parse_amount), lambda a: a > 0)
    rows = above.select("file", "row", F.lower(F.array_join(texts, " ")).alias("line"), amounts.alias("amounts")).where("size(amounts) > 0")
    named = lambda w: F.contains("line", F.lit(f"{w} bal"))
    first = lambda w, at: F.min_by(F.element_at("amounts", at), F.when(named(w), F.col("row"))).alias(w)
    return rows.where(named("opening") | named("closing")).groupBy("file").agg(first("opening", 1), first("closing", -1))


def guessed_sides(txns: DataFrame, balances: DataFrame) -> DataFrame:
    """Transactions of files without a header row, whose side is taken from words of the narration and then from the movement of the balance."""
    low = F.lower("narration")
    out, in_ = says(low, DEBIT_WORDS), says(low, CREDIT_WORDS)
    amount = F.coalesce("debit", "credit")
    guess = F.col("header_row") < 0
    rows = txns.withColumns({"debit": F.when(guess & out & ~in_, amount).when(guess & in_ & ~out, None).otherwise(F.col("debit")), "credit": F.when(guess & in_ & ~out, amount).when(guess & out & ~in_, None).otherwise(F.col("credit"))})
    rows = scanned(rows, ["file"], "row", lasts={"_last": F.col("balance")}).join(balances.select("file", F.col("opening").alias("_opening")), "file", "left")
    moved = F.col("balance") - F.coalesce("_last", "_opening")
    near = lambda gap, a: F.abs(gap) < F.greatest(F.lit(1), a * F.lit("0.02").cast("decimal(3,2)"))
    to_credit = F.coalesce(guess & F.col("credit").isNull() & near(moved - F.col("debit"), F.col("debit")), F.lit(False))
    to_debit = F.coalesce(guess & F.col("debit").isNull() & near(moved + F.col("credit"), F.col("credit")), F.lit(False))
    both = F.coalesce("debit", "credit")
    return rows.withColumns({"_up": to_credit, "_down": to_debit, "_a": both}).withColumns({"debit": F.when(F.col("_up"), None).when(F.col("_down"), F.col("_a")).otherwise(F.col("debit")), "credit": F.when(F.col("_down"), None).when(F.col("_up"), F.col("_a")).otherwise(F.col("credit"))}).drop("_last", "_opening", "_up", "_down", "_a")


def page_transactions(items: DataFrame, tolerance: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(file, row, date, narration, reference, debit, credit, balance) of the items' pages, and (file, opening, closing)."""
    rows = kept(placed_rows(items, tolerance))
    top = each_item(rows.where(F.col("row") < 60))
    columns = kept(columns_of(top))
    txns, stated = transactions(kept(typed(stitched(cells_of(rows, columns)))))
    above = stated_above(top, columns).select("file", F.col("opening").alias("_o"), F.col("closing").alias("_c"))
    balances = stated.join(above, "file", "full").select("file", F.coalesce("opening", "_o").alias("opening"), F.coalesce("closing", "_c").alias("closing"))
    return guessed_sides(txns, balances).drop("header_row"), balances
