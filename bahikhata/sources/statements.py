"""Statement files: delimited text, ledger lists, rule files, voucher grids and positioned text items.

Rows carry (file, row_idx) from the start; order is never taken from a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bahikhata.functions.amounts import parse_amount
from bahikhata.functions.dates import parse_date
from bahikhata.functions.text import is_noise_row
from bahikhata.operators.scans import scanned
from bahikhata.operators.stages import kept
from bahikhata.sources.cells import CLOSING_WORDS, OPENING_WORDS, holds, typed

# Header words of the seven columns, in the order in which columns are chosen.
HEADER_WORDS = {
    "date": (
        "date", "dt", "transaction date", "txn date", "tran date", "trans date", "value date", "value dt", "posting date", "booking date",
        "entry date", "transaction dt", "trans dt", "effective date", "process date",
    ),
    "balance": (
        "balance", "bal", "closing balance", "running balance", "closing bal", "available balance", "balance amt", "bal amt", "balance (inr)",
        "closing balance (inr)", "balance(inr)", "outstanding balance", "total balance", "ledger balance", "total amount", "total amt", "total bal",
        "running total", "closing amount", "book balance", "net balance",
    ),
    "debitcredit": (
        "debit/credit", "debit / credit", "debit/credit(₹)", "debit / credit(₹)", "debit/credit (₹)", "debit / credit (₹)", "debit/credit(inr)",
        "debit / credit(inr)", "debit/credit (inr)", "debit / credit (inr)", "dr/cr", "dr / cr", "dr/cr(₹)", "dr / cr(₹)",
    ),
    "debit": (
        "debit", "dr", "dr.", "withdrawal", "withdrawal amt", "withdrawal amount", "withdrawal amt.", "withdrawals", "debit amount", "dr amount",
        "dr amt", "debit amt", "withdrawal amt.(inr)", "withdrawal amt. (inr)", "withdrawal amount (inr)", "withdrawal (dr)", "withdrawal (dr.)",
        "withdrawal(dr)", "withdrawal(dr.)", "debit (inr)", "debit(dr)", "paid out", "amount debit", "debit amount (inr)", "w/d",
    ),
    "credit": (
        "credit", "cr", "cr.", "deposit", "deposit amt", "deposit amount", "deposit amt.", "deposits", "credit amount", "cr amount", "cr amt",
        "credit amt", "deposit amt.(inr)", "deposit amt. (inr)", "deposit amount (inr)", "deposit (cr)", "deposit (cr.)", "deposit(cr)",
        "deposit(cr.)", "credit (inr)", "credit(cr)", "paid in", "amount credit", "credit amount (inr)",
    ),
    "narration": (
        "narration", "description", "particulars", "details", "remarks", "transaction description", "transaction remarks", "transaction narration",
        "transaction details", "tran description", "tran remarks", "transaction particulars", "transaction details/remarks", "tran particulars",
        "trans particulars", "chq/trn details", "trn description", "particulars of transaction", "payment details", "beneficiary details",
        "sender details",
    ),
    "reference": (
        "reference", "ref no", "ref number", "ref.no.", "chq/ref no", "chq/ref. no.", "cheque / ref no", "cheque/ref no", "chq / ref number",
        "ref / chq no", "chq./ref.no.", "chq.ref.no.", "chq./ref no.", "chq. / ref. no.", "cheque no", "cheque no.", "cheque number", "chq no",
        "chq no.", "chq.no.", "chq. no.", "chq./txn. no.", "chq./txn.no.", "chq/txn no", "chq/txn no.", "txn no", "txn no.", "txn. no.", "txn number",
        "chq.", "transaction id", "utr", "utr no", "utr no.", "utr number", "instrument no", "instrument no.", "instrument", "instruments", "tran id",
        "chq / instrument no", "chq/instrument no", "ref.no", "ref no.", "ref num", "ref",
    ),
}


def header_scores(cells: DataFrame) -> DataFrame:
    """(file, row_idx, pos, field, score) of header cells: equal 100, starts 60, ends 40, holds 20, is held 10."""
    words = [F.struct(F.lit(f).alias("field"), F.lit(w).alias("word")) for f, ws in HEADER_WORDS.items() for w in ws]
    cell = cells.select("file", "row_idx", F.posexplode("cells").alias("pos", "cell")).withColumn("v", F.lower(F.trim("cell"))).where("v <> ''")
    pairs = cell.select("file", "row_idx", "pos", "v", F.explode(F.array(*words)).alias("w")).select("file", "row_idx", "pos", "v", "w.field", "w.word")
    long = F.length("word") >= 4
    score = (F.when(F.col("v") == F.col("word"), 100).when(F.startswith("v", "word"), 60).when(F.endswith("v", "word"), 40)
             .when(long & F.contains("v", "word"), 20).when((F.length("v") >= 4) & F.startswith("word", "v"), 10).otherwise(0))
    return pairs.groupBy("file", "row_idx", "pos", "field").agg(F.max(score).alias("score")).where("score > 0")


def columns_of(cells: DataFrame, first: int = 50) -> DataFrame:
    """(file, header_row, date, balance, ...): the first row of ``first`` with a date and an amount column; -1 for none.

    Fields choose in their order, each the best cell that is still free, the leftmost of equals.
    """
    scores = header_scores(cells.where(F.col("row_idx") < first))
    # A combined column may not take a cell that is exactly a debit or credit header.
    exact = scores.where("score = 100 and field in ('debit', 'credit')").select("file", "row_idx", "pos", F.lit("debitcredit").alias("field"))
    scores = scores.join(exact, ["file", "row_idx", "pos", "field"], "left_anti")
    rows = scores.groupBy("file", "row_idx").agg(F.collect_list(F.struct("field", "score", "pos")).alias("all"))
    free = F.array().cast("array<int>")
    for field in HEADER_WORDS:
        best = lambda used, field=field: F.array_sort(F.transform(F.filter("all", lambda x: (x["field"] == field) & (x["score"] >= 10) & ~F.array_contains(used, x["pos"])), lambda x: F.struct((-x["score"]).alias("k"), x["pos"].alias("pos"))))
        rows = rows.withColumn("_used", F.col("_used") if "_used" in rows.columns else free)
        rows = rows.withColumn(field, F.coalesce(F.get(best(F.col("_used")), F.lit(0))["pos"], F.lit(-1))).withColumn("_used", F.concat("_used", F.array(field)))
    good = rows.where("date >= 0 and (debit >= 0 or credit >= 0 or debitcredit >= 0)")
    return good.groupBy("file").agg(F.min_by(F.struct(F.col("row_idx").alias("header_row"), *HEADER_WORDS), "row_idx").alias("c")).select("file", "c.*")


def content_columns(cells: DataFrame, sample: int = 15) -> DataFrame:
    """columns_of with its gaps filled from the content, and header_row -1 for files without a header.

    The first ``sample`` rows with content after the header, 3 at least, choose among the columns that are still free: the date is the
    column with most dates, over 50 %; the balance that with most amounts, over 70 %; debit and credit, both missing, the
    leftmost two with amounts over 30 %; the narration the widest with text over 30 %. Of equals the last one, as the reference does.
    Files that then have no date or no amount column are left out.
    """
    head = columns_of(cells)
    known = cells.select("file").distinct().join(head, "file", "left").select("file", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("header_row", *HEADER_WORDS)])
    rows = cells.join(known.select("file", "header_row"), "file").where((F.col("row_idx") > F.col("header_row")) & F.exists("cells", lambda c: F.trim(c) != ""))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("row_idx"))).where(F.col("n") <= sample)
    cell = rows.select("file", "n", F.posexplode("cells").alias("pos", "cell")).withColumn("v", F.trim("cell")).where("v <> ''")
    cell = cell.withColumn("is_date", parse_date(F.col("v")).isNotNull()).withColumn("is_amount", parse_amount(F.col("v")).isNotNull())
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    stats = cell.groupBy("file", "pos").agg(F.count("*").alias("total"), count(F.col("is_date"), "dates"), count(F.col("is_amount"), "amounts"),
                                            count(~F.col("is_date") & ~F.col("is_amount"), "texts"), F.avg(F.octet_length("v")).alias("width"))
    stats = stats.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "total", "dates", "amounts", "texts", "width"))).alias("all"))
    enough = rows.groupBy("file").agg(F.max("n").alias("n")).where("n >= 3").select("file")
    at = known.join(stats.join(enough, "file"), "file", "left")
    taken = lambda: F.array(*[F.col(f) for f in HEADER_WORDS])
    free = lambda ok: F.filter("all", lambda x: ~F.array_contains(taken(), x["pos"]) & ok(x))
    best = lambda ok, by: F.coalesce(F.array_max(F.transform(free(ok), lambda x: F.struct(x[by].alias("k"), x["pos"].alias("pos"))))["pos"], F.lit(-1))
    missing = lambda field, found: F.when(F.col(field) < 0, found).otherwise(F.col(field))
    at = at.withColumn("date", missing("date", best(lambda x: x["dates"] * 2 > x["total"], "dates")))
    at = at.withColumn("balance", missing("balance", best(lambda x: x["amounts"] * 10 > x["total"] * 7, "amounts")))
    # A combined column decides alone: its sign says which side an amount is on.
    open_ = F.expr("debit < 0 and credit < 0 and debitcredit < 0")
    at = at.withColumn("_two", F.when(open_, F.transform(free(lambda x: x["amounts"] * 10 > x["total"] * 3), lambda x: x["pos"])))
    at = at.withColumn("debit", F.coalesce(F.get("_two", F.lit(0)), "debit")).withColumn("credit", F.coalesce(F.get("_two", F.lit(1)), "credit"))
    at = at.withColumn("narration", missing("narration", best(lambda x: x["texts"] * 10 > x["total"] * 3, "width")))
    return at.where("date >= 0 and (debit >= 0 or credit >= 0 or debitcredit >= 0)").select("file", "header_row", *HEADER_WORDS)


def files_without_rows(cells: DataFrame) -> DataFrame:
    """(file): the files that give no transaction."""
    return cells.select("file").distinct().join(statement_rows(cells), "file", "left_anti")


def statement_rows(cells: DataFrame) -> DataFrame:
    """(file, row_idx, date, narration, reference, debit, credit, balance) of sheets of cells, in their order."""
    return sheets(cells)[0]


def sheets(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The transactions of ``statement_rows``, and (file, opening, closing).

    A dated row with an amount is a transaction; an undated row with a narration and no amount goes on with the one before. The first row of a balance alone
    that says closing is the closing balance, the first that says opening or nothing the opening one; where there is none, a row above the header that
    names it is. Totals and headings are left out.
    """
    cells = kept(cells)
    columns = kept(content_columns(cells))
    at = cells.join(columns, "file")
    of = lambda c: F.when(F.col(c) >= 0, F.coalesce(F.get("cells", F.col(c)), F.lit(""))).otherwise("").alias(c)
    below = at.where(F.col("row_idx") > F.col("header_row"))
    rows = typed(below.select("file", F.col("row_idx").cast("long").alias("row"), "header_row", (F.col("credit") >= 0).alias("two_sided"), *[of(c) for c in HEADER_WORDS]))
    rows = kept(rows.withColumn("noise", is_noise_row(F.col("narration"))))
    text, low = F.col("narration"), F.lower("narration")
    bare = F.col("only") & F.col("balance").isNotNull()
    closing = bare & holds(low, CLOSING_WORDS)
    # Rows that state a balance are few; one that could state both is the closing one, if none was before.
    stating = rows.where(closing | (bare & ((text == "") | holds(low, OPENING_WORDS)))).select("file", "row", "balance", closing.alias("ends"), ((text == "") | holds(low, OPENING_WORDS)).alias("starts"))
    end = stating.where("ends").groupBy("file").agg(F.min(F.struct("row", "balance")).alias("end"))
    start = stating.where("starts").join(end, "file", "left").where("end is null or row <> end.row").groupBy("file").agg(F.min(F.struct("row", "balance")).alias("start"))
    stated = end.join(start, "file", "full")
    rows = rows.join(stated.select("file", F.col("end.row").alias("_end"), F.col("start.row").alias("_start")), "file", "left").where("not (row <=> _end) and not (row <=> _start)")
    rows = rows.where(~F.col("noise")).withColumn("begins", F.col("day").isNotNull() & F.coalesce("debit", "credit").isNotNull())
    rows = rows.where(F.col("begins") | (F.col("day").isNull() & F.col("only") & (text != "")))
    rows = scanned(rows, ["file"], "row", sums={"txn": F.col("begins").cast("int")}).withColumn("txn", F.col("txn") + F.col("begins").cast("int")).where("txn > 0")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "narration"))), lambda x: x["narration"]), " ")
    first = lambda c, name: F.min_by(c, "row").alias(name)
    found = rows.groupBy("file", "txn").agg(F.min("row").alias("row_idx"), first("day", "date"), F.trim(lines).alias("narration"), *[first(c, c) for c in ("reference", "debit", "credit", "balance")]).drop("txn")
    above = at.where(F.col("row_idx") < F.col("header_row")).select("file", "row_idx", F.lower(F.array_join("cells", " ")).alias("line"), F.filter(F.transform("cells", parse_amount), lambda a: a > 0).alias("amounts")).where("size(amounts) > 0")
    named = lambda w: F.col("line").rlike(rf"\b{w}\s+bal")
    head = above.where(named("opening") | named("closing")).groupBy("file").agg(*[F.min_by(F.element_at("amounts", i), F.when(named(w), F.col("row_idx"))).alias(w) for w, i in (("opening", 1), ("closing", -1))])
    balances = stated.join(head, "file", "full").select("file", F.coalesce("start.balance", "opening").alias("opening"), F.coalesce("end.balance", "closing").alias("closing"))
    return found, balances


def ledgers(cells: DataFrame) -> DataFrame:
    """(file, name, group) of ledger lists given as cells. Each file's first row names its own columns: Name, and Under or Group if there is one; a file without
    a name column gives no rows."""
    head = cells.groupBy("file").agg(F.min(F.struct("row_idx", "cells")).alias("h")).select("file", F.col("h.row_idx").alias("_at"), F.transform("h.cells", lambda c: F.lower(F.trim(c))).alias("_head"))
    rows = cells.join(head, "file").where("row_idx > _at")

    def cell(*names: str) -> Column:
        places = [F.nullif(F.array_position("_head", n), F.lit(0)) for n in names]
        place = F.coalesce(*places) if len(places) > 1 else places[0]
        return F.trim(F.get("cells", (place - 1).cast("int")))
    return rows.select("file", cell("name").alias("name"), F.coalesce(cell("under", "group"), F.lit("")).alias("group")).where("name <> ''")


def rules_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "version int, rules array<struct<pattern:string,vendor:string,account_head:string,txn_type:string>>"
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", schema)["rules"]).alias("r")).select("r.*")


def tally_vouchers(cells: DataFrame) -> DataFrame:
    """Vouchers of an exported grid by header words; amount, else debit, else credit; rows without date or content go."""
    head = cells.where("row_idx = 0").select("file", F.transform("cells", lambda c: F.lower(c)).alias("h"))

    def find(*words: str) -> Column:
        def holds(word: str) -> Column:
            return F.array_position(F.transform("h", lambda c: F.contains(c, F.lit(word))), True)
        hit = [holds(w) for w in words]
        return F.coalesce(*[F.when(h > 0, h - 1) for h in hit])
    cols = head.select("file", find("date").alias("c_date"), find("amount").alias("c_amount"), find("debit").alias("c_debit"), find("credit").alias("c_credit"), find("narration", "particulars").alias("c_narr"), find("voucher no", "vch no").alias("c_no"), find("type").alias("c_type"))
    of = lambda c: F.coalesce(F.get("cells", F.col(c).cast("int")), F.lit(""))
    rows = cells.where("row_idx > 0").join(cols, "file")
    amount = F.abs(F.coalesce(parse_amount(of("c_amount")), parse_amount(of("c_debit")), parse_amount(of("c_credit")), F.lit(0).cast("decimal(18,2)")))
    rows = rows.select("file", "row_idx", parse_date(of("c_date")).alias("date"), amount.alias("amount"), of("c_narr").alias("narration"), of("c_no").alias("voucher_no"), of("c_type").alias("voucher_type"))
    return rows.where("date is not null and not (amount = 0 and trim(narration) = '')")


def clustered(items: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(file, page, row, items): text items grouped to rows; a row starts where y leaves its first item's by more than the tolerance.

    A gap of more than the tolerance always starts one, so rows are only looked for inside the runs between gaps: a page costs as much as its items. Items
    without a y are row -1.
    """
    page = Window.partitionBy("file", "page").orderBy("y")
    at = items.select("file", "page", F.col("y").cast("double").alias("y"), "x", "w", "text")
    at = at.withColumn("_run", F.sum(F.coalesce((F.col("y") - F.lag("y").over(page) > tolerance).cast("int"), F.lit(0))).over(page))
    runs = at.groupBy("file", "page", "_run", F.col("y").isNull().alias("_none")).agg(F.array_sort(F.collect_list(F.struct("y", "x", "text", "w"))).alias("all"))
    new = lambda seen, y: F.coalesce(F.abs(y - F.try_element_at(seen, F.lit(-1))) > tolerance, F.size(seen) == 0)
    starts = F.aggregate("all", F.array().cast("array<double>"), lambda seen, i: F.when(new(seen, i["y"]), F.concat(seen, F.array(i["y"]))).otherwise(seen))
    rows = runs.withColumn("starts", starts).select("file", "page", "_run", "_none", "all", "starts", F.posexplode("starts").alias("_i", "_start")).withColumn("_next", F.get("starts", F.col("_i") + 1))
    one = F.filter("all", lambda i: F.col("_none") | ((i["y"] >= F.col("_start")) & F.coalesce(i["y"] < F.col("_next"), F.lit(True))))
    number = F.row_number().over(Window.partitionBy("file", "page", "_none").orderBy("_run", "_i")) - 1
    return rows.select("file", "page", F.when(F.col("_none"), F.lit(-1)).otherwise(number).alias("row"), F.array_sort(F.transform(one, lambda i: F.struct(i["x"].alias("x"), i["text"].alias("text"), i["w"].alias("w")))).alias("items"))


def assigned(items: DataFrame, bounds: DataFrame) -> DataFrame:
    """Items put into the field whose range of x holds them: a range join against a few fences a file, joined in order of x."""
    hit = items.join(bounds, "file").where((F.col("x") >= F.col("x_min")) & (F.col("x") < F.col("x_max")))
    return hit.groupBy("file", "page", "row", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda i: i["text"]), " ").alias("cell"))
