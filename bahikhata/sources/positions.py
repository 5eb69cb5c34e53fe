"""Tables in positioned text: the header row, the fences between its columns and the values of the cells.

Items are rows of (file, page, row, x, w, text), as ``statements.clustered`` gives them after an explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bahikhata.functions.amounts import let, parse_amount
from bahikhata.functions.dates import parse_date
from bahikhata.sources.statements import HEADER_WORDS, header_scores

_FIELDS = tuple(HEADER_WORDS)
_AMOUNTS = ("debitcredit", "debit", "credit")


def merged(items: DataFrame, gap: float = 40.0) -> DataFrame:
    """Items of a row joined while the next begins within ``gap`` of the end before."""
    order = Window.partitionBy("file", "row").orderBy("x", "text")
    new = (F.col("x") - F.lag(F.col("x") + F.col("w")).over(order) > gap).cast("int")
    runs = items.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("_run", F.sum("_new").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda i: i["text"]), " ")
    return runs.groupBy("file", "row", "_run").agg(F.min("x").alias("x"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), text.alias("text")).drop("_run")


def header_of(items: DataFrame, first: int = 60) -> DataFrame:
    """(file, header_row, fences, columns): the first of ``first`` rows with a date, a narration and an amount column.

    Each field takes the item, as it stands or merged, that scores best, the leftmost unmerged one of equals; fields choose in their order
    and one place serves one field. DEBIT/ and CREDIT within 120 points are one combined column. ``columns`` maps a field to its x.
    """
    items = items.where(F.col("row") < first).select("file", "row", F.col("x").cast("double").alias("x"), F.col("w").cast("double").alias("w"), "text")
    both = items.withColumn("kind", F.lit(0)).unionByName(merged(items).withColumn("kind", F.lit(1)))
    rows = both.groupBy("file", F.col("row").alias("row_idx")).agg(F.array_sort(F.collect_list(F.struct("kind", "x", "text"))).alias("all"))
    cells = rows.withColumn("cells", F.transform("all", lambda i: i["text"]))
    best = header_scores(cells).groupBy("file", "row_idx", "field").agg(F.min_by(F.struct("pos", "score"), F.struct(-F.col("score"), F.col("pos"))).alias("b"))
    found = best.groupBy("file", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("field", "b"))).alias("b")).join(rows, ["file", "row_idx"])
    place = lambda f: F.get("all", F.try_element_at("b", F.lit(f))["pos"])["x"]
    score = lambda f: F.try_element_at("b", F.lit(f))["score"]
    picks = []
    for f in _FIELDS:
        ok = score(f) >= 10
        if f == "debitcredit":
            for exact in ("debit", "credit"):
                ok = ok & ((score(f) == 100) | ~F.coalesce((score(exact) == 100) & (place(exact) == place(f)), F.lit(False)))
        picks.append(F.struct(F.lit(f).alias("field"), place(f).alias("x"), F.coalesce(ok, F.lit(False)).alias("ok")))
    taken = lambda kept, p: F.exists(kept, lambda k: k["x"] == p["x"])
    chosen = F.aggregate(F.array(*picks), F.array().cast("array<struct<field:string,x:double>>"), lambda kept, p: F.when(
        p["ok"] & ~taken(kept, p), F.concat(kept, F.array(F.struct(p["field"].alias("field"), p["x"].alias("x"))))).otherwise(kept))
    found = found.select("file", "row_idx", "all", F.map_from_entries(chosen).alias("c"))
    x_of = lambda f: F.try_element_at("c", F.lit(f))
    own = F.filter("all", lambda i: i["kind"] == 0)
    said = lambda f: F.lower(F.coalesce(F.get(F.filter(own, lambda i: F.abs(i["x"] - x_of(f)) < 15), F.lit(0))["text"], F.lit("")))
    split = ((F.abs(x_of("credit") - x_of("debit")) < 120) & said("debit").rlike("^(?=.*debit)(?=.*/)(?!.*(withdrawal|deposit))")
             & said("credit").rlike("^(?=.*credit)(?!.*(withdrawal|deposit))"))
    one = F.map_concat(F.map_filter("c", lambda f, x: ~f.isin(*_AMOUNTS)), F.create_map(F.lit("debitcredit"), F.least(x_of("debit"), x_of("credit"))))
    found = found.select("file", "row_idx", "all", F.when(F.coalesce(split, F.lit(False)), one).otherwise(F.col("c")).alias("columns"))
    has = lambda f: F.map_contains_key("columns", f)
    good = found.where(has("date") & has("narration") & (has("debitcredit") | has("debit") | has("credit")))
    fences = F.array_sort(F.array_distinct(F.transform(own, lambda i: i["x"])))
    top = good.groupBy("file").agg(F.min_by(F.struct(F.col("row_idx").alias("header_row"), fences.alias("fences"), "columns"), "row_idx").alias("h"))
    return top.select("file", "h.*")


def bounds(headers: DataFrame) -> DataFrame:
    """(file, field, x_min, x_max): half way to the next fence on either side, 0 and infinity at the ends."""
    each = headers.select("file", "fences", F.explode("columns").alias("field", "x"))
    left, right = F.array_max(F.filter("fences", lambda f: f < F.col("x"))), F.array_min(F.filter("fences", lambda f: f > F.col("x")))
    return each.select("file", "field", F.coalesce(F.round((left + F.col("x")) / 2), F.lit(0.0)).alias("x_min"), F.coalesce(F.round((F.col("x") + right) / 2), F.lit(float("inf"))).alias("x_max"))


def cell_value(field: Column, texts: Column) -> Column:
    """The value of a cell's texts: of amounts the joined text if it is one, else the last that is; of dates the first that is; else all joined."""
    joined = F.trim(F.array_join(texts, " "))
    amount = F.when(parse_amount(joined).isNotNull(), joined).otherwise(F.coalesce(F.try_element_at(F.filter(texts, lambda t: parse_amount(t).isNotNull()), F.lit(-1)), joined))
    date = F.trim(F.coalesce(F.get(F.filter(texts, lambda t: parse_date(t).isNotNull()), F.lit(0)), F.get(texts, F.lit(0))))
    many = F.size(texts) > 1
    return F.when(many & field.isin("debit", "credit", "balance", "debitcredit"), amount).when(many & (field == "date"), date).otherwise(joined)


def cell_values(items: DataFrame, fences: DataFrame) -> DataFrame:
    """(file, page, row, field, cell): items put between the fences of their file, a few rows a file, and their value."""
    hit = items.join(fences, "file").where((F.col("x") >= F.col("x_min")) & (F.col("x") < F.col("x_max")))
    rows = hit.groupBy("file", "page", "row", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda i: i["text"]).alias("texts"))
    return rows.select("file", "page", "row", "field", let(F.col("texts"), lambda t: cell_value(F.col("field"), t)).alias("cell"))


_DATE = r"^(?=.{6,10}$)[0-9]*[/-][0-9]*[/-][0-9]{2,}$"
_SIGNED = r"(?i)[0-9]\s*(cr|dr)$"
_PLAIN = r"^(?:(?i:rs)[A-Za-z.]*\s*)?-*[0-9,]+\.[0-9]{1,2}$"


def inferred_columns(items: DataFrame, first: int = 40, most: int = 12) -> DataFrame:
    """(file, columns) of tables without a header row: a map from field to the x of its column, in steps of ten points.

    Of the ``first`` rows up to ``most`` that begin with a date vote, two at least: the leftmost column with two dates is the date's; the rightmost
    with a Cr or Dr after its figures, else the rightmost of plain amounts, the balance's; of the other amount columns the last two are debit and
    credit, a single one debit. The narration is the leftmost column of two longer texts before the amounts, the reference the
    leftmost of figures too long for an amount behind it. Files for which this doesn't work out give no row.
    """
    rows = items.where(F.col("row") < first).select("file", "row", F.col("x").cast("double").alias("x"), F.trim("text").alias("t"))
    lead = rows.groupBy("file", "row").agg(F.min_by("t", F.struct("x", "t")).alias("lead")).where(F.col("lead").rlike(_DATE))
    lead = lead.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("row"))).where(F.col("_n") <= most)
    lead = lead.join(lead.groupBy("file").agg(F.count("*").alias("_rows")).where("_rows >= 2"), "file", "left_semi").select("file", "row")
    t = F.col("t")
    figures = F.length(F.regexp_replace(F.substring_index(F.replace(t, F.lit(","), F.lit("")), ".", 1), "[^0-9]", ""))
    kind = F.when(t.rlike(_DATE), "date").when(t.rlike(_SIGNED), "signed").when(t.rlike(_PLAIN), F.when(figures <= 10, "amount").otherwise("long")).when(F.octet_length(t) > 5, "text")
    at = (F.round(F.col("x") / 10) * 10).alias("at")
    votes = rows.join(lead, ["file", "row"]).where("t <> ''").groupBy("file", at).agg(*[F.count_if(kind == k).alias(k) for k in ("date", "signed", "amount", "long", "text")])
    # At most a page's width of columns a file.
    file = votes.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "date", "signed", "amount", "long", "text"))).alias("v")).where(F.size("v") >= 2)
    xs = lambda keep: F.transform(F.filter("v", keep), lambda b: b["at"])
    file = file.withColumn("date", F.get(xs(lambda b: b["date"] >= 2), F.lit(0))).where("date is not null")
    file = file.withColumn("amounts", xs(lambda b: (b["amount"] >= 1) & (b["long"] == 0) & (b["at"] > F.col("date"))))
    file = file.withColumn("balance", F.coalesce(F.try_element_at(xs(lambda b: b["signed"] >= 1), F.lit(-1)), F.try_element_at("amounts", F.lit(-1)))).where("balance is not null")
    file = file.withColumn("moved", F.filter("amounts", lambda x: x != F.col("balance"))).where("size(moved) > 0")
    two = F.size("moved") >= 2
    file = file.withColumns({"debit": F.try_element_at("moved", F.when(two, -2).otherwise(-1)), "credit": F.when(two, F.try_element_at("moved", F.lit(-1)))})
    file = file.withColumn("edge", F.least("debit", "credit", "balance"))
    file = file.withColumn("narration", F.get(xs(lambda b: (b["text"] >= 2) & (b["at"] > F.col("date")) & (b["at"] < F.col("edge"))), F.lit(0)))
    behind = F.coalesce("narration", "date")
    file = file.withColumn("reference", F.get(xs(lambda b: (b["long"] >= 1) & (b["at"] > behind) & (b["at"] < F.col("edge"))), F.lit(0)))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("x")) for f in ("date", "narration", "reference", "debit", "credit", "balance")])
    return file.select("file", F.map_filter(F.map_from_entries(fields), lambda f, x: x.isNotNull()).alias("columns"))
