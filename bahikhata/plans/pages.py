"""The registered queries over statement pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bahikhata.operators import repairs
from bahikhata.plans.queries import money, query, table
from bahikhata.sources import fixed, pages

_COLUMNS = (("Date", 10.0), ("Narration", 100.0), ("Chq/Ref No.", 280.0), ("Withdrawal Amt.", 360.0), ("Deposit Amt.", 440.0), ("Closing Balance", 520.0))
_PLACE = {"date": 10.0, "narration": 100.0, "reference": 280.0, "debit": 360.0, "credit": 440.0, "balance": 520.0}


def _order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty files of pages: each order stands in one of eight ways (plain, broken date, waiting for its amount, behind a type code, two lines, balance below, between totals, marked Cr)."""
    orders = table(spark, sf_dir, "orders")
    key, way = F.col("o_orderkey"), F.col("o_orderkey") % 8
    file = (F.col("o_custkey") % 40).cast("string").alias("file")
    day, price = F.add_months("o_orderdate", 120), money(F.col("o_totalprice")).cast("string")
    date, said = F.date_format(day, "dd/MM/yyyy"), F.concat(F.lit("Order "), key.cast("string"))
    done = F.col("o_orderstatus") == "F"
    balance = (key + F.lit(0.25)).cast("decimal(18,2)").cast("string")

    def line(n: int, when: Column, **cells: Column) -> Column:
        items = [F.struct(F.lit(float(n * 10)).alias("y"), F.lit(_PLACE[f]).alias("x"), c.alias("text")) for f, c in cells.items()]
        return F.when(when, F.array(*items)).otherwise(F.array().cast("array<struct<y:double,x:double,text:string>>"))

    amounts = {"debit": F.when(~done, price), "credit": F.when(done, price)}
    top = [
        line(0, way == 3, narration=F.lit("UPI")),
        line(1, ~way.isin(1, 2, 5, 7), date=date, narration=said, reference=F.concat(F.lit("R"), key.cast("string")), balance=balance, **amounts),
        line(1, way == 1, date=F.date_format(day, "d MMM"), narration=said, balance=balance, **amounts),
        line(2, way == 1, date=F.date_format(day, "yyyy"), narration=F.lit("AND MORE")),
        line(1, way == 2, date=date, narration=said, reference=F.lit("WAITED"), balance=balance),
        line(2, way == 2, date=date, **amounts),
        line(1, way == 5, date=date, narration=said, **amounts),
        line(2, way == 5, balance=balance),
        line(1, way == 7, date=date, narration=said, debit=F.concat(price, F.lit(" Cr")), balance=balance),
        line(2, way == 4, narration=F.lit("SECOND LINE")),
        line(2, way == 6, narration=F.lit("Grand Total"), debit=price, credit=price),
        line(3, way == 6, narration=F.lit("Page 2 of 9")),
    ]
    each = orders.select(file, F.floor(key / 2000).cast("int").alias("page"), ((key % 2000) * 100).alias("at"), F.explode(F.concat(*top)).alias("i")).where("i.text is not null")
    rows = each.select("file", "page", (F.col("at") + F.col("i.y")).alias("y"), "i.x", F.lit(10.0).alias("w"), "i.text")
    head = [("Statement of account", 10.0, 0.0), ("Opening Balance", 10.0, 10.0), ("1,000.50", 520.0, 10.0)] + [(t, x, 20.0) for t, x in _COLUMNS]
    foot = [("Closing Balance", 100.0, 0.0), ("77.75", 520.0, 0.0), ("Summary of TDS", 10.0, 10.0), ("01/01/2024", 10.0, 20.0), ("AFTER THE END", 100.0, 20.0), ("5.00", 360.0, 20.0)]
    ends = F.array(*[F.struct(F.lit(page).alias("page"), F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(t).alias("text")) for page, part in ((-1, head), (2_000_000_000, foot)) for t, x, y in part])
    rest = orders.select(file).distinct().select("file", F.explode(ends).alias("i")).select("file", "i.page", "i.y", "i.x", F.lit(10.0).alias("w"), "i.text")
    return rows.unionByName(rest)


@query("""WITH o AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS file, o_orderkey AS k, o_orderkey % 8 AS way, CAST(o_orderdate + INTERVAL 120 MONTH AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderstatus = 'F' AS done FROM orders)
SELECT file, date, CASE way WHEN 3 THEN 'UPI Order ' || k WHEN 1 THEN 'Order ' || k || ' AND MORE' WHEN 4 THEN 'Order ' || k || ' SECOND LINE' ELSE 'Order ' || k END AS narration, CASE WHEN way = 2 THEN 'WAITED' WHEN way IN (1, 5, 7) THEN '' ELSE 'R' || k END AS reference,
 CASE WHEN NOT done AND way <> 7 THEN price END AS debit, CASE WHEN done OR way = 7 THEN price END AS credit, CAST(k + 0.25 AS DECIMAL(18,2)) AS balance FROM o""")
def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 (with S7 to S9)"""
    return pages.page_transactions(_order_items(spark, sf_dir))[0].drop("row")


@query("SELECT DISTINCT CAST(o_custkey % 40 AS VARCHAR) AS file, CAST(1000.5 AS DECIMAL(18,2)) AS opening, CAST(77.75 AS DECIMAL(18,2)) AS closing FROM orders")
def statement_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages state beside their transactions"""
    return pages.page_transactions(_order_items(spark, sf_dir))[1]


#: Forty accounts of orders with a true running balance.
_RUN = """WITH o AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS file, o_orderkey AS k, CAST(o_orderdate + INTERVAL 120 MONTH AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderstatus = 'F' AS done FROM orders),
r AS (SELECT *, CAST(1000000000 + sum(CASE WHEN done THEN price ELSE -price END) OVER (PARTITION BY file ORDER BY k) AS DECIMAL(18,2)) AS balance FROM o)"""


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, done = money(F.col("o_totalprice")), F.col("o_orderstatus") == "F"
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).cast("string").alias("file"), F.col("o_orderkey").alias("k"), F.add_months("o_orderdate", 120).alias("date"), price.alias("price"), done.alias("done"))
    net = F.sum(F.when(F.col("done"), F.col("price")).otherwise(-F.col("price"))).over(Window.partitionBy("file").orderBy("k"))
    return rows.withColumn("balance", money(net + 1_000_000_000))


@query(_RUN + """ SELECT file, date, CASE WHEN CAST(file AS INT) % 2 = 1 AND k % 3 = 0 THEN 'NEFT/' || lpad(CAST(k AS VARCHAR), 12, '7') || '/ORDER' ELSE 'ORDER ' || k END AS narration, CASE WHEN CAST(file AS INT) % 2 = 0 AND k % 5 = 0 THEN '777777777' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0')
 WHEN CAST(file AS INT) % 2 = 1 AND k % 3 = 0 THEN lpad(CAST(k AS VARCHAR), 12, '7') ELSE '' END AS reference, CASE WHEN NOT done THEN price END AS debit, CASE WHEN done THEN price END AS credit, balance FROM r""")
def fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as pages of lines; even ones with two columns of amounts, odd ones with one, whose side only the balance tells"""
    rows, key = _run(spark, sf_dir), F.col("k")
    two, price, day = F.col("file").cast("int") % 2 == 0, F.col("price").cast("string"), F.date_format("date", "dd-MM-yyyy")
    said = F.when(~two & (key % 3 == 0), F.concat(F.lit("NEFT/"), F.lpad(key.cast("string"), 12, "7"), F.lit("/ORDER"))).otherwise(F.concat(F.lit("ORDER "), key.cast("string")))
    number = F.when(two & (key % 5 == 0), F.concat(F.lit("777777777"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(".00"))).otherwise("")
    out = F.when(~two | ~F.col("done"), price).otherwise("")
    into = F.when(two & F.col("done"), price).otherwise("")
    line = F.concat(day, F.lit("  "), F.rpad(said, 28, " "), F.rpad(number, 18, " "), F.lpad(out, 14, " "), F.lpad(into, 16, " "), F.lpad(F.col("balance").cast("string"), 18, " "), F.when(key % 2 == 0, "Cr").otherwise("CR"))
    lines = rows.select("file", F.floor(key / 50).cast("int").alias("page"), (key % 50 * 12).cast("double").alias("y"), line.alias("text"))
    heads = [F.lit("Statement of account"), F.lit("-" * 60), F.when(two, F.concat(F.rpad(F.lit("Date        Narration"), 58, " "), F.lit("  Withdrawal      Deposit            Balance"))).otherwise("Date  Particulars   Txn Amount  Balance"), F.lit("01-01-2005  Opening Balance   1,000,000,000.00Cr")]
    top = rows.select("file").distinct().select("file", F.posexplode(F.array(*heads)).alias("i", "text")).select("file", F.lit(-1).alias("page"), (F.col("i") * 12).cast("double").alias("y"), "text")
    return fixed.transactions(pages.placed(lines.unionByName(top).withColumns({"x": F.lit(10.0), "w": F.lit(500.0)})))[0].drop("row")


@query(_RUN + " SELECT file, k AS row, CASE WHEN NOT done THEN price END AS debit, CASE WHEN done THEN price END AS credit, balance, CASE WHEN k % 9 = 0 THEN 'amount' WHEN k % 23 = 0 THEN 'balance' ELSE '' END AS repaired FROM r")
def misread_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One amount of nine with another digit before the point, one balance of 23 with 600,000 too much"""
    rows, key = _run(spark, sf_dir), F.col("k")
    price = F.col("price").cast("string")
    at = F.length(price) - 3
    digit = F.substring(price, at, F.lit(1)).cast("int")
    wrong = F.concat(F.left(price, at - 1), ((digit + 1 + key % 8) % 10).cast("string"), F.right(price, F.lit(3))).cast("decimal(18,2)")
    read = F.when(key % 9 == 0, wrong).otherwise(F.col("price"))
    seen = rows.select("file", key.alias("row"), F.when(~F.col("done"), read).alias("debit"), F.when(F.col("done"), read).alias("credit"), F.when((key % 23 == 0) & (key % 9 > 0), F.col("balance") + 600_000).otherwise(F.col("balance")).alias("balance"))
    openings = rows.select("file").distinct().withColumn("opening", F.lit(1_000_000_000).cast("decimal(18,2)"))
    return repairs.repaired(seen, openings)
