"""The registered queries over the driver's tables, each with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bahikhata.functions import amounts, dates, recognised, text
from bahikhata.operators import analytics, balances, banks, classify, duplicates, export, filters, groups, gst, migrated, narrations, recon, service, store
from bahikhata.plans import sql
from bahikhata.plans.sql import TXN
from bahikhata.sources import positions, statements
from bahikhata.sources.driver_tables import money, transactions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
BANK = "Bank A/c"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as imported: nothing classified yet."""
    return transactions(spark, sf_dir).withColumns({"vendor": F.lit(""), "account_head": F.lit(""), "txn_type": F.lit("Unknown"), "confidence": F.lit(0.0), "classification_source": F.lit(""), "tags": F.array().cast("array<string>"), "dup_flag": F.lit(False)})


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with the keyword ladder's vendor, head and type; rails without a party."""
    rows = raw(spark, sf_dir).withColumn("up", F.upper(text.combined(F.col("narration"), F.col("reference"))))
    credit = F.col("credit").isNotNull()
    rows = classify.with_keyword(rows, F.col("up"), F.lit(""), credit, BANK)
    return rows.withColumns({"vendor": F.coalesce("_kw.vendor", F.lit("")), "account_head": F.coalesce("_kw.head", F.lit("")), "txn_type": F.coalesce("_kw.txn_type", F.when(credit, "Receipt").otherwise("Payment"))}).drop("_kw", "_rung", "up")


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.with_group(worded(spark, sf_dir), from_ladder=True)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS credits, CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS debits FROM orders GROUP BY 1")
def monthly_credit_debit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 over orders: finished ones as credits."""
    price, done = money(F.col("o_totalprice")), F.col("o_orderstatus") == "F"
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), F.when(done, price).alias("credit"), F.when(~done, price).alias("debit"))
    return analytics.monthly(rows)


@query(f"""{TXN} SELECT CAST(sum(coalesce(credit, 0)) AS DOUBLE) AS total_credit, CAST(sum(coalesce(debit, 0)) AS DOUBLE) AS total_debit, CAST(sum(coalesce(credit, 0) - coalesce(debit, 0)) AS DOUBLE) AS net_flow, CAST(arg_max(balance, ord) FILTER (balance IS NOT NULL) AS DOUBLE) AS closing_balance,
 count(*) AS txn_count, CAST(0 AS BIGINT) AS vendor_count, count(*) FILTER (status = 'Suspense') AS suspense_count, CAST(sum(coalesce(debit, credit)) FILTER (status = 'Suspense') AS DOUBLE) AS suspense_amount, count(*) FILTER ({sql.REVIEW}) AS review_count, CAST(0 AS BIGINT) AS duplicate_count, CAST(0 AS BIGINT) AS gst_count FROM txn""")
def dash_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1"""
    return analytics.summary(raw(spark, sf_dir))


@query(f"""{sql.HEADED}, x AS (SELECT ledger_group AS label, sum(debit) AS amount FROM h WHERE debit IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT label, CAST(amount AS DOUBLE) AS amount, CAST(round(CAST(amount AS DOUBLE) / CAST(sum(amount) OVER () AS DOUBLE) * 100) AS BIGINT) AS pct FROM x""")
def top_expense_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, F9"""
    label = F.coalesce(groups.party_group(F.col("account_head"), F.col("vendor"), F.col("txn_type") == "Receipt"), F.col("ledger_group"))
    return analytics.top_heads(grouped(spark, sf_dir), label)


@query(f"""{sql.HEADED} SELECT vendor, CAST(sum(coalesce(debit, 0)) AS DOUBLE) AS debit, CAST(sum(coalesce(credit, 0)) AS DOUBLE) AS credit FROM h WHERE vendor <> '' GROUP BY 1 ORDER BY sum(coalesce(debit, 0) + coalesce(credit, 0)) DESC, 1 LIMIT 10""")
def top_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5"""
    return analytics.top_vendors(worded(spark, sf_dir))


@query(f"""{TXN}, b AS (SELECT account, ord, balance, row_number() OVER (PARTITION BY account ORDER BY ord) - 1 AS n, count(*) OVER (PARTITION BY account) AS c FROM txn WHERE balance IS NOT NULL), s AS (SELECT * FROM b WHERE n % greatest(c // 150, 1) = 0)
 SELECT account, ord, round(CAST(balance - min(balance) OVER w AS DOUBLE) / greatest(CAST(max(balance) OVER w - min(balance) OVER w AS DOUBLE), 1.0), 6) AS norm FROM s WINDOW w AS (PARTITION BY account)""")
def cashflow_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, by account"""
    return analytics.cashflow(raw(spark, sf_dir))


@query(f"""{TXN} SELECT CAST(max(debit) AS DOUBLE) AS max_dr, arg_max(left(narration, 45), struct_pack(a := debit, o := ord)) FILTER (debit > 0) AS max_dr_narration, count(*) FILTER (debit > 0) AS dr_count, round(CAST(sum(debit) AS DOUBLE) / count(*) FILTER (debit > 0), 2) AS avg_dr,
 CAST(max(credit) AS DOUBLE) AS max_cr, arg_max(left(narration, 45), struct_pack(a := credit, o := ord)) FILTER (credit > 0) AS max_cr_narration, count(*) FILTER (credit > 0) AS cr_count, round(CAST(sum(credit) AS DOUBLE) / count(*) FILTER (credit > 0), 2) AS avg_cr FROM txn""")
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6"""
    return analytics.insights(raw(spark, sf_dir))


@query(f"{TXN} SELECT CASE WHEN count(DISTINCT bank_name) = 1 THEN max(bank_name) ELSE 'Multiple Banks' END AS bank, CASE WHEN count(DISTINCT account_no) = 1 THEN max(account_no) ELSE 'Multiple Accounts' END AS account, min(date) AS period_from, max(date) AS period_to FROM txn")
def dashboard_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7"""
    return analytics.meta(raw(spark, sf_dir))


@query(f"{sql.HEADED} SELECT DISTINCT 'bank' AS kind, bank_name AS value FROM h UNION SELECT 'vendor', vendor FROM h WHERE vendor <> '' UNION SELECT 'head', account_head FROM h WHERE account_head <> ''")
def unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8"""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("bank", "bank_name"), ("vendor", "vendor"), ("head", "account_head"))])
    return worded(spark, sf_dir).select(F.explode(pairs).alias("p")).select("p.*").where("value <> ''").distinct()


@query(f"""{TXN} SELECT count(*) AS "all", count(*) FILTER (status = 'Unreviewed') AS unreviewed, count(*) FILTER (status = 'Suspense') AS suspense, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS gst, count(*) FILTER ({sql.REVIEW}) AS needs_review, count(*) FILTER (credit IS NOT NULL) AS credits, count(*) FILTER (debit IS NOT NULL) AS debits FROM txn""")
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, F4"""
    names = ("unreviewed", "suspense", "duplicates", "gst", "needs_review", "credits", "debits")
    return raw(spark, sf_dir).agg(F.count("*").alias("all"), *[analytics.count_if(filters.status_token(n)).alias(n) for n in names])


@query(f"""{sql.HEADED} SELECT CASE WHEN account_head <> '' THEN 'MEDIUM' ELSE 'LOW' END AS tier, CASE WHEN account_head <> '' THEN 'Matched a built-in keyword pattern' WHEN status = 'Manual' THEN 'Manually added transaction' WHEN status = 'Suspense' THEN 'Marked as suspense' ELSE 'Not yet classified — no matching rule or keyword found' END AS basis, count(*) AS n FROM h GROUP BY 1, 2""")
def confidence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, F7, F8"""
    known = F.col("account_head") != ""
    rows = worded(spark, sf_dir).withColumn("confidence", F.when(known, classify.KEYWORD).otherwise(0.0)).withColumn("classification_source", F.when(known, "keyword").otherwise(""))
    return rows.groupBy(filters.confidence_tier().alias("tier"), filters.classification_basis().alias("basis")).agg(F.count("*").alias("n"))


@query(f"{sql.HEADED} SELECT vendor, count(*) AS n FROM h WHERE vendor <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def recurring_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10"""
    return worded(spark, sf_dir).where("vendor <> ''").groupBy("vendor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "vendor").limit(6)


@query(f"{sql.ACCOUNTS} SELECT * FROM a")
def per_account_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A11"""
    return analytics.per_account(balances.previous_balance(raw(spark, sf_dir)))


@query(f"{sql.ACCOUNTS} SELECT account, round(opening + credits - debits) AS calc_closing, abs(closing - round(opening + credits - debits)) >= 0.5 AS mismatch FROM a")
def statement_recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15"""
    return analytics.statement_check(analytics.per_account(balances.previous_balance(raw(spark, sf_dir))))


@query(f"""{sql.HEADED}, x AS (SELECT *, CASE WHEN (txn_type = 'Receipt' OR contains(lower(account_head), 'income')) AND credit IS NOT NULL THEN 'receipt' WHEN (txn_type = 'Payment' OR contains(lower(account_head), 'expense')) AND debit IS NOT NULL THEN 'payment' END AS side FROM h)
 SELECT side, {sql.POSTING} AS ledger, CAST(sum(coalesce(credit, debit)) AS DOUBLE) AS amount, count(*) AS n FROM x WHERE side IS NOT NULL GROUP BY 1, 2""")
def receipt_payment_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, K4"""
    return export.heads(worded(spark, sf_dir))


_TALLY = "CASE WHEN txn_type = 'Unknown' THEN CASE WHEN contains(upper(narration), 'ATM') OR contains(upper(narration), 'CASH WDL') OR contains(upper(narration), 'CASH DEP') THEN 'Contra' WHEN credit IS NOT NULL THEN 'Receipt' ELSE 'Payment' END ELSE txn_type END"


@query(f"""{TXN}, x AS (SELECT *, 'Unknown' AS txn_type FROM txn) SELECT {_TALLY} AS voucher, count(*) AS n, CAST(sum(coalesce(debit, credit)) AS DOUBLE) AS amount FROM x GROUP BY 1""")
def tally_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, F14"""
    return export.preview(raw(spark, sf_dir))


@query(f"""{sql.HEADED} SELECT client_id, count(*) FILTER (coalesce(debit, credit) IS NULL) AS no_amount, count(*) FILTER (date IS NULL) AS no_date, count(*) FILTER (account_head = '' AND vendor = '') AS no_ledger, count(*) FILTER (status = 'Suspense') AS suspense, count(*) FILTER (status = 'Unreviewed') AS unreviewed, count(*) FILTER (trim(narration) = '') AS no_narration FROM h GROUP BY 1""")
def export_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14"""
    c = analytics.count_if
    return worded(spark, sf_dir).groupBy("client_id").agg(
        c(F.coalesce("debit", "credit").isNull()).alias("no_amount"), c(F.col("date").isNull()).alias("no_date"), c((F.col("account_head") == "") & (F.col("vendor") == "")).alias("no_ledger"),
        c(F.col("status") == "Suspense").alias("suspense"), c(F.col("status") == "Unreviewed").alias("unreviewed"), c(F.trim("narration") == "").alias("no_narration"))


@query(f"{TXN} SELECT ord, bank_name, date FROM txn WHERE bank_name = 'HDFC Bank' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def dash_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2"""
    return filters.dash_filter(raw(spark, sf_dir), bank="HDFC Bank", date_from="2024-01-05", date_to="2024-01-20").select("ord", "bank_name", "date")


@query(f"{TXN} SELECT ord, status FROM txn WHERE (status = 'Suspense' OR {sql.REVIEW}) AND date >= DATE '2024-01-10'")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4"""
    return filters.main_filter(raw(spark, sf_dir), ["suspense", "needs_review"], date_from="2024-01-10").select("ord", "status")


@query(f"{TXN} SELECT ord, {sql.REASONS} AS reasons, {sql.REVIEW} AS review FROM txn")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, F6"""
    return raw(spark, sf_dir).select("ord", filters.reasons().alias("reasons"), filters.needs_review().alias("review"))


@query(f"{TXN} SELECT ord FROM txn WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' AND status NOT IN ('Unreviewed', 'Suspense')")
def export_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, F11"""
    return filters.export_rows(raw(spark, sf_dir), "2024-01-03", "2024-01-25", dateless=False, only_classified=True, skip_dups=True).select("ord")


@query("SELECT o_orderkey, CAST(year(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH) AS BIGINT) AS fiscal_year, strftime(o_orderdate, '%Y%m%d') AS tally FROM orders")
def fiscal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15, D3"""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.fiscal_year(day).alias("fiscal_year"), dates.tally_date(day).alias("tally"))


@query(f"{TXN} SELECT ord, {sql.HASH} AS hash FROM txn")
def txn_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1"""
    return raw(spark, sf_dir).select("ord", text.txn_hash(F.col("date_raw"), F.col("narration"), F.col("debit"), F.col("credit")).alias("hash"))


AMOUNTS = (("1,23,456.78", 123456.78), ("₹ 500", 500.0), ("Rs. 1,000.5", 1000.5), ("(250.00)", -250.0), ("(-)75", -75.0), ("100 Cr", 100.0), ("99.50Dr", 99.5), ("nil", None), ("N/A", None), ("-", None), ("0.00", None), ("1234567890123", None),
           ("12.345", None), ("5000*", 5000.0), ("77ab", 77.0), ("", None), ("abc", None), ("+12", 12.0), ("3,00,00,00,000.00", None), ("-45.10", -45.1))


def _case(cases: tuple, n: Column) -> Column:
    return F.get(F.array(*[F.lit(a) for a, _ in cases]), (n % len(cases)).cast("int"))


@query("WITH v(i, raw, amount) AS (VALUES " + ", ".join(f"({i}, {sql.text(a)}, CAST({'NULL' if b is None else b} AS DOUBLE))" for i, (a, b) in enumerate(AMOUNTS)) + f") SELECT p_partkey, raw, amount FROM part JOIN v ON p_partkey % {len(AMOUNTS)} = i")
def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, each with one of the known cases"""
    rows = table(spark, sf_dir, "part").select("p_partkey", _case(AMOUNTS, F.col("p_partkey")).alias("raw"))
    return rows.withColumn("amount", amounts.parse_amount(F.col("raw")).cast("double"))


DATES = (("05/01/2024", "2024-01-05"), ("5-1-24", "2024-01-05"), ("05 Jan 2024", "2024-01-05"), ("05JAN2024", "2024-01-05"), ("2024-01-05", "2024-01-05"), ("20240105", "2024-01-05"), ("31/02/2024", None), ("05/01/1999", None), ("O5/O1/2O24", "2024-01-05"),
         ("05/01/2024 10:30:00", "2024-01-05"), ("", None), ("soon", None), ("29/02/2024", "2024-02-29"), ("29/02/2023", None), ("1 December 2023", "2023-12-01"), ("2100-01-01", None))


@query("WITH v(i, raw, date) AS (VALUES " + ", ".join(f"({i}, {sql.text(a)}, CAST({'NULL' if b is None else sql.text(b)} AS DATE))" for i, (a, b) in enumerate(DATES)) + f") SELECT p_partkey, raw, date FROM part JOIN v ON p_partkey % {len(DATES)} = i")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, each with one of the known cases"""
    rows = table(spark, sf_dir, "part").select("p_partkey", _case(DATES, F.col("p_partkey")).alias("raw"))
    return rows.withColumn("date", dates.parse_date(F.col("raw")))


@query("""WITH m AS (SELECT o_orderkey, CAST(o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS DECIMAL(18,2)) AS a, split_part(CAST(abs(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR), '.', 1) AS r, split_part(CAST(abs(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR), '.', 2) AS p FROM orders)
 SELECT o_orderkey, CASE WHEN a < 0 THEN '-' ELSE '' END || CASE WHEN length(r) > 3 THEN reverse(regexp_replace(reverse(left(r, length(r) - 3)), '([0-9]{2})([0-9])', '\\1,\\2')) || ',' || right(r, 3) ELSE r END || '.' || p AS inr FROM m""")
def inr_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2"""
    sign = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.format_indian(money(F.col("o_totalprice") * sign)).alias("inr"))


@query(f"{TXN} SELECT ord, {sql._NOISE} AS noise FROM txn")
def noise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2"""
    return raw(spark, sf_dir).select("ord", text.is_noise_row(F.col("narration")).alias("noise"))


@query(f"{TXN} SELECT ord, {sql._PAYMENT} AS payment_type, {sql._REF} AS payment_ref FROM txn")
def payment_type_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9, X10"""
    return raw(spark, sf_dir).select("ord", text.payment_type(F.col("narration")).alias("payment_type"), text.payment_ref(F.col("narration")).alias("payment_ref"))


@query(f"{TXN} SELECT ord, 'XXXX' || right(regexp_replace(account_no, '[^A-Za-z0-9]', '', 'g'), 4) AS masked FROM txn")
def mask_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X20"""
    return raw(spark, sf_dir).select("ord", text.mask_account(F.col("account_no")).alias("masked"))


@query(f"""{TXN}, x AS (SELECT ord, left(upper(trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN reference = '' THEN narration ELSE narration || ' ' || reference END, {sql.text(sql.GLUED_REFERENCE)}, ' ', 'g'), '[0-9]{{6,}}', ' ', 'g'), '\\s+', ' ', 'g'))), 40) AS p FROM txn)
 SELECT ord, CASE WHEN p <> '' AND p NOT IN ({', '.join(map(sql.text, text.RAILS))}) THEN p END AS pattern FROM x""")
def learned_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4, C7"""
    return raw(spark, sf_dir).select("ord", text.rule_pattern(text.combined(F.col("narration"), F.col("reference"))).alias("pattern"))


@query(f"{sql.PREV} SELECT ord, CAST(prev_balance AS DOUBLE) AS prev_balance, CAST(opening AS DOUBLE) AS opening FROM p")
def prev_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1"""
    return balances.previous_balance(raw(spark, sf_dir)).select("ord", F.col("prev_balance").cast("double").alias("prev_balance"), F.col("opening").cast("double").alias("opening"))


@query(f"""{TXN}, x AS (SELECT *, balance - last_value(balance IGNORE NULLS) OVER (PARTITION BY account ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS moved FROM txn),
 y AS (SELECT *, coalesce(credit IS NULL AND abs(moved - debit) < greatest(1, debit * 0.02), false) AS c, coalesce(debit IS NULL AND abs(moved + credit) < greatest(1, credit * 0.02), false) AS d FROM x)
 SELECT ord, CAST(CASE WHEN c THEN NULL WHEN d THEN credit ELSE debit END AS DOUBLE) AS debit, CAST(CASE WHEN d THEN NULL WHEN c THEN debit ELSE credit END AS DOUBLE) AS credit, c OR d AS swapped FROM y""")
def direction_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2"""
    return balances.directed(raw(spark, sf_dir)).select("ord", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"), "swapped")


@query(f"""{TXN}, x AS (SELECT *, last_value(balance IGNORE NULLS) OVER (PARTITION BY account ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM txn)
 SELECT ord, CASE WHEN balance IS NOT NULL THEN coalesce(abs(prev + coalesce(credit, 0) - coalesce(debit, 0) - balance) <= 1, true) END AS balance_ok FROM x""")
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3"""
    return balances.validated(raw(spark, sf_dir)).select("ord", "balance_ok")


@query(f"{TXN}, f AS (SELECT account, arg_min(balance - (coalesce(credit, 0) - coalesce(debit, 0)), ord) AS b, arg_min(balance IS NULL, ord) AS n FROM txn GROUP BY 1) SELECT account, CAST(b AS DOUBLE) AS balance FROM f WHERE NOT n")
def opening_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5"""
    return balances.opening_rows(raw(spark, sf_dir)).select("account", F.col("balance").cast("double").alias("balance"))


@query(f"""{TXN}, r AS (SELECT ord, account, CAST(NULL AS DATE) AS date, left(narration, 4) AS narration, round(debit, -2) AS debit, round(credit, -2) AS credit, CASE WHEN ord % 5 = 0 THEN ord % 4 END AS balance FROM txn)
 SELECT ord, account FROM r QUALIFY row_number() OVER (PARTITION BY account, date, narration, debit, credit, balance ORDER BY ord) = 1""")
def dedup_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 on rows without dates, with coarse amounts and mostly without balances"""
    rows = raw(spark, sf_dir).withColumns({"date": F.lit(None).cast("date"), "narration": F.left("narration", F.lit(4)), "debit": F.round("debit", -2), "credit": F.round("credit", -2), "balance": F.when(F.col("ord") % 5 == 0, F.col("ord") % 4)})
    return duplicates.first_of_each(rows).select("ord", "account")


@query("SELECT o_orderkey, CAST(CAST(o_totalprice * CASE WHEN o_orderkey % 6 = 3 THEN -1 ELSE 1 END AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM orders")
def amounts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order totals in Indian format, in six kinds of dress, read back"""
    n, price = F.col("o_orderkey") % 6, F.col("o_totalprice").cast("decimal(18,2)")
    plain = amounts.format_indian(price)
    dressed = (F.when(n == 0, plain).when(n == 1, F.concat(F.lit("₹ "), plain)).when(n == 2, F.concat(plain, F.lit(" Cr"))).when(n == 3, F.concat(F.lit("("), plain, F.lit(")")))
               .when(n == 4, F.concat(F.lit("Rs. "), plain, F.lit("*"))).otherwise(F.concat(F.lit("  "), plain, F.lit(" Dr."))))
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.parse_amount(dressed).cast("double").alias("amount"))


@query("SELECT event_id, CASE WHEN event_id % 8 < 7 THEN CAST(ts AS DATE) END AS date FROM events")
def dates_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of all events, in seven spellings and one that is no date, read back"""
    n, ts = F.col("event_id") % 8, F.col("ts")
    shown = [F.date_format(ts, f) for f in ("dd/MM/yyyy", "d-M-yy", "dd MMM yyyy", "yyyy-MM-dd", "yyyyMMdd", "dd/MM/yyyy HH:mm:ss")]
    spelled = F.coalesce(*[F.when(n == i, x) for i, x in enumerate(shown)], F.when(n == 6, F.translate(shown[0], "015", "OIS")), F.concat(F.lit("on "), shown[2]))
    return table(spark, sf_dir, "events").select("event_id", dates.parse_date(spelled).alias("date"))


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with repeats: few amounts, no references in the narration."""
    n = F.col("ord")
    rows = raw(spark, sf_dir).withColumn("narration", F.element_at(F.array(*[F.lit(x) for x in COARSE]), (n % len(COARSE) + 1).cast("int")))
    amount = ((F.col("ord") % 9 + 1) * 100).cast("decimal(18,2)")
    return rows.withColumn("debit", F.when(F.col("debit").isNotNull(), amount)).withColumn("credit", F.when(F.col("credit").isNotNull(), amount)).withColumn("reference", F.when(n % 4 == 0, F.concat(F.lit("REF"), F.lpad((n % 40).cast("string"), 5, "0"))).otherwise(""))


COARSE = ("SHARMA TRADERS PAYMENT APRIL", "SHARMA TRADERS PAYMENT MARCH", "MEHTA SONS SALARY", "MEHTA BROTHERS SALARY ADVANCE", "RAVI KUMAR RENT", "A B")
_COARSE = f"""{TXN}, d0 AS (SELECT account, ord, date, date_raw, status, [{', '.join(map(sql.text, COARSE))}][ord % {len(COARSE)} + 1] AS narration, CASE WHEN debit IS NOT NULL THEN CAST((ord % 9 + 1) * 100 AS DECIMAL(18,2)) END AS debit, CASE WHEN credit IS NOT NULL THEN CAST((ord % 9 + 1) * 100 AS DECIMAL(18,2)) END AS credit,
 CASE WHEN ord % 4 = 0 THEN 'REF' || lpad(CAST(ord % 40 AS VARCHAR), 5, '0') ELSE '' END AS reference FROM txn),
 d1 AS (SELECT *, status <> 'Manual' AND row_number() OVER (PARTITION BY account, date_raw, narration, debit, credit, status <> 'Manual' ORDER BY ord) > 1 AS dup_hash FROM d0),
 d2 AS (SELECT *, status <> 'Manual' AND NOT dup_hash AND length(regexp_replace(reference, '[^0-9]', '', 'g')) >= 4 AS asks FROM d1),
 d3 AS (SELECT *, asks AND row_number() OVER (PARTITION BY account, reference, coalesce(debit, credit), asks ORDER BY ord) > 1 AS dup_ref FROM d2)"""


@query(f"{_COARSE} SELECT ord, dup_hash, dup_ref FROM d3")
def dup_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, C6"""
    return duplicates.flagged(coarse(spark, sf_dir)).select("ord", "dup_hash", "dup_ref")


@query(f"""{_COARSE.replace('WITH ', 'WITH RECURSIVE ', 1)}, w AS (SELECT ord, account, date, coalesce(debit, credit) AS amount, debit IS NOT NULL AS out, list_distinct(list_filter(regexp_split_to_array(upper(narration), '[^A-Z0-9]+'), lambda t: strlen(t) >= 4)) AS w FROM d3 WHERE NOT dup_hash AND NOT dup_ref AND status <> 'Manual' AND coalesce(debit, credit) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY account, date, amount, out ORDER BY ord) AS k FROM w),
c AS (SELECT account, date, amount, out, k, ord, false AS dup_like, [w] AS held FROM o WHERE k = 1 UNION ALL SELECT account, date, amount, out, k, ord, hit, CASE WHEN hit THEN held ELSE list_append(held, w) END
 FROM (SELECT o.*, c.held, len(list_filter(c.held, lambda h: len(h) > 0 AND len(o.w) > 0 AND len(list_intersect(h, o.w)) / greatest(len(h), len(o.w), 1) >= 0.5)) > 0 AS hit FROM c JOIN o ON o.account = c.account AND o.date = c.date AND o.amount = c.amount AND o.out = c.out AND o.k = c.k + 1))
SELECT d3.ord, dup_hash, dup_ref, coalesce(c.dup_like, false) AS dup_like FROM d3 LEFT JOIN c USING (ord)""")
def dup_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row is held against the earlier ones of its bucket that aren't like one themselves"""
    return duplicates.like_narrations(coarse(spark, sf_dir)).select("ord", "dup_hash", "dup_ref", "dup_like")


@query(f"{TXN}, x AS (SELECT client_id, ord, {sql.HASH} AS hash FROM txn) SELECT ord, hash FROM x WHERE (client_id, hash) NOT IN (SELECT client_id, hash FROM x WHERE ord % 3 = 0)")
def known_hash_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, Z12"""
    rows = raw(spark, sf_dir).withColumn("hash", text.txn_hash(F.col("date_raw"), F.col("narration"), F.col("debit"), F.col("credit")))
    return store.new_by_hash(rows, rows.where("ord % 3 = 0").select("client_id", "hash")).select("ord", "hash")


RULES = ((1, 0, "AMAZON", "Amazon", "Office Expense", "Payment", 1), (2, 1, "sharma", "Sharma Traders", "Purchases", "Payment", 5), (3, 0, "SHARMA", "Sharma & Co", "", "", 9), (4, 2, "uber", "Uber", "Conveyance", "", 0), (5, 0, "uber", "", "Travel", "Payment", 0),
         (6, 3, "DIVIDEND", "", "", "Receipt", 2), (7, 0, "", "Nobody", "Nothing", "Payment", 99), (8, 4, "SWIFT", "Export House", "Sales", "Receipt", 1))
_RULES = "(VALUES " + ", ".join(f"({i}, {c}, {sql.text(p)}, {sql.text(v)}, {sql.text(h)}, {sql.text(t)}, {n})" for i, c, p, v, h, t, n in RULES) + ") r(id, client, pattern, r_vendor, r_head, r_type, priority)"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "id long, client_id long, pattern string, vendor string, account_head string, txn_type string, priority int")


@query(f"{TXN} SELECT ord, CAST(r.id AS BIGINT) AS rule_id FROM txn JOIN {_RULES} ON r.pattern <> '' AND r.client IN (0, client_id) AND contains({sql.UP}, upper(r.pattern)) QUALIFY row_number() OVER (PARTITION BY ord ORDER BY priority DESC, r.id) = 1")
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5"""
    rows = classify.first_rule(raw(spark, sf_dir), rules(spark), F.upper(text.combined(F.col("narration"), F.col("reference"))))
    return rows.where("rule is not null").select("ord", F.col("rule.id").alias("rule_id"))


@query(f"{sql.KEYWORDS} SELECT ord, kw_head AS head, kw_type AS txn_type, kw_vendor AS vendor FROM kw WHERE kw_head IS NOT NULL")
def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3, J6"""
    rows = raw(spark, sf_dir).withColumn("up", F.upper(text.combined(F.col("narration"), F.col("reference"))))
    hit = classify.with_keyword(rows, F.col("up"), F.lit(""), F.col("credit").isNotNull(), BANK).where(F.col("_rung") < len(classify.LADDER))
    return hit.select("ord", F.col("_kw.head").alias("head"), F.col("_kw.txn_type").alias("txn_type"), F.col("_kw.vendor").alias("vendor"))


@query(f"""{sql.KEYWORDS} SELECT ord, CASE WHEN regexp_matches(up, '\\bATM\\b|CASH\\s*(DEP|WDL|WITHDRAWAL)|\\bSELF\\s*TRANSFER\\b') THEN 'Contra' WHEN credit IS NOT NULL THEN 'Receipt' ELSE 'Payment' END AS voucher,
 CASE WHEN contains(up, 'IGST') OR contains(up, 'CGST') OR contains(up, 'SGST') THEN 'GST' WHEN contains(up, 'GST') AND {sql.any_of('up', ('PAY', 'PMT', 'REFUND', 'CHALLAN'))} THEN 'GST' WHEN regexp_matches(up, '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z0-9]{{4}}.') THEN 'GST' WHEN {sql.any_of('up', ('INCOME TAX', 'ADVANCE TAX', 'TDS PMT', 'TRACES', 'CHALLAN 28'))} THEN 'TAX' END AS tag FROM kw""")
def vouchers_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4, G1"""
    up = F.upper(text.combined(F.col("narration"), F.col("reference")))
    return raw(spark, sf_dir).select("ord", classify.voucher_type(up, F.col("debit"), F.col("credit")).alias("voucher"), classify.tax_tag(up).alias("tag"))


@query()
def classify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested row by row."""
    return classify.classified(raw(spark, sf_dir), rules(spark), BANK).select("ord", "vendor", "account_head", "txn_type", "confidence", "status", "classification_source", "tag", "changed")


@query(sql.GST)
def gst_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2"""
    rows = gst.analysed(raw(spark, sf_dir)).where("gst is not null")
    return rows.select("ord", "gst.gst_rate", "gst.gst_type", "gst.gst_amount", F.size("gst.gstins").cast("long").alias("n_gstins"), "gst.expense_ledger", "gst.suggested_ledger", "gst.confidence")


@query(f"{sql.HEADED} SELECT ord, account_head, ledger_group FROM h")
def tally_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T2"""
    return grouped(spark, sf_dir).select("ord", "account_head", "ledger_group")


@query("SELECT c_custkey, list_aggregate(list_sort(list_filter(string_split_regex(upper(c_name || ' ' || c_mktsegment), '[^A-Z0-9]+'), lambda t: t <> '')), 'string_agg', '|') AS signature FROM customer")
def party_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X22"""
    return table(spark, sf_dir, "customer").select("c_custkey", text.signature(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("signature"))


@query()
def party_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested on known narrations."""
    return classify.with_party(raw(spark, sf_dir), text.combined(F.col("narration"), F.col("reference"))).select("ord", "narration", "party")


def bank_and_vouchers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bank rows are transactions; every third one has a voucher a few days and paise off."""
    rows = raw(spark, sf_dir).withColumn("amount", F.coalesce("debit", "credit"))
    bank = rows.select("account", F.col("ord").alias("b"), "date", "amount", "narration", "reference")
    off = (F.col("ord") % 5).cast("int")
    vouchers = rows.where("ord % 3 = 0").select("account", (F.col("ord") + 1_000_000).alias("v"), F.date_add("date", off - 2).alias("date"), (F.col("amount") + (F.col("ord") % 4).cast("decimal(18,2)") / 100).cast("decimal(18,2)").alias("amount"), "narration", F.lpad(F.col("ord").cast("string"), 12, "0").alias("voucher_no"))
    return bank, vouchers


_NEAR = "abs(b.amount - v.amount) * 10000 <= greatest(b.amount, v.amount)"
_WORDS = "list_distinct(list_filter(string_split_regex(upper({0}), '[^A-Z0-9]+'), lambda t: strlen(t) >= 4))"
_CANDIDATES = f"""{TXN}, b AS (SELECT account, ord AS b, date, coalesce(debit, credit) AS amount, reference, {_WORDS.format('narration')} AS w FROM txn),
 v AS (SELECT account, ord + 1000000 AS v, date + CAST(ord % 5 - 2 AS INT) AS date, CAST(coalesce(debit, credit) + CAST(ord % 4 AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS amount, lpad(CAST(ord AS VARCHAR), 12, '0') AS voucher_no, {_WORDS.format('narration')} AS w FROM txn WHERE ord % 3 = 0),
 p AS (SELECT b, v, b.amount = v.amount AS same, {_NEAR} * 50 AS near, abs(b.date - v.date) AS days, len(b.w) AS nb, len(v.w) AS nv, len(list_intersect(b.w, v.w)) AS both_, reference <> '' AND reference = voucher_no AS ref FROM b JOIN v USING (account) WHERE abs(b.date - v.date) <= 6 AND {_NEAR} * 100),
 q AS (SELECT *, CASE WHEN nb > 0 AND nv > 0 THEN CAST(both_ AS DOUBLE) / (nb + nv - both_) ELSE 0 END AS lik FROM p)
 SELECT b, v, round(least((CASE WHEN same THEN 0.40::DOUBLE WHEN near THEN 0.30::DOUBLE ELSE 0.10::DOUBLE END) + (CASE WHEN days = 0 THEN 0.40::DOUBLE WHEN days <= 1 THEN 0.30::DOUBLE WHEN days <= 3 THEN 0.20::DOUBLE ELSE 0.05::DOUBLE END) + (CASE WHEN lik >= 0.80 THEN 0.20::DOUBLE WHEN lik >= 0.55 THEN lik * 0.15::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN ref THEN 0.20::DOUBLE ELSE 0::DOUBLE END), 1.0::DOUBLE), 2) AS score FROM q"""


@query(_CANDIDATES)
def recon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, R1, X8"""
    return recon.candidates(*bank_and_vouchers(spark, sf_dir))


@query()
def recon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice is sequential; tested against a loop."""
    return recon.report(*bank_and_vouchers(spark, sf_dir))


@query(f"""{sql.HEADED}, x AS (SELECT client_id, ord, date, 'BSP-' || lpad(CAST(row_number() OVER (PARTITION BY client_id ORDER BY ord) AS VARCHAR), 5, '0') AS journal_no, CAST(coalesce(debit, credit, 0) AS DOUBLE) AS amount, txn_type = 'Receipt' AS rc, {sql.POSTING} AS post FROM h)
 SELECT client_id, ord, date, journal_no, CAST(1 AS BIGINT) AS leg, 'Bank A/c' AS ledger, 'Bank' AS account_type, CASE WHEN rc THEN amount ELSE 0 END AS dr, CASE WHEN rc THEN 0 ELSE amount END AS cr FROM x UNION ALL SELECT client_id, ord, date, journal_no, 2, post, 'Expense', CASE WHEN rc THEN 0 ELSE amount END, CASE WHEN rc THEN amount ELSE 0 END FROM x""")
def journal_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7, K8, K9"""
    return export.journal_legs(worded(spark, sf_dir), BANK, source=raw(spark, sf_dir))


@query(f"""{TXN}, x AS (SELECT *, 'Unknown' AS txn_type FROM txn), y AS (SELECT *, {_TALLY} AS voucher, 'Unclassified' AS post FROM x)
 SELECT client_id, ord, voucher, {sql.voucher('narration')} AS xml FROM y""")
def voucher_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, X21"""
    return export.voucher_xml(raw(spark, sf_dir), BANK)


@query(f"""{sql.HEADED} SELECT client_id, ord, concat_ws(',', strftime(date, '%Y-%m-%d'), txn_type, CASE WHEN credit IS NOT NULL THEN 'Bank A/c' ELSE {sql.POSTING} END, CASE WHEN credit IS NOT NULL THEN {sql.POSTING} ELSE 'Bank A/c' END, printf('%.2f', CAST(coalesce(debit, credit, 0) AS DOUBLE)), narration) AS line FROM h""")
def generic_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10"""
    return export.csv_lines(worded(spark, sf_dir))


@query(f"{sql.HEADED} SELECT client_id, {sql.POSTING} AS ledger, arg_min(ledger_group, ord) AS parent, count(*) AS n FROM h GROUP BY 1, 2")
def ledger_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, Z4"""
    return export.ledger_masters(grouped(spark, sf_dir))


@query(f"""{TXN}, n AS (SELECT client_id, id, 'new ' || max(ord) AS narration FROM (SELECT * FROM txn WHERE ord % 5 = 0 UNION ALL SELECT client_id, ord + 10000000, 't_' || (ord + 10000000), account, date, date_raw, narration, reference, debit, credit, bank_name, account_no, status, balance FROM txn WHERE ord % 50 = 1) GROUP BY 1, 2)
 SELECT client_id, id, narration FROM n UNION ALL SELECT client_id, id, narration FROM txn WHERE ord % 5 <> 0""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2"""
    rows = raw(spark, sf_dir)
    now = F.concat(F.lit("new "), F.col("ord").cast("string"))
    late = rows.where("ord % 50 = 1").withColumn("ord", F.col("ord") + 10_000_000).withColumn("id", F.concat(F.lit("t_"), F.col("ord").cast("string")))
    new = rows.where("ord % 5 = 0").unionByName(late).withColumn("narration", now)
    return store.upserted(rows, new, ["client_id", "id"], "ord").select("client_id", "id", "narration")


@query("SELECT min(event_id) AS id, user_id % 5 AS client_id, upper(event_type || user_id % 30) AS pattern FROM events GROUP BY 2, 3")
def rule_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, K3"""
    kind = F.concat("event_type", (F.col("user_id") % 30).cast("string"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("client_id"), kind.alias("pattern"))
    return store.rules_once(rows).select("id", "client_id", F.upper("pattern").alias("pattern"))


@query(f"{TXN} SELECT ord, CASE WHEN ord % 10 = 0 THEN 'edit' || (ord % 7) ELSE status END AS status FROM txn")
def latest_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z13"""
    rows = raw(spark, sf_dir).select("ord", "status")
    edit = rows.where("ord % 10 = 0").withColumn("at", F.explode(F.array(F.lit(1), F.lit(2))))
    edits = edit.select("ord", "at", F.when(F.col("at") == 2, F.concat(F.lit("edit"), (F.col("ord") % 7).cast("string"))).otherwise("old").alias("status"))
    return store.latest_edits(rows, edits, "ord", "at")


@query("SELECT o_orderkey, c_custkey, n_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_name ILIKE '%1%' AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def admin_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, P4, Z15"""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.where(F.ilike("c_name", F.lit("%1%")) & (F.col("o_orderstatus") == "O"))
    return service.page(rows, [F.desc("o_orderdate"), "o_orderkey"], number=2).select("o_orderkey", "c_custkey", "n_name", "o_orderstatus")


@query("SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def latest_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10"""
    last = service.latest(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return table(spark, sf_dir, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH l AS (SELECT o_orderkey AS payment_id, CASE WHEN o_orderkey % 3 > 0 THEN 'pay_' || o_orderkey END AS provider_ref, 'ord_' || o_orderkey AS order_ref, CASE o_orderkey % 4 WHEN 0 THEN 'paid' ELSE 'created' END AS status FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-04'),
 r AS (SELECT 'pay_' || o_orderkey AS remote_ref, 'ord_' || o_orderkey AS remote_order, ['captured', 'failed', 'authorized', 'refunded'][o_orderkey % 4 + 1] AS remote_status FROM orders WHERE o_orderkey % 5 > 0)
 SELECT payment_id, status, CASE remote_status WHEN 'captured' THEN 'paid' WHEN 'failed' THEN 'failed' WHEN 'refunded' THEN 'refunded' END AS healed_status FROM l JOIN r ON provider_ref = remote_ref OR (provider_ref IS NULL AND order_ref = remote_order) WHERE remote_status <> 'authorized' AND healed_status <> status AND payment_id IN (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) = 1)""")
def payment_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1"""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    ref, order = F.concat(F.lit("pay_"), key.cast("string")), F.concat(F.lit("ord_"), key.cast("string"))
    local = orders.select(key.alias("payment_id"), F.when(key % 3 > 0, ref).alias("provider_ref"), order.alias("order_ref"), F.when(key % 4 == 0, "paid").otherwise("created").alias("status"), F.to_date("o_orderdate").alias("created"))
    said = F.element_at(F.array(*[F.lit(x) for x in ("captured", "failed", "authorized", "refunded")]), (key % 4 + 1).cast("int"))
    remote = orders.where(key % 5 > 0).select(ref.alias("remote_ref"), order.alias("remote_order"), said.alias("remote_status"))
    return service.healed(local, remote, 90, F.lit("2001-08-02").cast("date"))


@query("SELECT user_id * 1000 + event_id % 20 AS event_key, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def webhook_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2"""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") * 1000 + F.col("event_id") % 20).alias("event_key"), "event_type", "event_id")
    return service.once(rows, "event_key", "event_id").select("event_key", "event_type", "event_id")


@query("WITH x AS (SELECT event_id, user_id % 20 AS k, CAST(floor(epoch(ts) / 60) AS BIGINT) AS s FROM events) SELECT event_id, count(*) OVER (PARTITION BY k ORDER BY s RANGE BETWEEN 59 PRECEDING AND 1 PRECEDING) < 2 AS allowed FROM x")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, as a sliding count; the clock runs sixty times as slow (a minute of the events is its second), so that the limit is met"""
    second = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("k"), second.alias("s"))
    return service.rate_limited(rows, "k", "s", 2).select("event_id", "allowed")


@query(f"""WITH m AS ({ORACLE['monthly_credit_debit']}), a AS (SELECT *, max(greatest(credits, debits)) OVER () AS top, debits / sum(debits) OVER () * 360 AS sw FROM m), x AS (SELECT *, pow(10.0, floor(log10(top))) AS z FROM a), y AS (SELECT *, z * CASE WHEN top / z <= 1 THEN 1.0 WHEN top / z <= 2 THEN 2.0 WHEN top / z <= 5 THEN 5.0 ELSE 10.0 END AS axis_max FROM x)
 SELECT month, CAST(axis_max AS DOUBLE) AS axis_max, round(credits / axis_max, 6) AS credit_bar, round(debits / axis_max, 6) AS debit_bar, round(coalesce(sum(sw) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start_angle, round(sw, 4) AS sweep_angle FROM y""")
def chart_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N3, Z10"""
    return analytics.bars(monthly_credit_debit(spark, sf_dir))


def parts_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned text items made of parts: fifty files, a page for each hundred items, so that pages stay small in any table."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((key % 50).cast("string").alias("file"), (F.floor(key / 5000) + 1).alias("page"), F.col("p_name").alias("text"), (key * 37 % 500).cast("double").alias("x"), (key * 7 % 300).cast("double").alias("y"), F.lit(10.0).alias("w"))


@query("""WITH RECURSIVE i AS (SELECT CAST(p_partkey % 50 AS VARCHAR) AS file, p_partkey // 5000 + 1 AS page, p_name AS text, CAST(p_partkey * 37 % 500 AS DOUBLE) AS x, CAST(p_partkey * 7 % 300 AS DOUBLE) AS y FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY file, page ORDER BY y, x, text) AS k FROM i),
c AS (SELECT file, page, k, y AS anchor, 0 AS row FROM o WHERE k = 1 UNION ALL SELECT o.file, o.page, o.k, CASE WHEN o.y - c.anchor > 5 THEN o.y ELSE c.anchor END, c.row + CASE WHEN o.y - c.anchor > 5 THEN 1 ELSE 0 END FROM c JOIN o ON o.file = c.file AND o.page = c.page AND o.k = c.k + 1)
SELECT file, page, row, count(*) AS n, string_agg(text, ' ' ORDER BY x, text) AS text FROM c JOIN o USING (file, page, k) GROUP BY file, page, row""")
def row_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are anchored at their first item"""
    return statements.clustered(parts_as_items(spark, sf_dir)).select("file", "page", "row", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda i: i["text"]), " ").alias("text"))


@query("""SELECT CAST(p_partkey % 50 AS VARCHAR) AS file, p_partkey // 5000 + 1 AS page, CASE WHEN p_partkey * 37 % 500 < 120 THEN 'date' WHEN p_partkey * 37 % 500 < 380 THEN 'narration' ELSE 'balance' END AS field, string_agg(p_name, ' ' ORDER BY p_partkey * 37 % 500, p_name) AS cell FROM part GROUP BY 1, 2, 3""")
def col_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9"""
    items = parts_as_items(spark, sf_dir).withColumn("row", F.lit(0))
    fences = [(str(f), name, low, high) for f in range(50) for name, low, high in (("date", 0.0, 120.0), ("narration", 120.0, 380.0), ("balance", 380.0, 501.0))]
    bounds = spark.createDataFrame(fences, "file string, field string, x_min double, x_max double")
    return statements.assigned(items, bounds).select("file", "page", "field", "cell")


_HEADER = [(f, w) for f, ws in statements.HEADER_WORDS.items() for w in ws]


@query("WITH c AS (SELECT n_nationkey, pos, lower([n_name, 'Date', 'Narration ' || n_name, 'Withdrawal', 'Bal', 'Closing Balance INR'][pos]) AS v FROM nation, (SELECT unnest(range(1, 7)) AS pos)), w(field, word) AS (VALUES " + ", ".join(f"({sql.text(f)}, {sql.text(w)})" for f, w in _HEADER) + """),
 s AS (SELECT n_nationkey, pos, field, max(CASE WHEN v = word THEN 100 WHEN starts_with(v, word) THEN 60 WHEN ends_with(v, word) THEN 40 WHEN length(word) >= 4 AND contains(v, word) THEN 20 WHEN length(v) >= 4 AND starts_with(word, v) THEN 10 ELSE 0 END) AS score FROM c, w GROUP BY 1, 2, 3)
 SELECT CAST(n_nationkey AS VARCHAR) AS file, CAST(pos - 1 AS BIGINT) AS pos, field, CAST(score AS BIGINT) AS score FROM s WHERE score > 0""")
def header_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3"""
    name = F.col("n_name")
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("file"), F.lit(0).alias("row_idx"), F.array(name, F.lit("Date"), F.concat(F.lit("Narration "), name), F.lit("Withdrawal"), F.lit("Bal"), F.lit("Closing Balance INR")).alias("cells"))
    return statements.header_scores(cells).select("file", F.col("pos").cast("long").alias("pos"), "field", F.col("score").cast("long").alias("score"))


@query(sql.CLEANED)
def narration_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11, X12, X13, X15, Z14"""
    found = raw(spark, sf_dir).select("ord", F.explode(F.array(narrations.cleaned(F.col("narration")))).alias("c")).select("ord", "c.*")
    return found.withColumn("shown", narrations.shown_cleaned(preserve=False))


@query()
def party_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as parties, in five spellings"""
    part = table(spark, sf_dir, "part")
    name, other, n = F.upper("p_name"), F.upper("p_brand"), F.col("p_partkey") % 5
    words = F.split(name, " ")
    vendor = F.when(n == 0, name).when(n == 1, F.array_join(F.reverse(words), " ")).when(n == 2, F.concat(name, F.lit(" PVT LTD"))).when(n == 3, F.concat(name, F.lit(" - PUNE"))).otherwise(F.left(F.get(words, F.lit(1)), F.lit(5)))
    rows = part.select(F.col("p_partkey").alias("ord"), vendor.alias("vendor"), F.when(n == 1, "Office Expense").otherwise(F.concat(other, F.lit(" TRADERS"))).alias("account_head"))
    return narrations.with_canonical(rows)


@query(sql.RECOGNISED)
def ocr_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged narrations, two passes"""
    damaged = F.when(F.col("ord") % 2 == 0, F.translate("narration", "015", "OIS")).otherwise(F.replace(F.replace(F.col("narration"), F.lit("PAYMENT"), F.lit("PAYMFNT")), F.lit("CHARGES"), F.lit("CHRGFS")))
    once = raw(spark, sf_dir).select("ord", F.explode(F.array(recognised.corrected(damaged))).alias("line"))
    return once.select("ord", recognised.corrected(F.col("line")).alias("line"))


@query(f"""{TXN} SELECT ord, 'EDIT' AS found FROM txn WHERE regexp_matches(upper(narration), 'EDIT|RESET|SAVE|CLASSIFY') UNION ALL SELECT ord, 'BOTH' FROM txn WHERE regexp_matches(upper(narration), 'IMPORT|BATCH') AND regexp_matches(upper(narration), 'RULE') UNION ALL SELECT ord, 'AI' FROM txn WHERE status NOT IN ('Manual', 'Suspense')""")
def audit_and_ai_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F16, F18"""
    rows = filters.real_rows(raw(spark, sf_dir).withColumn("is_opening_balance", F.lit(False)))
    asked = {"EDIT": filters.audit_filter(F.col("narration"), "edit"), "BOTH": filters.audit_filter(F.col("narration"), "import", "rule"), "AI": filters.ai_eligible()}
    return rows.select("ord", F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in asked.items()]), lambda x: x.isNotNull())).alias("found"))


@query("""WITH d AS (SELECT o_orderkey AS ord, CAST(o_orderdate AS DATE) AS t FROM orders), y AS (SELECT *, CASE WHEN month(t) >= 4 THEN year(t) ELSE year(t) - 1 END AS fy FROM d)
SELECT ord, t AS today_first, t AS today_last, CAST(date_trunc('month', t) AS DATE) AS this_month_first, last_day(t) AS this_month_last, CAST(date_trunc('month', t) - INTERVAL 1 MONTH AS DATE) AS last_month_first, CAST(date_trunc('month', t) - INTERVAL 1 DAY AS DATE) AS last_month_last,
 make_date(fy, 4, 1) AS current_fy_first, make_date(fy + 1, 3, 31) AS current_fy_last, make_date(fy - 1, 4, 1) AS prev_fy_first, make_date(fy, 3, 31) AS prev_fy_last FROM y""")
def date_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15"""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.to_date("o_orderdate").alias("t"))
    return rows.select("ord", *[dates.preset(n, F.col("t"))[e].alias(f"{n}_{e}") for n in ("today", "this_month", "last_month", "current_fy", "prev_fy") for e in ("first", "last")])


@query(sql.BANKED)
def bank_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as statements, each with one kind of evidence"""
    n, code, name = F.col("c_custkey") % 9, F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.col("c_name")
    head = (F.when(n == 0, F.concat(F.lit("HDFC BANK LTD MG ROAD IFSC Code: HDFC0"), code, F.lit(" A/c No: 5010"), code)).when(n == 1, "Statement").when(n == 2, F.concat(F.lit("STATEMENT OF Kotak-Mahindra BANK for "), name))
            .when(n == 3, "AX1S STATEMENT").when(n == 7, "Central Bank of India, Bank of India Building").otherwise(F.concat(F.lit("Statement for "), name)))
    body = F.when(n == 1, "visit www.icicibank.com").when(n == 4, "NEFT/HDFCBANK/998877 paid. Federal Bank, Main road").otherwise("")
    seen = F.when(n == 6, F.array(F.concat(F.lit("NEFT YESB0"), code), F.concat(F.lit("IMPS SBIN0"), code), F.concat(F.lit("to yesb0"), code))).otherwise(F.array(F.lit("TEA")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", head.alias("header_text"), F.concat(head, F.lit(" "), body).alias("text"),
                                                   F.when(n == 5, F.concat(F.lit("Canara_Bank_"), code, F.lit(".pdf"))).otherwise("x.pdf").alias("filename"), seen.alias("narrations"))
    return banks.with_bank(rows).select("c_custkey", "bank_name", "confidence", "method", "needs_review", "account_no", "ifsc")


@query(sql.SIDED)
def chrono_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as files, every other one backwards, with a stray number on each third line"""
    n, amount = F.col("ord"), F.coalesce("debit", "credit")
    marked = lambda c: (n % 5 == 0) & F.col(c).isNotNull()
    lines = raw(spark, sf_dir).select("ord", F.col("account").cast("string").alias("file"), F.when(F.col("account") % 2 == 1, 100_000_000 - n).otherwise(n).alias("row_idx"), "date",
                                      F.when(n % 3 == 0, F.array(amount, money(F.lit(56161)))).otherwise(F.array(amount)).alias("amounts"), marked("debit").alias("dr"), marked("credit").alias("cr"), "balance")
    return balances.sided(lines).select("file", "ord", "debit", "credit")


@query(f"{sql.HEADED} SELECT ord, CASE WHEN account_head = '' AND vendor <> '' THEN CASE WHEN credit IS NOT NULL THEN 'SDr' ELSE 'SCr' END ELSE '' END AS party_group FROM (SELECT * REPLACE (CASE WHEN ord % 2 = 0 THEN '' ELSE account_head END AS account_head) FROM h)")
def party_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every other row without its head"""
    rows = worded(spark, sf_dir).withColumn("account_head", F.when(F.col("ord") % 2 == 0, "").otherwise(F.col("account_head")))
    return rows.select("ord", filters.party_group().alias("party_group"))


@query("""WITH p AS (SELECT c_custkey, 'C:/in/' || CASE WHEN c_custkey % 2 = 0 THEN upper('f' || c_custkey // 2) ELSE 'f' || c_custkey // 2 END || ['.PDF', '.xlsx', '.doc', '', '.tar.csv'][c_custkey // 2 % 5 + 1] AS path FROM customer)
SELECT c_custkey AS ord, regexp_replace(path, '^.*/', '') AS name, c_custkey // 2 % 5 IN (0, 1, 4) AS supported, row_number() OVER (PARTITION BY lower(path) ORDER BY c_custkey) > 1 AS duplicate FROM p""")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z11"""
    half = F.floor(F.col("c_custkey") / 2)
    name = F.concat(F.lit("f"), half.cast("string"))
    end = F.get(F.array(*[F.lit(x) for x in (".PDF", ".xlsx", ".doc", "", ".tar.csv")]), (half % 5).cast("int"))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("C:/in/"), F.when(F.col("c_custkey") % 2 == 0, F.upper(name)).otherwise(name), end).alias("path"))
    return migrated.batch_plan(files, ["pdf", "xlsx", "xls", "csv"]).select("ord", "name", "supported", "duplicate")


@query("""WITH o AS (SELECT o_orderkey AS ord, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'global' ELSE 'c' || o_custkey END AS lc, ['unreviewed', 'classified', 'manual', 'system'][o_orderkey % 4 + 1] AS st, ['Payment', 'Sales', 'Memo'][o_orderkey % 3 + 1] AS vt FROM orders)
SELECT ord, c_custkey AS client_id, CASE st WHEN 'classified' THEN 'Classified' WHEN 'manual' THEN 'Manual' ELSE 'Unreviewed' END AS status, CASE WHEN vt = 'Memo' THEN 'Unknown' ELSE vt END AS txn_type, CASE WHEN lc = 'global' THEN 'unsupported' WHEN c_custkey IS NULL THEN 'failed' ELSE 'imported' END AS outcome
FROM o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 7 > 0) ON lc = 'c' || c_custkey""")
def legacy_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, Z8"""
    key = F.col("o_orderkey")
    one = lambda words: F.get(F.array(*[F.lit(w) for w in words]), (key % len(words)).cast("int"))
    old = table(spark, sf_dir, "orders").select(key.alias("ord"), F.when(key % 10 == 0, "global").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("legacy_client"), F.lit("").alias("id"), F.to_date("o_orderdate").alias("date"),
                                                F.lit("x").alias("narration"), money(F.col("o_totalprice")).alias("debit"), F.lit(None).cast("decimal(18,2)").alias("credit"), one(("unreviewed", "classified", "manual", "system")).alias("status"), one(("Payment", "Sales", "Memo")).alias("txn_type"))
    ids = table(spark, sf_dir, "customer").where("c_custkey % 7 > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("legacy_client"), F.col("c_custkey").alias("client_id"))
    return migrated.transactions(old, ids).select("ord", "client_id", "status", "txn_type", "outcome")


@query(f"SELECT count(*) AS found, CAST(count_if(outcome = 'imported') AS BIGINT) AS imported, CAST(count_if(outcome = 'failed') AS BIGINT) AS failed, CAST(count_if(outcome = 'unsupported') AS BIGINT) AS unsupported FROM ({ORACLE['legacy_import']})")
def migration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19"""
    return migrated.counts(legacy_import(spark, sf_dir))


@query(sql.CONTENT)
def content_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files without a header"""
    price, done = money(F.col("o_totalprice")).cast("string"), F.col("o_orderstatus") == "F"
    file = F.col("o_custkey") % 20
    cells = [F.date_format(F.add_months("o_orderdate", 120), "dd/MM/yyyy"), F.concat(F.lit("Order "), "o_orderpriority"), F.when(done, price).otherwise(""), F.when(~done, price).otherwise("")]
    rows = table(spark, sf_dir, "orders").select(file.cast("string").alias("file"), F.col("o_orderkey").alias("row_idx"), F.when(file % 3 == 0, F.array(price, *cells)).otherwise(F.array(*cells, price)).alias("cells"))
    found = statements.content_columns(rows)
    return found.select("file", *[F.col(c).cast("long").alias(c) for c in ("date", "balance", "debit", "credit", "narration")])


@query("""SELECT CAST(o_custkey % 20 AS VARCHAR) AS file, o_orderkey AS row_idx, CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderpriority AS narration, 'V' || o_orderkey AS voucher_no, CASE WHEN o_orderstatus = 'F' THEN 'Receipt' ELSE 'Payment' END AS voucher_type FROM orders WHERE o_orderkey > 0 AND o_orderkey % 11 > 0""")
def tally_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as voucher grids, ten years on, some without a date"""
    done, price, key = F.col("o_orderstatus") == "F", money(F.col("o_totalprice")).cast("string"), F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").where("o_orderkey > 0")
    file = (F.col("o_custkey") % 20).cast("string").alias("file")
    head = orders.select(file).distinct().select("file", F.lit(0).cast("long").alias("row_idx"), F.array(*[F.lit(x) for x in ("Date", "Voucher No.", "Vch Type", "Particulars", "Debit", "Credit")]).alias("cells"))
    rows = orders.select(file, key.cast("long").alias("row_idx"), F.array(F.when(key % 11 > 0, F.date_format(F.add_months("o_orderdate", 120), "dd-MM-yyyy")).otherwise(""), F.concat(F.lit("V"), key.cast("string")), F.when(done, "Receipt").otherwise("Payment"), F.col("o_orderpriority"), F.when(done, "").otherwise(price), F.when(done, price).otherwise("")).alias("cells"))
    return statements.tally_vouchers(head.unionByName(rows))


@query("""WITH f AS (SELECT n_nationkey, i, (i * 60 + n_nationkey * i % 7)::DOUBLE AS x FROM nation, (SELECT unnest(range(0, 6)) AS i)), g AS (SELECT *, lag(x) OVER w AS l, lead(x) OVER w AS r FROM f WINDOW w AS (PARTITION BY n_nationkey ORDER BY x))
SELECT CAST(n_nationkey AS VARCHAR) AS file, ['date', 'narration', '', 'debit', 'credit', 'balance'][i + 1] AS field, coalesce(round((l + x) / 2), 0) AS x_min, round((x + r) / 2) AS x_max FROM g WHERE i <> 2""")
def col_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title row, then a header with a column of no field, for each nation; the open end is null here"""
    key = F.col("n_nationkey")
    words = F.array(*[F.lit(w) for w in ("Date", "Narration", "Branch", "Debit", "Credit", "Balance")])
    items = table(spark, sf_dir, "nation").select(key.cast("string").alias("file"), F.lit(1).alias("page"), key, F.posexplode(words).alias("i", "text"))
    x = (F.col("i") * 60 + key * F.col("i") % 7).cast("double")
    items = items.withColumns({"x": x, "w": F.lit(10.0), "row": F.lit(3)})
    title = items.where("i = 0").withColumns({"row": F.lit(1), "text": F.lit("Statement of account")})
    found = positions.bounds(positions.header_of(items.unionByName(title)))
    return found.withColumn("x_max", F.when(F.col("x_max") < 1e9, F.col("x_max")))


@query("""WITH p AS (SELECT CAST(p_partkey % 50 AS VARCHAR) AS file, p_partkey // 50 AS row, p_partkey AS k, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS a FROM part)
SELECT file, row, 'date' AS field, '05/01/2024' AS cell FROM p UNION ALL SELECT file, row, 'narration', 'PAID ' || k FROM p UNION ALL SELECT file, row, 'balance', a FROM p UNION ALL SELECT file, row, 'debit', CASE WHEN k % 2 = 0 THEN 'Rs. ' || a ELSE a END FROM p""")
def cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of parts whose cells hold several items"""
    key, amount = F.col("p_partkey"), money(F.col("p_retailprice")).cast("string")
    at = [(10.0, F.lit("Val")), (20.0, F.lit("05/01/2024")), (30.0, F.lit("06/01/2024")), (110.0, F.lit("PAID")), (130.0, key.cast("string")), (210.0, F.when(key % 2 == 0, "Rs.").otherwise("about")), (220.0, amount), (310.0, F.lit("12.50")), (320.0, amount)]
    items = table(spark, sf_dir, "part").select((key % 50).cast("string").alias("file"), F.lit(1).alias("page"), F.floor(key / 50).alias("row"), F.explode(F.array(*[F.struct(F.lit(x).alias("x"), t.alias("text")) for x, t in at])).alias("i"))
    fences = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("x_min"), F.lit(b).alias("x_max")) for f, a, b in (("date", 0.0, 100.0), ("narration", 100.0, 200.0), ("debit", 200.0, 300.0), ("balance", 300.0, float("inf")))])
    files = items.select("file").distinct().select("file", F.explode(fences).alias("b")).select("file", "b.*")
    return positions.cell_values(items.select("file", "page", "row", "i.x", "i.text"), files).select("file", "row", "field", "cell")
