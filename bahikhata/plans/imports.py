"""The registered queries over what an import adds to its rows: opening rows, duplicate tags, batches of files, export filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bahikhata.functions import text
from bahikhata.operators import balances, duplicates, filters, recon, store
from bahikhata.plans import sql
from bahikhata.plans.queries import _COARSE, bank_and_vouchers, coarse, query, raw
from bahikhata.plans.sql import TXN


def _opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir)
    stated = rows.select("account").distinct().where("account % 2 = 0").withColumn("opening", (F.col("account") + F.lit(0.5)).cast("decimal(18,2)"))
    return balances.with_opening(rows, stated)


_OPENED = f"""{TXN}, f AS (SELECT * FROM txn QUALIFY row_number() OVER (PARTITION BY account ORDER BY ord) = 1),
o AS (SELECT account, client_id, 'opening_balance_' || {sql.HASH} AS id, ord - 1 AS ord, 'Opening Balance' AS narration, CAST(NULL AS DATE) AS date, CASE WHEN balance IS NOT NULL THEN balance - coalesce(credit, 0) + coalesce(debit, 0) WHEN account % 2 = 0 THEN CAST(account + 0.5 AS DECIMAL(18,2)) END AS balance, true AS is_opening_balance, CAST(NULL AS VARCHAR) AS status FROM f),
u AS (SELECT * FROM o WHERE balance IS NOT NULL UNION ALL SELECT account, client_id, id, ord, narration, date, balance, false, status FROM txn)"""


@query(f"{_OPENED} SELECT account, client_id, id, ord, narration, CAST(balance AS DOUBLE) AS balance, is_opening_balance FROM u")
def opening_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account with its opening row"""
    return _opened(spark, sf_dir).select("account", "client_id", "id", "ord", "narration", F.col("balance").cast("double").alias("balance"), "is_opening_balance")


@query(f"""{_OPENED}, r AS (SELECT ord, status, CASE WHEN ord % 17 > 0 THEN date END AS date FROM u WHERE NOT is_opening_balance), k AS (SELECT 'tally' AS program UNION ALL SELECT 'others')
SELECT program, ord FROM r, k WHERE CASE WHEN date IS NULL THEN program = 'others' ELSE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' END AND status NOT IN ('Unreviewed', 'Suspense')""")
def export_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """opening rows left out, rows without a date only for programs that take them"""
    rows = filters.real_rows(_opened(spark, sf_dir).withColumn("date", F.when(F.col("ord") % 17 > 0, F.col("date"))))
    asked = {"tally": False, "others": True}
    parts = [filters.export_rows(rows, "2024-01-03", "2024-01-25", dateless=dateless, only_classified=True).select(F.lit(program).alias("program"), "ord") for program, dateless in asked.items()]
    return parts[0].unionByName(parts[1])


@query(f"{_COARSE} SELECT ord, dup_hash OR dup_ref OR ord % 13 = 0 AS dup_flag, CASE WHEN dup_hash OR dup_ref THEN CASE ord % 3 WHEN 0 THEN 'DUP' WHEN 1 THEN 'GST,DUP' ELSE 'DUP' END ELSE CASE ord % 3 WHEN 0 THEN '' WHEN 1 THEN 'GST' ELSE 'DUP' END END AS tags FROM d3")
def dup_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes 1 and 2 on rows of which some have tags already"""
    n = F.col("ord") % 3
    had = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("GST"))).otherwise(F.array(F.lit("DUP")))
    rows = duplicates.flagged(coarse(spark, sf_dir).withColumns({"tags": had, "dup_flag": F.col("ord") % 13 == 0}))
    return duplicates.tagged(rows).select("ord", "dup_flag", F.array_join("tags", ",").alias("tags"))


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = coarse(spark, sf_dir).withColumn("hash", text.txn_hash(F.col("date_raw"), F.col("narration"), F.col("debit"), F.col("credit")))
    n = F.col("ord")
    rows = rows.withColumns({"file_ord": n % 4, "is_opening_balance": n % 50 == 0, "bank_name": F.when(n % 4 == 0, "").otherwise(F.col("bank_name"))})
    return rows, rows.where("ord % 97 = 1").select("client_id", "hash")


_BATCH = f"""{_COARSE}, x AS (SELECT account % 5 + 1 AS client_id, account, ord, ord % 4 AS file_ord, ord % 50 = 0 AS opening, {sql.HASH} AS hash FROM d0),
k AS (SELECT DISTINCT client_id, hash FROM x WHERE ord % 97 = 1), m AS (SELECT x.*, opening OR (file_ord = min(file_ord) OVER (PARTITION BY x.client_id, x.hash) AND k.hash IS NULL) AS stays FROM x LEFT JOIN k USING (client_id, hash))"""


@query(f"{_BATCH} SELECT ord FROM m WHERE stays")
def batch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four files of transactions with repeats, after what is known"""
    return store.batch_merged(*_batch(spark, sf_dir)).select("ord")


@query(f"""{_BATCH}, b AS (SELECT client_id, arg_min(t.bank_name, file_ord * 100000000 + x.ord) AS bank_name FROM x JOIN (SELECT ord, bank_name FROM txn) t USING (ord) WHERE file_ord > 0 GROUP BY 1)
SELECT client_id, file_ord, count(*) AS found, count_if(stays) AS kept, count_if(NOT stays) AS skipped, bank_name FROM m JOIN b USING (client_id) WHERE NOT opening GROUP BY client_id, file_ord, bank_name""")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file added, and the bank of a client's first file that names one"""
    rows, known = _batch(spark, sf_dir)
    return store.batch_results(rows, store.batch_merged(rows, known))


@query()
def recon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a sequential choice, so tested against the rows it counts"""
    return recon.counts(recon.report(*bank_and_vouchers(spark, sf_dir)))
