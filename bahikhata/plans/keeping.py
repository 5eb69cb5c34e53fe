"""The registered queries over what a store keeps: edits and undos, whole import runs, versions, journals, limits on a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bahikhata.operators import catalog, edits, journal, legacy, payments
from bahikhata.operators.stages import fresh_path
from bahikhata.plans.queries import money, query, table
from bahikhata.plans.stores import RATE
from bahikhata.streaming import limits


@query("""WITH e AS (SELECT user_id % 5 + 1 AS client_id, event_id AS ord, event_id % 997 AS txn, event_type IN ('click', 'error') AS undo, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'V' || event_id END AS vendor, 'H' || event_id % 10 AS head, CASE WHEN event_id % 4 > 0 THEN event_id % 10 / 10.0 END AS conf FROM events),
s AS (SELECT *, sum(CASE WHEN undo THEN -1 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY ord) AS s FROM e), h AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY client_id ORDER BY ord)) AS h FROM s),
l AS (SELECT *, min(h) OVER (PARTITION BY client_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM h), k AS (SELECT * FROM l WHERE NOT undo AND coalesce(later, h) >= h)
SELECT t.client_id, t.txn, coalesce(arg_max(vendor, ord) FILTER (vendor <> ''), '') AS vendor, coalesce(arg_max(head, ord), 'Suspense') AS account_head, CAST(coalesce(arg_max(conf, ord) FILTER (conf IS NOT NULL), 0) AS DOUBLE) AS confidence, CASE WHEN t.touched THEN 'user' ELSE '' END AS classification_source
FROM (SELECT client_id, txn, bool_or(NOT undo) AS touched FROM e GROUP BY 1, 2) t LEFT JOIN k USING (client_id, txn) GROUP BY t.client_id, t.txn, t.touched""")
def undo_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits, some of them undos, of a client's stack"""
    n = F.col("event_id")
    undo = F.col("event_type").isin("click", "error")
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 5 + 1).alias("client_id"), n.alias("ord"), (n % 997).alias("txn"), undo.alias("undo"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("V"), n.cast("string"))).alias("vendor"),
                                                  F.concat(F.lit("H"), (n % 10).cast("string")).alias("account_head"), F.lit("Payment").alias("txn_type"), F.lit("Manual").alias("status"), F.when(n % 4 > 0, (n % 10) / 10.0).alias("confidence"))
    rows = events.select("client_id", "txn").distinct().withColumns({"vendor": F.lit(""), "account_head": F.lit("Suspense"), "txn_type": F.lit("Unknown"), "status": F.lit("Unreviewed"), "confidence": F.lit(0.0), "classification_source": F.lit("")})
    return edits.applied(rows, events, ["client_id"], "txn", "ord").select("client_id", "txn", "vendor", "account_head", "confidence", "classification_source")


def _old(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The test tables as an older program's data."""
    c, o, p = F.col("c_custkey"), F.col("o_orderkey"), F.col("p_partkey")
    name = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    customers, orders, parts = (table(spark, sf_dir, t) for t in ("customer", "orders", "part"))
    owner = F.when(o % 10 == 0, "global").when(o % 11 == 0, "x").otherwise(name("c", F.col("o_custkey")))
    return {
        "clients": customers.select(name("c", c).alias("legacy_client"), name("Client ", c % 1000).alias("name"), F.lit("").alias("gstin")),
        "rules": orders.select(owner.alias("legacy_client"), F.concat(F.when(o % 2 == 0, "p").otherwise("P"), (o % 7).cast("string")).alias("pattern"), F.lit("V").alias("vendor"), F.lit("H").alias("account_head"), F.lit("Payment").alias("txn_type")),
        "ledgers": parts.select(name("c", p % 100).alias("legacy_client"), name("L", p % 13).alias("name"), F.lit("G").alias("group")),
        "hashes": orders.select(name("c", F.col("o_custkey")).alias("legacy_client"), F.hex(o % 500).alias("hash")),
        "imports": customers.select(name("i", c).alias("legacy_import"), name("c", c).alias("legacy_client"), name("f", c % 3).alias("file_name"), (c % 2).alias("txn_count"), F.lit("").alias("imported_at")),
        "transactions": orders.select(name("i", F.col("o_custkey")).alias("legacy_import"), F.when(o % 5 == 0, "").otherwise(name("t", o % 100)).alias("id"), F.to_date("o_orderdate").alias("date"), name("n", o).alias("narration"), money(F.col("o_totalprice")).alias("debit"), F.lit(None).cast("decimal(18,2)").alias("credit"),
                                      F.lit("manual").alias("status"), F.lit("Sales").alias("txn_type"), F.when(o % 3 == 0, "B").otherwise("").alias("bank_name"), F.lit("").alias("account_no")),
        "settings": table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")),
    }


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 1000 AS client FROM customer), o AS (SELECT o_orderkey AS o, o_custkey AS k, client FROM orders LEFT JOIN c ON o_custkey = k),
r AS (SELECT 'clients' AS entity, count(*) AS found, count(DISTINCT client) AS imported, 0 AS failed, 0 AS unsupported FROM c
UNION ALL SELECT 'rules', count(*), count(DISTINCT CASE WHEN o % 10 > 0 AND o % 11 > 0 AND client IS NOT NULL THEN client || '/' || o % 7 END), count_if(o % 10 > 0 AND (o % 11 = 0 OR client IS NULL)), count_if(o % 10 = 0) FROM o
UNION ALL SELECT 'ledgers', count(*), count(DISTINCT CASE WHEN client IS NOT NULL THEN client || '/' || p_partkey % 13 END), count_if(client IS NULL), 0 FROM part LEFT JOIN c ON p_partkey % 100 = k
UNION ALL SELECT 'hashes', count(*), count(DISTINCT CASE WHEN client IS NOT NULL THEN client || '/' || o % 500 END), count_if(client IS NULL), 0 FROM o
UNION ALL SELECT 'imports', count(*), count(DISTINCT client || '/' || k % 3 || '/' || k % 2), 0, 0 FROM c
UNION ALL SELECT 'transactions', count(*), count(DISTINCT client || '/' || CASE WHEN o % 5 = 0 THEN 'n' || o ELSE 't' || o % 100 END), 0, 0 FROM o WHERE client IS NOT NULL
UNION ALL SELECT 'settings', count(*), count(DISTINCT n_name), 0, 0 FROM nation)
SELECT run, entity, found, CASE WHEN run = 1 THEN imported ELSE 0 END AS imported, CAST(found - CASE WHEN run = 1 THEN imported ELSE 0 END - failed - unsupported AS BIGINT) AS skipped, CAST(failed AS BIGINT) AS failed, CAST(unsupported AS BIGINT) AS unsupported FROM r, (VALUES (1), (2)) t(run)""")
def legacy_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same data brought in twice; the second run finds all of it there"""
    root, old = fresh_path(spark, "store"), _old(spark, sf_dir)
    return reduce(DataFrame.unionByName, [legacy.imported(spark, root, old).withColumn("run", F.lit(i)) for i in (1, 2)])


#: The versions of the query's table: a flag that older ones lack, a column for tax, and one row a client and id.
STEPS: list[catalog.Step] = [
    (1, {"transactions": lambda df: df.withColumn("dup_flag", F.lit(False))}),
    (3, {"transactions": lambda df: df.withColumn("gst_rate", F.when(F.col("amount") > 100_000, 18.0)), "rules": lambda df: df.withColumn("priority", F.lit(0))}),
    (5, {"transactions": lambda df: df.groupBy("client_id", "id").agg(F.max(F.struct("amount", "dup_flag", "gst_rate")).alias("z")).select("client_id", "id", "z.*")}),
]


@query("""SELECT o_custkey % 10 AS client_id, 't' || o_orderkey % 1000 AS id, max(CAST(o_totalprice AS DECIMAL(18,2))) AS amount, false AS dup_flag, CASE WHEN max(CAST(o_totalprice AS DECIMAL(18,2))) > 100000 THEN 18.0::DOUBLE END AS gst_rate, 5 AS version FROM orders GROUP BY 1, 2""")
def schema_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store without versions moved up, and again"""
    root = fresh_path(spark, "versions")
    key = F.col("o_orderkey")
    catalog.commit(spark, root, {"transactions": table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("client_id"), F.concat(F.lit("t"), (key % 1000).cast("string")).alias("id"), money(F.col("o_totalprice")).alias("amount"))})
    for _ in range(2):
        catalog.upgraded(spark, root, STEPS, baseline=2, marks=("transactions", "dup_flag"))
    now = catalog.manifest(spark, root)
    return catalog.table(spark, root, "transactions", now).withColumn("version", F.lit(now["schema"]))


@query("""SELECT o_custkey % 7 AS client_id, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey % 3 DESC, o_orderkey DESC) AS place, 'Edit ' || o_orderkey AS event FROM orders QUALIFY place <= 500""")
def audit_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events in three batches, one of them sent twice; the list shows a client's last 500"""
    path = fresh_path(spark, "audit")
    key = F.col("o_orderkey")
    for batch in (0, 1, 2, 1):
        journal.appended(table(spark, sf_dir, "orders").where(key % 3 == batch).select((F.col("o_custkey") % 7).alias("client_id"), key.alias("n"), F.concat(F.lit("Edit "), key.cast("string")).alias("event")), path, batch)
    return journal.shown(spark, path).select("client_id", F.col("place").cast("long").alias("place"), "event")


@query("""SELECT c_custkey % 11 AS client_id, '{"version":1,"rules":[' || string_agg('{"pattern":"P' || c_custkey || '","vendor":"' || c_name || '","account_head":"","txn_type":"Payment"}', ',' ORDER BY c_custkey % 3, 'P' || c_custkey) || ']}' AS text FROM customer GROUP BY 1""")
def rules_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rules"""
    c = F.col("c_custkey")
    rules = table(spark, sf_dir, "customer").select((c % 11).alias("client_id"), (c % 3).alias("priority"), F.concat(F.lit("P"), c.cast("string")).alias("pattern"), F.col("c_name").alias("vendor"), F.lit("").alias("account_head"), F.lit("Payment").alias("txn_type"))
    return journal.rule_documents(rules)


@query(RATE)
def rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 as a stream in three batches"""
    root = fresh_path(spark, "rate")
    at = (F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800).cast("double")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("at")).withColumn("time", F.timestamp_seconds("at"))
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    cuts = [low, low + (high - low) / 3, low + 2 * (high - low) / 3, high + 1]
    for a, b in zip(cuts, cuts[1:]):
        rows.where((F.col("at") >= a) & (F.col("at") < b)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    limited = limits.limited_stream(stream, "user_id", "at", "event_id", "time", payments.LOGIN_PER_MINUTE)
    limited.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "user_id", "at", "allowed")
