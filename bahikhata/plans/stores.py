"""The registered queries of the licence service and of the store, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bahikhata.operators import clients, payments
from bahikhata.plans.queries import money, query, table
from bahikhata.sources import lines, positions

_EVENTS = ("payment.captured", "payment_link.paid", "payment.failed", "subscription.activated", "subscription.charged", "subscription.cancelled", "subscription.halted", "refund.created", "refund.processed", "payment.dispute.created", "payment.dispute.closed", "order.paid")
_STATES = ("pending", "succeeded", "failed", "refunded", "disputed")


def one_of(words: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), (n % len(words)).cast("int"))


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS sub, CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS cents, {_list(_EVENTS)}[o_orderkey % 12 + 1] AS e, {_list(_STATES)}[o_orderkey % 5 + 1] AS st, ['won', 'lost', 'open'][o_orderkey % 3 + 1] AS dis, CAST(o_orderdate AS DATE) AS began, o_orderkey % 13 > 0 AS named, o_orderkey % 23 = 0 AS wrong, o_orderkey % 19 = 0 AS foreign_ FROM orders),
s AS (SELECT c_custkey AS sub, ['trial', 'monthly', 'yearly', 'lifetime'][c_custkey % 4 + 1] AS plan, c_custkey % 3 > 0 AS lic FROM customer WHERE c_custkey % 11 > 0),
j AS (SELECT o.*, s.plan, s.sub IS NOT NULL AS has_sub, coalesce(s.lic, o.sub % 3 > 0 AND o.sub IN (SELECT c_custkey FROM customer)) AS lic, e IN ('refund.created', 'refund.processed', 'payment.dispute.created', 'payment.dispute.closed') AS by_g FROM o LEFT JOIN s USING (sub)),
m AS (SELECT *, CASE WHEN NOT by_g AND NOT named THEN 'none' WHEN e IN ('payment.captured', 'payment_link.paid', 'subscription.activated', 'subscription.charged') AND NOT wrong AND NOT foreign_ AND st NOT IN ('refunded', 'disputed') AND has_sub THEN 'activate' WHEN e = 'payment.failed' AND st = 'pending' THEN 'fail'
 WHEN e IN ('subscription.cancelled', 'subscription.halted') AND has_sub THEN 'end' WHEN e IN ('refund.created', 'refund.processed') THEN 'refund' WHEN e = 'payment.dispute.created' THEN 'dispute' WHEN e = 'payment.dispute.closed' AND dis <> 'open' THEN 'settle' ELSE 'none' END AS mutation FROM j),
l AS (SELECT *, CASE mutation WHEN 'activate' THEN 'active' WHEN 'end' THEN CASE WHEN e = 'subscription.halted' THEN 'suspended' ELSE 'revoked' END WHEN 'refund' THEN 'revoked' WHEN 'dispute' THEN 'suspended' WHEN 'settle' THEN CASE WHEN dis = 'won' THEN 'active' ELSE 'revoked' END END AS ls FROM m)
SELECT k AS event_key, mutation, CASE WHEN mutation <> 'none' THEN k END AS payment_id, CASE mutation WHEN 'activate' THEN 'succeeded' WHEN 'fail' THEN 'failed' WHEN 'refund' THEN 'refunded' WHEN 'dispute' THEN 'disputed' WHEN 'settle' THEN CASE WHEN dis = 'won' THEN 'succeeded' ELSE 'refunded' END END AS payment_status,
 CASE WHEN mutation IN ('activate', 'end') THEN sub END AS subscription_id, CASE mutation WHEN 'activate' THEN 'active' WHEN 'end' THEN CASE WHEN e = 'subscription.halted' THEN 'suspended' ELSE 'cancelled' END END AS subscription_status,
 CASE WHEN mutation = 'activate' THEN CASE plan WHEN 'trial' THEN began + 14 WHEN 'monthly' THEN began + 30 WHEN 'yearly' THEN began + 365 END WHEN mutation = 'end' THEN DATE '2024-06-30' END AS period_end,
 CASE WHEN mutation = 'activate' THEN CASE WHEN lic THEN 'extend' ELSE 'insert' END WHEN ls IS NOT NULL AND lic THEN 'set' END AS licence_change, CASE WHEN ls IS NOT NULL AND lic THEN sub * 2 END AS licence_id, CASE WHEN lic OR mutation = 'activate' THEN ls END AS licence_status FROM l""")
def webhook_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for each order; some without a reference, some of another amount or currency"""
    key, sub = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    cents = (money(F.col("o_totalprice")) * 100).cast("long")
    ref, gateway = F.concat(F.lit("pl_"), key.cast("string")), F.concat(F.lit("pay_"), key.cast("string"))
    events = orders.select(key.alias("event_key"), one_of(_EVENTS, key).alias("event"), F.to_date("o_orderdate").alias("at"), F.when(key % 13 > 0, ref).alias("provider_ref"), gateway.alias("gateway_payment_id"), F.when(key % 23 == 0, cents + 1).when(key % 2 == 0, cents).alias("amount_minor"),
                           F.when(key % 19 == 0, "USD").when(key % 3 == 0, "INR").alias("currency"), one_of(("won", "lost", "open"), key).alias("dispute"))
    paid = orders.select(key.alias("payment_id"), ref.alias("provider_ref"), gateway.alias("gateway_payment_id"), cents.alias("amount_minor"), F.lit("INR").alias("currency"), one_of(_STATES, key).alias("status"), sub.alias("subscription_id"))
    c = F.col("c_custkey")
    known = table(spark, sf_dir, "customer")
    subscriptions = known.where(c % 11 > 0).select(c.alias("subscription_id"), one_of(tuple(payments.PLANS), c).alias("plan"), F.lit("2024-06-30").cast("date").alias("period_end"))
    licences = known.where(c % 3 > 0).select(F.explode(F.array(c * 2 - 1, c * 2)).alias("licence_id"), c.alias("subscription_id"))
    return payments.resolved(events, paid, subscriptions, licences)


#: Five requests at once, then one each twelve seconds; request after request of a user.
RATE = """WITH RECURSIVE e AS (SELECT event_id, user_id, floor(epoch(ts)) / 1800 AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
c AS (SELECT user_id, k, true AS allowed, t + 12 AS free FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, c.free - e.t <= 48 + 1e-9, CASE WHEN c.free - e.t <= 48 + 1e-9 THEN greatest(c.free, e.t) + 12 ELSE c.free END FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)
SELECT event_id, user_id, t AS "at", allowed FROM c JOIN e USING (user_id, k)"""


@query(RATE)
def rate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock runs 1,800 times as slow, so that the limit is met"""
    at = (F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800).cast("double")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("at"))
    return payments.limited(rows, "user_id", "at", "event_id", payments.LOGIN_PER_MINUTE).select("event_id", "user_id", "at", "allowed")


@query("""SELECT o_orderkey AS licence_id, CASE WHEN o_orderkey % 6 = 0 THEN 'active' WHEN o_orderkey % 3 = 0 THEN 'revoked' ELSE 'trial' END AS status FROM orders""")
def licence_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third licence revoked, each sixth restored later"""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("licence_id"), F.lit("trial").alias("status"))
    asked = rows.where(key % 3 == 0).select("licence_id", F.explode(F.when(F.col("licence_id") % 6 == 0, F.array(F.struct(F.lit(2).alias("at"), F.lit("active").alias("value")), F.struct(F.lit(1).alias("at"), F.lit("revoked").alias("value")))).otherwise(F.array(F.struct(F.lit(1).alias("at"), F.lit("revoked").alias("value"))))).alias("c"))
    return payments.with_status(rows, "licence_id", asked.select("licence_id", "c.at", "c.value"), "status")


@query("""SELECT c_custkey AS client_id, CASE WHEN c_custkey % 4 = 0 THEN 'New ' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 8 = 0 THEN 'G' ELSE '' END AS gstin, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_custkey % 5 > 0""")
def client_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fourth client renamed, each fifth deleted with its rows"""
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(c.alias("client_id"), F.col("c_name").alias("name"), F.lit("").alias("gstin"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client_id"))
    changes = rows.where("client_id % 4 = 0").select("client_id", F.concat(F.lit("New "), F.col("client_id").cast("string")).alias("new_name"), F.when(F.col("client_id") % 8 == 0, "G").alias("new_gstin"))
    left = clients.without({"clients": rows, "orders": orders}, rows.where("client_id % 5 = 0"))
    counts = left["orders"].groupBy("client_id").agg(F.count("*").alias("n"))
    return clients.renamed(left["clients"], changes).join(counts, "client_id", "left").select("client_id", "name", "gstin", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT o_custkey AS client_id, month(o_orderdate)::BIGINT AS import_id, 'm' || month(o_orderdate) AS file_name, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS date_from, max(CAST(o_orderdate AS DATE)) AS date_to FROM orders GROUP BY ALL""")
def import_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a month as an import"""
    month = F.month("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client_id"), month.cast("long").alias("import_id"), F.concat(F.lit("m"), month.cast("string")).alias("file_name"), F.to_date("o_orderdate").alias("date"))
    return clients.history(rows)


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty customers each as an older program's dump, with faults."""
    k = F.col("c_custkey")
    name = lambda p, n=k: F.concat(F.lit(p), n.cast("string"))
    client = F.struct(F.when(k % 7 == 0, "c0").otherwise(name("c")).alias("id"), name("Name ", k % 9).alias("name"))
    rule = F.struct(F.when(k % 5 == 0, "global").when(k % 6 == 0, "x").otherwise(name("c")).alias("clientId"))
    meta = F.struct(name("i").alias("id"), name("c").alias("clientId"), F.lit("f").alias("fileName"), (k % 4).alias("txnCount"))
    said = F.array(F.struct(F.when(k % 2 == 0, "").otherwise("01/01/2024").alias("date"), F.when(k % 5 > 0, 5.0).alias("debit"), F.lit(False).alias("isOpeningBalance")), F.struct(F.lit("01/01/2024").alias("date"), F.lit(None).cast("double").alias("debit"), F.lit(True).alias("isOpeningBalance")))
    held = F.when(k % 3 > 0, F.struct(name("bsp_imp_i").alias("key"), F.to_json(said).alias("value")))
    files = table(spark, sf_dir, "customer").groupBy(F.floor(k / 50).alias("file")).agg(F.to_json(F.collect_list(client)).alias("c"), F.to_json(F.collect_list(rule)).alias("r"), F.to_json(F.collect_list(meta)).alias("h"), F.collect_list(held).alias("i"))
    config = F.when(F.col("file") % 2 == 0, '{"a": 1}').otherwise("[]")
    fixed = F.create_map(F.lit("bsp_clients"), "c", F.lit("bsp_rules"), "r", F.lit("bsp_history"), "h", F.lit("bsp_config"), config, F.lit("other"), F.lit("1"))
    return files.select("file", F.to_json(F.map_concat(fixed, F.map_from_entries("i"))).alias("text"))


_DUMPS = "WITH k AS (SELECT c_custkey AS k, c_custkey // 50 AS file, CASE WHEN c_custkey % 7 = 0 THEN 'c0' ELSE 'c' || c_custkey END AS id FROM customer)"


@query(f"{_DUMPS} SELECT file, unnest(['clients', 'classification_rules', 'import_history']) AS entity, count(*) AS n FROM k GROUP BY 1, 2 UNION ALL SELECT file, 'transactions', 2 * count(*) FROM k WHERE k % 3 > 0 GROUP BY 1")
def dump_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S19"""
    return clients.dump_counts(clients.dump_entries(dumps(spark, sf_dir)))


@query(f"""{_DUMPS} SELECT file, 'clients' AS entity, 'repeated id' AS issue, id AS subject, count(*) - 1 AS n FROM k GROUP BY file, id HAVING count(*) > 1 UNION ALL SELECT file, 'clients', 'repeated name', 'name ' || k % 9, count(*) - 1 FROM k GROUP BY file, k % 9 HAVING count(*) > 1
 UNION ALL SELECT file, 'classification_rules', 'unknown client', '', count(*) FROM k WHERE k % 5 > 0 AND (k % 6 = 0 OR k % 7 = 0) GROUP BY 1 UNION ALL SELECT file, 'import_history', 'unknown client', '', count(*) FROM k WHERE k % 7 = 0 AND k > 0 GROUP BY 1
 UNION ALL SELECT file, 'transactions', 'count differs', 'i' || k, CASE WHEN k % 3 > 0 THEN 2 ELSE 0 END FROM k WHERE k % 4 <> CASE WHEN k % 3 > 0 THEN 2 ELSE 0 END UNION ALL SELECT file, 'transactions', 'no date', 'i' || k, 1 FROM k WHERE k % 3 > 0 AND k % 2 = 0 UNION ALL SELECT file, 'transactions', 'no amount', 'i' || k, 1 FROM k WHERE k % 3 > 0 AND k % 5 = 0
 UNION ALL SELECT DISTINCT file, 'settings', 'no object', '', 1 FROM k WHERE file % 2 = 1""")
def dump_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1"""
    return clients.dump_issues(clients.dump_entries(dumps(spark, sf_dir)))


@query("""SELECT CAST(o_custkey % 20 AS VARCHAR) AS file, o_orderkey * 10 AS row_idx, CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) AS date, CASE WHEN o_orderkey % 7 = 0 THEN 'TRANSACTION' ELSE 'Order ' || o_orderpriority || ' PAID' END AS narration, CASE WHEN o_orderkey % 4 > 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 12, '7') END AS reference,
 CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderkey + 1.25 AS DECIMAL(18,2)) AS balance FROM orders WHERE o_orderkey % 13 > 0""")
def multiline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as up to ten lines: one or two dates, texts, numbers, amounts, a heading and a footer"""
    key, price = F.col("o_orderkey"), money(F.col("o_totalprice")).cast("string")
    day = F.date_format(F.add_months("o_orderdate", 120), "dd/MM/yyyy")
    said = key % 7 > 0
    closing = (key + F.lit(1.25)).cast("decimal(18,2)").cast("string")
    texts = (day, F.when(key % 3 == 0, day), F.when(key % 4 > 0, F.lpad(key.cast("string"), 12, "7")), F.lit("Debit"), F.when(key % 2 == 0, F.concat(closing, F.lit("Cr"))), F.when(said, F.concat(F.lit("Order "), "o_orderpriority")),
             F.when(key % 13 > 0, F.concat(F.when(key % 5 == 0, "Rs. ").otherwise(""), price)), F.when(said, "PAID"), F.when(key % 2 == 1, closing), F.lit("Page 2 of 9"))
    each = F.posexplode(F.array(*texts)).alias("i", "line")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).cast("string").alias("file"), key, each).where("line is not null").select("file", (key * 10 + F.col("i")).alias("row_idx"), "line")
    return lines.rejoined(rows).select("file", "row_idx", "date", "narration", "reference", F.col("amounts")[0].alias("amount"), F.col("amounts")[1].alias("balance"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS file, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['date', 'narration', 'debit', 'credit', 'balance'] ELSE ['date', 'narration', 'debit', 'balance'] END) AS field, unnest(CASE WHEN n_nationkey % 2 = 0 THEN [10, 100, 300, 400, 500] ELSE [10, 100, 300, 500] END)::DOUBLE AS x FROM nation WHERE n_nationkey % 5 > 0""")
def inferred_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tables of six rows without a header; each fifth has no dates"""
    key = F.col("n_nationkey")
    cells = F.array(*[F.struct(F.lit(x).alias("x"), t.alias("text")) for x, t in ((12.0, F.when(key % 5 > 0, "05/01/2024").otherwise("none")), (98.0, F.concat(F.lit("PAID TO "), F.col("n_name"))), (301.0, F.lit("1,200.00")), (402.0, F.when(key % 2 == 0, "Rs.75.5")), (499.0, F.when(key % 3 == 0, "2,000.00Cr").otherwise("2,000.00")))])
    items = table(spark, sf_dir, "nation").select(key.cast("string").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("row"), F.explode(cells).alias("c")).select("file", "row", "c.x", F.lit(10.0).alias("w"), "c.text").where("text is not null")
    return positions.inferred_columns(items).select("file", F.explode("columns").alias("field", "x"))
