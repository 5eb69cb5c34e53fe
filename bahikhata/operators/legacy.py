"""An older program's data brought into a store in one run: clients, rules, ledgers, hashes, imports with their transactions, settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bahikhata.operators import catalog, migrated
from bahikhata.operators.stages import kept
from bahikhata.operators.store import upserted

#: The tables of a store that a run fills.
TABLES = {
    "clients": "client_id long, name string, gstin string",
    "rules": "client_id long, pattern string, vendor string, account_head string, txn_type string",
    "ledgers": "client_id long, name string, group string",
    "hashes": "client_id long, hash string",
    "imports": "import_id long, client_id long, file_name string, txn_count long, imported_at string",
    "transactions": "client_id long, id string, import_id long, date date, narration string, debit decimal(18,2), credit decimal(18,2), status string, txn_type string, bank_name string, account_no string",
    "settings": "key string, value string",
}
_BUCKETS = 256


def numbered(rows: DataFrame, key: list[str], start: Column) -> DataFrame:
    """Adds ``n``: start, start + 1 .. in the order of a hash of the key, counted in buckets of it."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(_BUCKETS)))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_count"))
    base = counts.select("_bucket", F.coalesce(F.sum("_count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.xxhash64(*key), *key)) - 1
    return rows.withColumn("_inside", inside).join(F.broadcast(base), "_bucket").withColumn("n", start + F.col("_base") + F.col("_inside")).drop("_bucket", "_inside", "_base")


def _new(rows: DataFrame, known: DataFrame, keys: list[str], case: str | None = None) -> DataFrame:
    """Of ``rows`` with one key one, if ``known`` hasn't the key; the case of ``case`` doesn't count."""
    key = lambda df: [F.upper(c).alias(f"_k_{c}") if c == case else F.col(c).alias(f"_k_{c}") for c in keys]
    seen = known.select(*key(known)).distinct()
    order = Window.partitionBy(*[f"_k_{c}" for c in keys]).orderBy(*[F.col(c) for c in rows.columns])
    fresh = rows.select("*", *key(rows)).join(seen, [f"_k_{c}" for c in keys], "left_anti")
    return fresh.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*rows.columns)


def imported(spark: SparkSession, root: str, old: dict[str, DataFrame]) -> DataFrame:
    """(entity, found, imported, skipped, failed, unsupported) of one run over ``old``; all of it is in the store afterwards, or, if anything fails, nothing.

    ``old``: clients (legacy_client, name, gstin); rules, ledgers and hashes with a legacy_client in place of the client_id; imports (legacy_import,
    legacy_client, file_name, txn_count, imported_at); transactions (legacy_import, id, date, narration, debit, credit, status, txn_type, bank_name,
    account_no); settings (key, value). What the store has already is skipped: a client by name, a rule by pattern in any case, a ledger by name, a hash, an
    import by client, file and count, a transaction by client and id (its values are replaced). Rows of unknown clients fail, those of the scope 'global' are
    unsupported. Rows without a bank or account take the first of their import that has one.
    """
    now = catalog.manifest(spark, root)
    have = {name: catalog.table(spark, root, name, now) if name in now["tables"] else spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    said = kept(old["clients"])
    named = said.groupBy("name").agg(F.min("gstin").alias("gstin"))
    top = have["clients"].agg(F.coalesce(F.max("client_id"), F.lit(0)).alias("_top"))
    fresh = kept(numbered(named.join(have["clients"].select("name"), "name", "left_anti").join(F.broadcast(top)), ["name"], F.col("_top") + 1).select(F.col("n").alias("client_id"), "name", "gstin"))
    clients = have["clients"].unionByName(fresh)
    ids = kept(said.join(clients.select("client_id", "name"), "name").groupBy("legacy_client").agg(F.min("client_id").alias("client_id")))

    def resolved(rows: DataFrame) -> DataFrame:
        return rows.join(ids, "legacy_client", "left").withColumn("outcome", F.when(F.col("legacy_client") == "global", "unsupported").when(F.col("client_id").isNull(), "failed").otherwise("ok"))

    def line(entity: str, rows: DataFrame, new: DataFrame) -> DataFrame:
        seen = rows.agg(F.count("*").alias("found"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "unsupported").alias("unsupported"))
        return seen.join(F.broadcast(new.agg(F.count("*").alias("imported")))).select(F.lit(entity).alias("entity"), "found", "imported", (F.col("found") - F.col("imported") - F.col("failed") - F.col("unsupported")).alias("skipped"), "failed", "unsupported")

    tables, lines = {"clients": clients}, [line("clients", said.withColumn("outcome", F.lit("ok")), fresh)]
    for name, keys, case in (("rules", ["client_id", "pattern"], "pattern"), ("ledgers", ["client_id", "name"], "name"), ("hashes", ["client_id", "hash"], None)):
        rows = kept(resolved(old[name]))
        new = kept(_new(rows.where("outcome = 'ok'").select(*have[name].columns), have[name], keys, case))
        tables[name] = have[name].unionByName(new)
        lines.append(line(name, rows, new))

    runs = kept(resolved(old["imports"]))
    what = ["client_id", "file_name", "txn_count"]
    last = have["imports"].agg(F.coalesce(F.max("import_id"), F.lit(0)).alias("_top"))
    new = numbered(_new(runs.where("outcome = 'ok'").select(*what, "imported_at"), have["imports"], what).join(F.broadcast(last)), what, F.col("_top") + 1)
    new = kept(new.select(F.col("n").alias("import_id"), *what, "imported_at"))
    tables["imports"] = have["imports"].unionByName(new)
    lines.append(line("imports", runs, new))

    at = kept(runs.where("outcome = 'ok'").join(tables["imports"].groupBy(*what).agg(F.min("import_id").alias("import_id")), what).select("legacy_import", "client_id", "import_id"))
    rows = old["transactions"].join(runs.select("legacy_import", "outcome").distinct(), "legacy_import").join(at, "legacy_import", "left")
    first = rows.groupBy("legacy_import").agg(*[F.min_by(c, F.when(F.col(c) != "", F.struct("date", "id", c))).alias(f"_{c}") for c in ("bank_name", "account_no")])
    rows = rows.join(first, "legacy_import").withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.lit("")) for c in ("bank_name", "account_no")})
    made = F.hex(F.xxhash64("date", "narration", "debit", "credit"))
    rows = kept(rows.withColumns({"id": F.coalesce(F.nullif(F.col("id"), F.lit("")), made), "status": migrated.status(F.col("status")), "txn_type": migrated.voucher(F.col("txn_type"))}).select(*have["transactions"].columns, "outcome"))
    good = rows.where("outcome = 'ok'").drop("outcome")
    put = kept(good.withColumn("_n", F.row_number().over(Window.partitionBy("client_id", "id").orderBy(*[F.desc(c) for c in good.columns]))).where("_n = 1").drop("_n"))
    tables["transactions"] = upserted(have["transactions"], put, ["client_id", "id"])
    lines.append(line("transactions", rows, put.join(have["transactions"].select("client_id", "id"), ["client_id", "id"], "left_anti")))

    pairs = old["settings"].groupBy("key").agg(F.max("value").alias("value"))
    tables["settings"] = upserted(have["settings"], pairs, ["key"])
    lines.append(line("settings", old["settings"].withColumn("outcome", F.lit("ok")), pairs.join(have["settings"], ["key", "value"], "left_anti")))
    report = kept(reduce(DataFrame.unionByName, lines))
    catalog.commit(spark, root, tables, now)
    return report
