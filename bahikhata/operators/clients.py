"""The store's client list and import history, and what an older program's dump holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def renamed(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """``clients`` (client_id, name, gstin) by name, with the names and numbers of ``changes`` (client_id, new_name, new_gstin) where given."""
    rows = clients.join(changes, "client_id", "left")
    return rows.select("client_id", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_gstin", "gstin").alias("gstin")).orderBy("name", "client_id")


def without(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the clients in ``gone`` (client_id)."""
    return {n: t.join(gone.select("client_id").distinct(), "client_id", "left_anti") for n, t in tables.items()}


def history(kept: DataFrame) -> DataFrame:
    """One row an import with the rows that it kept and their span; ``kept`` has (client_id, import_id, file_name, date)."""
    return kept.groupBy("client_id", "import_id", "file_name").agg(F.count("*").alias("n"), F.min("date").alias("date_from"), F.max("date").alias("date_to"))


_CLIENT = "array<struct<id:string,name:string,gstin:string>>"
_OWNED = "array<struct<clientId:string>>"
_IMPORT = "array<struct<id:string,clientId:string,fileName:string,txnCount:long>>"
_ROW = "array<struct<id:string,date:string,narration:string,debit:double,credit:double,balance:double,status:string,type:string,isOpeningBalance:boolean,systemGenerated:boolean>>"
# The keys of a dump and the entities under them; the rows of an import lie under a key of its own.
KEYS = {"bsp_clients": "clients", "bsp_rules": "classification_rules", "bsp_ledgers": "ledgers", "bsp_dedupe": "dedupe_hashes", "bsp_history": "import_history"}
CONFIG, IMPORT = "bsp_config", "bsp_imp_"


def dump_entries(files: DataFrame) -> DataFrame:
    """(file, key, value) of dumps given as (file, text): the program's keys only.

    A value that is a string holds JSON; one that isn't a JSON object of keys gives no entries.
    """
    entries = files.select("file", F.explode(F.from_json("text", "map<string,string>")).alias("key", "value"))
    return entries.where(F.startswith("key", F.lit("bsp_")))


def dump_transactions(entries: DataFrame) -> DataFrame:
    """(file, import_id, ...) the rows of every import in the dumps."""
    rows = entries.where(F.startswith("key", F.lit(IMPORT))).select("file", F.substr("key", F.lit(len(IMPORT) + 1)).alias("import_id"), F.explode(F.from_json("value", _ROW)).alias("v"))
    return rows.select("file", "import_id", "v.*")


def dump_counts(entries: DataFrame) -> DataFrame:
    """(file, entity, n) of what the dumps hold."""
    size = F.coalesce(F.json_array_length("value"), F.lit(0)).cast("long")
    entity = F.coalesce(*[F.when(F.col("key") == k, e) for k, e in KEYS.items()], F.when(F.startswith("key", F.lit(IMPORT)), "transactions"))
    return entries.select("file", entity.alias("entity"), size.alias("n")).where("entity is not null").groupBy("file", "entity").agg(F.sum("n").alias("n"))


def dump_issues(entries: DataFrame) -> DataFrame:
    """V1: (file, entity, issue, subject, n): repeated client ids and names, rows of unknown clients, imports whose count is wrong, rows without date or amount, settings that are no object.

    Each entry is parsed once, into facts about an id, a name or an import of its file; facts about one subject meet in one grouping, so no entry is read again for
    another question, and nothing is joined.
    """
    owners, none = dict(list(KEYS.items())[1:]), F.lit(None)
    shape = {"kind": "string", "subject": "string", "entity": "string", "txn": "struct<count:bigint>", "rows": "bigint", "no_date": "bigint", "no_amount": "bigint"}

    def fact(**given: Column) -> Column:
        return F.struct(*[given.get(name, none).cast(kind).alias(name) for name, kind in shape.items()])

    def each(key: str, schema: str, *facts) -> tuple[Column, Column]:
        """The facts about every element under a key; ``facts`` give null for those that say nothing."""
        return F.col("key") == key, F.filter(F.flatten(F.transform(F.from_json("value", schema), lambda v: F.array(*[f(v) for f in facts]))), lambda f: f.isNotNull())

    def owned(entity: str):
        return lambda v: F.when(F.coalesce(v["clientId"], F.lit("")) != "global", fact(kind=F.lit("id"), subject=v["clientId"], entity=F.lit(entity)))
    made = [each("bsp_clients", _CLIENT, lambda v: fact(kind=F.lit("id"), subject=v["id"], entity=F.lit("clients")), lambda v: fact(kind=F.lit("name"), subject=F.lower(v["name"]), entity=F.lit("clients")))]
    for key, entity in owners.items():
        kept = [lambda v: fact(kind=F.lit("import"), subject=v["id"], txn=F.struct(v["txnCount"].alias("count")))] if key == "bsp_history" else []
        made.append(each(key, _IMPORT if kept else _OWNED, owned(entity), *kept))
    dateless = lambda r: F.trim(F.coalesce(r["date"], F.lit(""))) == ""
    unpaid = lambda r: ~(F.coalesce(r["isOpeningBalance"], F.lit(False)) | F.coalesce(r["systemGenerated"], F.lit(False))) & r["debit"].isNull() & r["credit"].isNull()
    sums = F.transform(F.array(F.from_json("value", _ROW)), lambda rows: F.when(rows.isNotNull(), fact(kind=F.lit("import"), subject=F.substr("key", F.lit(len(IMPORT) + 1)), rows=F.size(rows), no_date=F.size(F.filter(rows, dateless)), no_amount=F.size(F.filter(rows, unpaid)))))
    made.append((F.startswith("key", F.lit(IMPORT)), F.filter(sums, lambda f: f.isNotNull())))
    made.append(((F.col("key") == CONFIG) & ~F.coalesce(F.startswith(F.ltrim("value"), F.lit("{")), F.lit(False)), F.array(fact(kind=F.lit("settings"), subject=F.lit("")))))
    facts = entries.select("file", F.explode(F.coalesce(*[F.when(is_, rows) for is_, rows in made])).alias("f")).select("file", "f.*")

    of = lambda entity: F.count_if(F.coalesce(F.col("entity") == entity, F.lit(False)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    met = facts.groupBy("file", "kind", "subject").agg(of("clients").alias("clients"), *[of(e).alias(e) for e in owners.values()], F.collect_list("txn").alias("txns"), *[total(c) for c in ("rows", "no_date", "no_amount")], F.count("*").alias("all"))
    kind, again = F.col("kind"), F.col("clients") - 1

    def issue(entity: str, what: str, n: Column, subject: Column | None = None, at: Column | None = None) -> Column:
        return F.struct(F.lit(entity).alias("entity"), F.lit(what).alias("issue"), F.lit("").alias("subject") if subject is None else subject.alias("subject"), n.cast("long").alias("n"), (F.lit(0) if at is None else at).cast("int").alias("at"))
    unknown = (kind == "id") & ((F.col("clients") == 0) | F.col("subject").isNull())
    found = [F.when((kind == "id") & (again > 0), issue("clients", "repeated id", again, F.col("subject"))), F.when((kind == "name") & (again > 0), issue("clients", "repeated name", again, F.col("subject")))]
    found += [F.when(unknown & (F.col(e) > 0), issue(e, "unknown client", F.col(e))) for e in owners.values()]

    def about(txn: Column, at: Column) -> Column:
        wrong = (txn["count"] >= 0) & (txn["count"] != F.col("rows"))
        return F.array(F.when(wrong, issue("transactions", "count differs", F.col("rows"), F.col("subject"), at)), *[F.when(F.col(c) > 0, issue("transactions", what, F.col(c), F.col("subject"), at)) for c, what in (("no_date", "no date"), ("no_amount", "no amount"))])
    settings = F.when(kind == "settings", F.transform(F.sequence(F.lit(1), F.col("all").cast("int")), lambda at: issue("settings", "no object", F.lit(1), None, at)))
    every = F.concat(F.array(*found), F.flatten(F.transform("txns", about)), F.coalesce(settings, F.array_repeat(found[0], 0)))
    rows = met.select("file", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("i")).select("file", "i.*")
    # Unknown clients are counted for all of a file; ``at`` keeps apart what a dump says several times.
    return rows.groupBy("file", "entity", "issue", "subject", "at").agg(F.sum("n").alias("n")).drop("at")


def lost(report: DataFrame, stored: DataFrame) -> DataFrame:
    """V1: entities of which ``stored`` (entity, n) holds fewer rows than ``report`` (entity, imported) says were brought in."""
    return report.where("imported > 0").join(stored, "entity", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < imported").select("entity", "imported", "n")
