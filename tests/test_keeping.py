"""What a store keeps: undo stacks against a plain stack, broken runs, versions, journals, limits on a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from bahikhata.operators import catalog, edits, journal, legacy, payments
from bahikhata.plans import keeping
from bahikhata.plans.registry import QUERIES
from bahikhata.sources import statements


def test_undos_against_a_stack(spark, monkeypatch):
    rng = random.Random(1)
    events = [(g, i * 5, rng.random() < (0.3, 0.5, 0.7)[g], rng.randrange(8), rng.choice(["", f"v{i}"]), rng.choice([None, i / 10])) for g in range(3) for i in range(400)]
    stacks, rows, touched = {g: [] for g in range(3)}, {(g, t): ["", 0.0] for g in range(3) for t in range(8)}, set()
    for g, _, undo, t, vendor, conf in events:
        if undo and stacks[g]:
            at, was = stacks[g].pop()
            rows[g, at] = was
        elif not undo:
            touched.add((g, t))
            stacks[g].append((t, list(rows[g, t])))
            rows[g, t] = [vendor or rows[g, t][0], rows[g, t][1] if conf is None else conf]
    df = spark.createDataFrame(events, "g long, n long, undo boolean, t long, vendor string, confidence double").withColumns({"account_head": F.lit(None).cast("string"), "txn_type": F.lit(""), "status": F.lit("Manual")}).repartition(3)
    table = spark.createDataFrame([(g, t, "", "", "", "", 0.0, "") for g in range(3) for t in range(8)], "g long, t long, vendor string, account_head string, txn_type string, status string, confidence double, classification_source string")
    monkeypatch.setattr(edits, "scanned", lambda *a, f=edits.scanned, **k: f(*a, **k, stretch=64))
    got = {(r.g, r.t): r for r in edits.applied(table, df, ["g"], "t", "n").collect()}
    assert {k: [r.vendor, r.confidence] for k, r in got.items()} == rows
    assert {k for k, r in got.items() if r.classification_source == "user"} == touched


def rows_of(spark, root):
    now = catalog.manifest(spark, root)
    return now["number"], {name: sorted(map(str, catalog.table(spark, root, name, now).collect())) for name in now["tables"]}


def test_a_failure_in_the_last_table_leaves_all(spark, tiny, tmp_path):
    root, old = f"file://{tmp_path}/store", keeping._old(spark, tiny)
    some = {**old, "clients": old["clients"].where("legacy_client < 'c5'")}
    legacy.imported(spark, root, some)
    before = rows_of(spark, root)
    assert before[0] == 1 and set(before[1]) == set(legacy.TABLES)
    with pytest.raises(Exception, match="disk full"):
        legacy.imported(spark, root, {**old, "settings": old["settings"].withColumn("value", F.raise_error(F.lit("disk full")).cast("string"))})
    assert rows_of(spark, root) == before and catalog.cleaned(spark, root) == 0
    report = {r.entity: r for r in legacy.imported(spark, root, old).collect()}
    assert report["clients"].skipped >= len(before[1]["clients"]) and rows_of(spark, root)[0] == 2
    assert {r.imported for r in legacy.imported(spark, root, old).collect()} == {0}
    ids = [r.client_id for r in catalog.table(spark, root, "clients").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_a_broken_write_takes_its_folders_away(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one = spark.range(3)
    catalog.commit(spark, root, {"a": one, "b": one})
    now = catalog.manifest(spark, root)
    with pytest.raises(Exception, match="no more"):
        catalog.commit(spark, root, {"a": spark.range(9), "b": spark.range(9).select(F.raise_error(F.lit("no more")).alias("id"))})
    assert catalog.manifest(spark, root) == now and len(list((tmp_path / "store" / "data").iterdir())) == 2
    catalog.commit(spark, root, {"a": spark.range(5)})
    with pytest.raises(Exception):
        catalog.commit(spark, root, {"a": spark.range(7)}, now)  # made of the manifest before
    assert catalog.table(spark, root, "a").count() == 5 and catalog.table(spark, root, "b").count() == 3
    (tmp_path / "store" / "manifests" / f"{9:020d}.json").write_text('{"number": 9')
    assert catalog.manifest(spark, root)["number"] == 2
    assert catalog.cleaned(spark, root) == 1


def test_versions_go_on_after_a_failure(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    catalog.commit(spark, root, {"transactions": spark.range(4)})
    fail = F.raise_error(F.lit("stopped"))
    steps = [(2, {"transactions": lambda df: df.withColumn("b", F.lit(2))}), (1, {"transactions": lambda df: df.withColumn("a", F.lit(1))}), (3, {"transactions": lambda df: df.withColumn("c", fail)})]
    with pytest.raises(Exception, match="stopped"):
        catalog.upgraded(spark, root, steps)
    assert catalog.manifest(spark, root)["schema"] == 2 and catalog.table(spark, root, "transactions").columns == ["id", "a", "b"]
    steps[2] = (3, {"transactions": lambda df: df.withColumn("c", F.lit(3)), "gone": lambda df: df})
    assert catalog.upgraded(spark, root, steps) == [3] and catalog.upgraded(spark, root, steps) == []
    older = f"file://{tmp_path}/older"
    catalog.commit(spark, older, {"transactions": spark.range(2).withColumn("dup_flag", F.lit(True))})
    assert catalog.upgraded(spark, older, steps, baseline=2, marks=("transactions", "dup_flag")) == [3]


def test_journal(spark, tmp_path):
    path = f"file://{tmp_path}/audit"
    for batch, rows in ((0, [(1, 0, "a"), (1, 1, "b"), (2, 0, "x")]), (1, [(1, 0, "c")]), (1, [(1, 0, "c")])):
        journal.appended(spark.createDataFrame(rows, "client_id long, n long, event string"), path, batch)
    assert sorted(tuple(r) for r in journal.shown(spark, path, 2).collect()) == [(1, 1, "c"), (1, 2, "b"), (2, 1, "x")]
    rules = spark.createDataFrame([(1, 2, 'A "B"', "V", "H", "Payment"), (1, 1, "Z", "", "", "Receipt")], "client_id long, priority int, pattern string, vendor string, account_head string, txn_type string")
    (text,) = [r.text for r in journal.rule_documents(rules).collect()]
    assert [r["pattern"] for r in json.loads(text)["rules"]] == ["Z", 'A "B"']
    (tmp_path / "rules.json").write_text(text)
    assert [r.pattern for r in statements.rules_json(spark, f"file://{tmp_path}/rules.json").collect()] == ["Z", 'A "B"']
    table = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    changes = spark.createDataFrame([("a", "5", 1), ("a", "6", 2), ("b", None, 1), ("c", "7", 1)], "key string, value string, n int")
    assert sorted(tuple(r) for r in journal.settings(table, changes, "n").collect()) == [("a", "6"), ("c", "7")]


def test_stream_limits_as_the_batch_does(spark, tiny):
    got = {r.event_id: r.allowed for r in QUERIES["rate_stream"](spark, tiny).collect()}
    at = (F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800).cast("double")
    rows = spark.read.parquet(f"{tiny}/events.parquet").select("event_id", "user_id", at.alias("at"))
    want = {r.event_id: r.allowed for r in payments.limited(rows, "user_id", "at", "event_id", payments.LOGIN_PER_MINUTE).collect()}
    assert got == want and not all(want.values())
