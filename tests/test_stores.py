"""Request limits, dumps and client lists against plain loops and known values."""

from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F

from bahikhata.operators import clients, layouts, payments
from bahikhata.plans.registry import QUERIES
from bahikhata.sources import workbooks


def loop(rows, per_minute):
    """The cell-rate rule by hand: rows of (key, at, id)."""
    free, step, out = defaultdict(lambda: float("-inf")), 60 / per_minute, {}
    for key, at, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out[i] = free[key] - at <= (per_minute - 1) * step + 1e-9
        if out[i]:
            free[key] = max(free[key], at) + step
    return out


def test_limits_equal_the_loop(spark, tiny):
    got = QUERIES["rate_cells"](spark, tiny).collect()
    want = loop([(r.user_id, r.at, r.event_id) for r in got], payments.LOGIN_PER_MINUTE)
    assert {r.event_id: r.allowed for r in got} == want


def test_limits_of_bursts_ties_and_silences(spark):
    times = [0.0] * 6 + [1.0, 12.0, 12.0, 24.5, 84.4, 84.5, 84.5, 84.5, 84.5, 84.5, 84.5, 200.0]
    rows = [(k, t, i * 100 + n) for i, k in enumerate(("a", "b", None)) for n, t in enumerate(times)]
    df = spark.createDataFrame(rows, "who string, at double, id long").withColumn("more", F.lit(1))
    got = payments.limited(df, "who", "at", "id", 5).collect()
    want = loop([(r.who or "", r.at, r.id) for r in got], 5)
    assert {r.id: r.allowed for r in got} == want and False in want.values() and len(got) == len(rows)
    assert payments.limited(df.limit(0), "who", "at", "id", 5).count() == 0


def test_plans(spark):
    df = spark.createDataFrame([("trial",), ("lifetime",), ("none",), (None,)], "p string").withColumn("d", F.lit("2024-01-01").cast("date"))
    got = df.select(payments.plan_price(F.col("p")), F.date_format(payments.plan_end(F.col("p"), F.col("d")), "yyyy-MM-dd")).collect()
    assert [tuple(r) for r in got] == [(0, "2024-01-15"), (999_900, None), (None, None), (None, None)]


def test_dumps_of_both_shapes(spark):
    plain = '{"bsp_clients": [{"id": "c1", "name": "A"}, {"id": "c1", "name": "a"}], "bsp_imp_7": [{"date": "", "debit": 1}], "bsp_history": [{"id": "7", "clientId": "c9", "txnCount": -1}], "bsp_config": "nonsense", "other": 5}'
    nested = '{"bsp_clients": "[{\\"id\\": \\"c1\\", \\"name\\": \\"A\\"}]", "bsp_config": "{}"}'
    entries = clients.dump_entries(spark.createDataFrame([("p", plain), ("n", nested), ("bad", "not json"), ("null", None), ("list", "[1]")], "file string, text string"))
    assert {(r.file, r.entity, r.n) for r in clients.dump_counts(entries).collect()} == {("p", "clients", 2), ("p", "import_history", 1), ("p", "transactions", 1), ("n", "clients", 1)}
    found = {(r.file, r.entity, r.issue, r.subject, r.n) for r in clients.dump_issues(entries).collect()}
    assert found == {("p", "clients", "repeated id", "c1", 1), ("p", "clients", "repeated name", "a", 1), ("p", "import_history", "unknown client", "", 1), ("p", "transactions", "no date", "7", 1), ("p", "settings", "no object", "", 1)}


def test_issues_of_a_dump_in_one_pass(spark):
    text = ('{"bsp_clients": [{"id": "c1", "name": "A"}, {"name": "B"}, null], "bsp_rules": [{"clientId": "global"}, {"clientId": "x"}, {}, {"clientId": "c1"}], "bsp_ledgers": [{"clientId": "y"}],'
            ' "bsp_history": [{"id": "7", "clientId": "c1", "txnCount": 3}, {"id": "7", "clientId": "c1", "txnCount": 3}, {"id": "8", "clientId": "z", "txnCount": 1}, {"clientId": "c1", "txnCount": 0}],'
            ' "bsp_imp_7": [{"date": "1"}, {"debit": 1.0}, {"date": "1", "isOpeningBalance": true}, null], "bsp_imp_9": [{}]}')
    entries = clients.dump_entries(spark.createDataFrame([("p", text), ("q", '{"bsp_config": "[]"}')], "file string, text string"))
    issues = clients.dump_issues(entries)
    seven = [("transactions", "count differs", "7", 4), ("transactions", "no date", "7", 2), ("transactions", "no amount", "7", 2)]
    want = [("clients", "repeated id", None, 1), ("classification_rules", "unknown client", "", 2), ("ledgers", "unknown client", "", 1), ("import_history", "unknown client", "", 1), ("transactions", "count differs", "8", 0), *seven, *seven]
    assert sorted(map(str, [tuple(r)[1:] for r in issues.where("file = 'p'").collect()])) == sorted(map(str, want))
    assert [tuple(r) for r in issues.where("file = 'q'").collect()] == [("q", "settings", "no object", "", 1)]
    plan = issues._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Join" not in plan  # a union of all questions once came to one task that read the dumps ten times


def test_lost_rows(spark):
    report = spark.createDataFrame([("clients", 3), ("ledgers", 2), ("rules", 0), ("history", 1)], "entity string, imported long")
    stored = spark.createDataFrame([("clients", 3), ("ledgers", 1)], "entity string, n long")
    assert {tuple(r) for r in clients.lost(report, stored).collect()} == {("ledgers", 2, 1), ("history", 1, 0)}


def test_reimport_defaults(spark):
    head = ["Narration", "DATE", "vendor", "Account Head", "Debit", "Status", "Tags", "Confidence", "Type"]
    rows = [head, ["x", "05/01/2024", "V", "", "₹ 1,000.50", "manual", "A; ;B", "", "receipt"], ["", "", "V", "", "", "", "", "", ""], ["y", "", "", "", "0", "", "", "0.4", "Odd"], ["z"]]
    cells = spark.createDataFrame([("f", "Transactions", i, r) for i, r in enumerate(rows)] + [("g", "Transactions", 0, ["Date", "Narration"]), ("g", "Transactions", 1, ["05/01/2024", "n"]), ("f", "Summary", 0, ["q"])], "file string, sheet_name string, row_idx int, cells array<string>")
    got = [(r.id, r.narration, str(r.debit), r.status, r.confidence, r.classification_source, r.tags, r.txn_type) for r in workbooks.reimported(cells).orderBy("id").collect()]
    assert got == [("ri_0", "x", "1000.50", "Classified", 1.0, "user", ["A", "B"], "Receipt"), ("ri_1", "y", "None", "Unreviewed", 0.4, "", [], "Payment"), ("ri_2", "z", "None", "Unreviewed", 0.0, "", [], "Payment")]


def test_reimport_unpacks_once(spark):
    cells = workbooks.cells_of(spark.createDataFrame([("f", b"")], "path string, content binary"))
    plan = workbooks.reimported(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1 and "Join" not in plan  # the first rows were once told by unpacking all files again


def test_empty_texts_are_cells_without_content(spark):
    row = spark.createDataFrame([("a", "", None, "<&>")], "a string, b string, c string, d string").select(layouts._row([F.col(c) for c in "abcd"]).alias("row")).first().row
    content = layouts._bound(pd.DataFrame({"client_id": [1], "book": [0], "sheet": [1], "ord": [0], "row": [row]}))["content"][0]
    assert row.count("<c/>") == 2 and next(workbooks._sheets("f", content))[-1] == ["a", "", "", "<&>"]


def test_targets():
    assert layouts.target(1)[0] == "Zoho Books" and layouts.target(99) == layouts.target(5) and layouts.target(-1)[1] == "xml"


def test_documents_are_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(1, s, o, f"{s}-{o}") for s in (9, 3, 0) for o in (2, 10, 1)], "client_id long, section int, ord long, line string")
    layouts.written(rows, str(tmp_path / "d"))
    parts = sorted((tmp_path / "d" / "client_id=1").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == [f"{s}-{o}" for s in (0, 3, 9) for o in (1, 2, 10)]


def test_report_reads_kept_rows(spark, tiny):
    files = QUERIES["csv_report"](spark, tiny).inputFiles()
    assert files and not any("events.parquet" in f for f in files)  # each part of the report once classified all rows again


def test_report_keeps_only_what_files_show(spark, tiny):
    held = spark.read.parquet(*QUERIES["csv_report"](spark, tiny).inputFiles()).columns
    assert "narration" in held and not {"id", "account", "date_raw"} & set(held)
