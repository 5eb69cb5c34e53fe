"""Times the headline queries once warm: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and cores."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from bahikhata.plans.queries import QUERIES

HEADLINES = ("monthly_credit_debit", "dash_summary", "top_expense_heads", "cashflow_sample", "per_account_balances", "prev_balance", "txn_hash", "dup_passes", "dup_like", "keyword_classify", "classify_all", "gst_analysis", "tally_group", "recon_candidates", "journal_legs", "upsert_merge", "dedup_in_file", "payment_heal")
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds, spread = {}, {}
    for name in HEADLINES:
        times = []
        for run in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:  # the first run warms up
                times.append(time.perf_counter() - began)
        seconds[name], spread[name] = round(statistics.median(times), 3), round(max(times) - min(times), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "spread": spread, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
