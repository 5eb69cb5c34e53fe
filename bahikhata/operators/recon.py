"""Reconciliation of bank rows with vouchers: candidate pairs by date and amount, then one-to-one greedy choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bahikhata.functions.text import jaccard, tokens
from bahikhata.operators.stages import kept


@dataclass(frozen=True)
class ReconConfig:
    days: int = 3
    pct: float = 0.5
    accept: float = 0.90
    flag: float = 0.40
    like: float = 0.55


def _near(a: Column, b: Column, pct: float) -> Column:
    """Amounts within pct percent of the larger, in whole hundredths of a percent of a paisa: exact."""
    return F.abs(a - b) * 10000 <= F.greatest(a, b) * F.lit(round(pct * 100))


def candidates(bank: DataFrame, vouchers: DataFrame, cfg: ReconConfig = ReconConfig()) -> DataFrame:
    """(b, v, score): pairs of one account within twice the tolerances.

    bank(account, b, date, amount, narration, reference), vouchers(account, v, date, amount, narration, voucher_no).

    The range join is made equal by buckets: days in buckets of twice the tolerance, and amounts in buckets
    on a logarithmic scale that are wider than the tolerance, so a pair meets in a neighbouring bucket at most. A voucher stands in nine buckets.
    Spark's estimate doesn't see that, so the join is told to shuffle both sides: broadcast, the driver would hold all of one. Words are split for the pairs alone.
    """
    reach = 2 * cfg.days
    ratio = 1 + 4 * cfg.pct / 100 + 1e-6

    def bucketed(rows: DataFrame, spread: bool) -> DataFrame:
        size = F.abs("amount")
        day = F.floor(F.datediff("date", F.lit("2000-01-01").cast("date")) / (reach + 1))
        level = F.when(size > 0, F.floor(F.log(size.cast("double")) / F.log(F.lit(ratio)))).otherwise(-1_000_000)
        rows = rows.where("date is not null").withColumn("_a", size.cast("decimal(18,2)"))
        around = lambda x: F.explode(F.sequence(x - 1, x + 1)) if spread else x
        return rows.withColumn("_day", around(day)).withColumn("_level", around(level))
    left = bucketed(bank, False).select("account", "b", "_day", "_level", F.col("date").alias("bd"), F.col("_a").alias("ba"), F.col("narration").alias("bn"), F.trim("reference").alias("br"))
    right = bucketed(vouchers, True).select("account", "v", "_day", "_level", F.col("date").alias("vd"), F.col("_a").alias("va"), F.col("narration").alias("vn"), F.trim("voucher_no").alias("vr"))
    a, b, days = F.col("ba"), F.col("va"), F.abs(F.datediff("bd", "vd"))
    both = (a == 0) & (b == 0)
    pairs = left.join(right.hint("merge"), ["account", "_day", "_level"]).where((days <= reach) & (both | ((a > 0) & (b > 0) & _near(a, b, 2 * cfg.pct))))
    words = lambda c: tokens(F.col(c), "[^A-Z0-9]+")
    like = jaccard(words("bn"), words("vn"))
    points = (F.when(a == b, 0.40).when(_near(a, b, cfg.pct), 0.30).otherwise(0.10)
              + F.when(days == 0, 0.40).when(days <= 1, 0.30).when(days <= cfg.days, 0.20).otherwise(0.05)
              + F.when(like >= 0.80, 0.20).when(like >= cfg.like, like * 0.15).otherwise(0.0)
              + F.when((F.col("br") != "") & (F.col("br") == F.col("vr")), 0.20).otherwise(0.0))
    return pairs.select("b", "v", F.round(F.least(points, F.lit(1.0)), 2).alias("score"))


def greedy(pairs: DataFrame) -> DataFrame:
    """One-to-one matches as taking pairs by falling score (ties: b, then v) would choose them.

    Each round keeps the pairs that are best for both of their sides and drops what they used; the rest goes on.
    Every round decides at least the best pair left, in practice most; it ends in a checkpoint.
    """
    left, chosen = kept(pairs), None
    while not left.isEmpty():
        order = [F.desc("score"), "b", "v"]
        ranked = left.withColumn("rb", F.row_number().over(Window.partitionBy("b").orderBy(*order))).withColumn("rv", F.row_number().over(Window.partitionBy("v").orderBy(*order)))
        best = kept(ranked.where("rb = 1 and rv = 1").select("b", "v", "score"))
        chosen = best if chosen is None else chosen.unionByName(best)
        left = kept(left.join(best.select("b"), "b", "left_anti").join(best.select("v"), "v", "left_anti"))
    return chosen if chosen is not None else pairs


def match_status(score: Column, cfg: ReconConfig = ReconConfig()) -> Column:
    return F.when(score >= cfg.accept, "Matched").when(score >= cfg.flag, "Likely").when(score > 0, "Possible").otherwise("Unmatched")


def report(bank: DataFrame, vouchers: DataFrame, cfg: ReconConfig = ReconConfig()) -> DataFrame:
    """Matches, bank rows without a voucher, and vouchers missing in the bank, as one table."""
    matches = greedy(candidates(bank, vouchers, cfg))
    lone_b, lone_v = bank.join(matches, "b", "left_anti"), vouchers.join(matches, "v", "left_anti")
    none = F.lit(None).cast("long")
    return (matches.select("b", "v", "score", match_status(F.col("score"), cfg).alias("status"))
            .unionByName(lone_b.select("b", none.alias("v"), F.lit(0.0).alias("score"), F.lit("UNMATCHED-BANK").alias("status")))
            .unionByName(lone_v.select(none.alias("b"), "v", F.lit(0.0).alias("score"), F.lit("MISSING-IN-BANK").alias("status"))))


def counts(rows: DataFrame) -> DataFrame:
    """One row of how many of report()'s rows are in each state."""
    names = {"matched": "Matched", "likely": "Likely", "possible": "Possible", "unmatched_bank": "UNMATCHED-BANK", "unmatched_vouchers": "MISSING-IN-BANK"}
    return rows.agg(*[F.count_if(F.col("status") == v).alias(k) for k, v in names.items()])


def report_lines(rows: DataFrame) -> DataFrame:
    """report() as quoted CSV lines, score in whole percent."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return rows.select(F.concat_ws(",", quoted(F.col("status")), quoted(F.col("b")), quoted(F.col("v")), quoted(F.format_string("%.0f%%", F.col("score") * 100))).alias("line"))
