"""Payments of the licence service: what webhook events change, plans, status updates, request limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bahikhata.operators.scans import scanned

# Price in minor units and days of each plan (None: no end).
PLANS = {"trial": (0, 14), "monthly": (49_900, 30), "yearly": (399_900, 365), "lifetime": (999_900, None)}
LOGIN_PER_MINUTE, DEVICE_PER_MINUTE = 5, 30

_ACTIVATES = ("payment.captured", "payment_link.paid", "subscription.activated", "subscription.charged")
_ENDS = ("subscription.cancelled", "subscription.halted")
_REFUNDS = ("refund.created", "refund.processed")


def plan_price(plan: Column) -> Column:
    """Null for an unknown plan."""
    return F.coalesce(*[F.when(plan == p, F.lit(price).cast("long")) for p, (price, _) in PLANS.items()])


def plan_end(plan: Column, start: Column) -> Column:
    """The day or time at which a period that begins at ``start`` ends; null for plans without an end and unknown ones."""
    return F.coalesce(*[F.when(plan == p, start + F.expr(f"INTERVAL {days} DAYS")) for p, (_, days) in PLANS.items() if days])


def payment_status(provider: Column) -> Column:
    """Null for provider states that say nothing final."""
    return F.when(provider == "captured", "succeeded").when(provider == "failed", "failed").when(provider == "refunded", "refunded")


def resolved(events: DataFrame, payments: DataFrame, subscriptions: DataFrame, licences: DataFrame) -> DataFrame:
    """One row an event of what it changes; ``mutation`` is 'none' if nothing.

    events (event_key, event, at, provider_ref, gateway_payment_id, amount_minor, currency, dispute); payments (payment_id, provider_ref,
    gateway_payment_id, amount_minor, currency, status, subscription_id), each reference once; subscriptions (subscription_id, plan, period_end);
    licences (licence_id, subscription_id), of which the largest id is a subscription's latest. Refunds and disputes are looked up by the
    gateway's number, all else by reference. An activation must agree in amount and currency, where stated, and not follow a
    refund or dispute; a failure only counts for a pending payment.
    """
    by_gateway = F.col("event").isin(*_REFUNDS, "payment.dispute.created", "payment.dispute.closed")
    key = F.when(by_gateway, F.concat(F.lit("g:"), "gateway_payment_id")).otherwise(F.concat(F.lit("r:"), "provider_ref"))
    asked = events.select(*[F.col(c).alias(f"e_{c}") for c in ("event_key", "event", "at", "amount_minor", "currency", "dispute")], key.alias("_key"))
    keys = F.array(F.concat(F.lit("r:"), "provider_ref"), F.concat(F.lit("g:"), "gateway_payment_id"))
    known = payments.select("payment_id", "amount_minor", "currency", "status", "subscription_id", F.explode(keys).alias("_key")).where("_key is not null")
    last = licences.groupBy("subscription_id").agg(F.max("licence_id").alias("licence_id"))
    rows = asked.join(known, "_key", "left").join(subscriptions.select("subscription_id", "plan", "period_end", F.lit(True).alias("_sub")), "subscription_id", "left").join(last, "subscription_id", "left")
    event, found = F.col("e_event"), F.col("payment_id").isNotNull()
    agrees = F.coalesce(F.col("e_amount_minor") == F.col("amount_minor"), F.lit(True)) & F.coalesce(F.col("e_currency") == F.col("currency"), F.lit(True))
    mutation = (F.when(~found, "none").when(event.isin(*_ACTIVATES) & agrees & ~F.col("status").isin("refunded", "disputed") & F.col("_sub"), "activate")
                .when((event == "payment.failed") & (F.col("status") == "pending"), "fail").when(event.isin(*_ENDS) & F.col("_sub"), "end").when(event.isin(*_REFUNDS), "refund")
                .when(event == "payment.dispute.created", "dispute").when((event == "payment.dispute.closed") & F.col("e_dispute").isin("won", "lost"), "settle").otherwise("none"))
    rows = rows.withColumn("mutation", mutation)
    m, won, halted = F.col("mutation"), F.col("e_dispute") == "won", event == "subscription.halted"
    paid = (F.when(m == "activate", "succeeded").when(m == "fail", "failed").when(m == "refund", "refunded").when(m == "dispute", "disputed").when(m == "settle", F.when(won, "succeeded").otherwise("refunded")))
    state = F.when(m == "activate", "active").when(m == "end", F.when(halted, "suspended").otherwise("cancelled"))
    licence = (F.when(m == "activate", "active").when(m == "end", F.when(halted, "suspended").otherwise("revoked")).when(m == "refund", "revoked").when(m == "dispute", "suspended")
               .when(m == "settle", F.when(won, "active").otherwise("revoked")))
    has = F.col("licence_id").isNotNull()
    end = F.when(m == "activate", plan_end(F.col("plan"), F.col("e_at"))).when(m == "end", F.col("period_end"))
    return rows.select(
        F.col("e_event_key").alias("event_key"), "mutation", F.when(m != "none", F.col("payment_id")).alias("payment_id"), paid.alias("payment_status"), F.when(m.isin("activate", "end"), F.col("subscription_id")).alias("subscription_id"),
        state.alias("subscription_status"), end.alias("period_end"), F.when(m == "activate", F.when(has, "extend").otherwise("insert")).when(licence.isNotNull() & has, "set").alias("licence_change"),
        F.when(licence.isNotNull(), F.col("licence_id")).alias("licence_id"), F.when(has | (m == "activate"), licence).alias("licence_status"))


def with_status(table: DataFrame, key: str, changes: DataFrame, column: str) -> DataFrame:
    """``table`` with ``column`` set to ``changes``' (key, value) where it names the row; the last of several, by (at), counts."""
    new = changes.groupBy(key).agg(F.max_by("value", "at").alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def _limited(key: str, at: str, order: str, burst: int, step: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free = None, 0.0
        for batch in batches:
            out = []
            for k, t in zip(batch["_session"], batch[at]):
                if k != now:
                    now, free = k, float("-inf")
                ok = free - t <= (burst - 1) * step + 1e-9
                if ok:
                    free = max(free, t) + step
                out.append(ok)
            yield batch.drop(columns="_session").assign(allowed=out)
    return run


def limited(requests: DataFrame, key: str, at: str, order: str, per_minute: int) -> DataFrame:
    """Adds ``allowed`` by the cell-rate rule: ``per_minute`` requests at once, then one each 60 / ``per_minute`` seconds; refused ones cost nothing.

    ``at`` is in seconds (double); ties go by ``order``. A minute of silence refills a key, so stretches between silences are independent and
    spread over tasks; a task reads its rows in order and keeps one number.
    """
    # A silence lies between two minutes that have requests, so minutes are all that is looked at in the order of time.
    rows = requests.withColumns({"_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "_minute": F.floor(F.col(at) / 60)})
    minutes = rows.groupBy("_key", "_minute").agg(F.min(at).alias("_from"), F.max(at).alias("_to"))
    minutes = scanned(minutes, ["_key"], "_minute", lasts={"_before": F.col("_to")}).withColumn("_new", F.coalesce((F.col("_from") - F.col("_before") >= 60).cast("int"), F.lit(1)))
    minutes = scanned(minutes, ["_key"], "_minute", sums={"_sessions": F.col("_new")})
    session = F.concat_ws(":", "_key", (F.col("_sessions") + F.col("_new")).cast("string"))
    rows = rows.join(minutes.select("_key", "_minute", session.alias("_session")), ["_key", "_minute"]).select(*requests.columns, "_session")
    schema = T.StructType([*[f for f in requests.schema.fields], T.StructField("allowed", T.BooleanType())])
    sorted_ = rows.repartition("_session").sortWithinPartitions("_session", at, order)
    return sorted_.mapInPandas(_limited(key, at, order, per_minute, 60 / per_minute), schema)
