"""Request limits on a stream: one number of state a key, and a timer that forgets it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Cells(StatefulProcessor):
    """Holds the time at which a key's next request is free of charge; forgets it a minute after its last request."""

    def __init__(self, key: str, at: str, order: str, per_minute: int) -> None:
        self.key, self.at, self.order, self.burst, self.step = key, at, order, per_minute, 60 / per_minute

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free = handle.getValueState("free", StructType([StructField("free", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.at, self.order], kind="stable")
        free = self.free.get()[0] if self.free.exists() else float("-inf")
        allowed = []
        for t in batch[self.at]:
            ok = free - t <= (self.burst - 1) * self.step + 1e-9
            if ok:
                free = max(free, t) + self.step
            allowed.append(ok)
        self.free.update((free,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((batch[self.at].max() + 60) * 1000))
        yield batch[[self.key, self.order, self.at]].assign(allowed=allowed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.free.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, key: str, at: str, order: str, time: str, per_minute: int, delay: str = "1 minute") -> DataFrame:
    """P3 as a stream: (key, order, at, allowed) by the rule of ``payments.limited``.

    ``requests`` is a stream whose batches follow each other in time, with ``at`` in seconds and the same instant as a timestamp in ``time``. A batch's rows of a key are
    put in order by (at, order). Keys are forgotten when the watermark, ``delay`` behind the latest request of all, is a minute past their last one: by then they have all of their
    requests again. Rows later than the watermark are dropped. State is kept in RocksDB, which this needs.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    schema = requests.select(key, order, at).schema.add("allowed", "boolean")
    rows = requests.withWatermark(time, delay).groupBy(key)
    return rows.transformWithStateInPandas(statefulProcessor=_Cells(key, at, order, per_minute), outputStructType=schema, outputMode="Append", timeMode="EventTime")
