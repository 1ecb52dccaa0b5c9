"""A minimal gap between the requests to a host, kept across micro-batches as state.

A host's state is its next free slot. A request gets the later one of its arrival and that slot. A timer at the slot drops the
state once the watermark has passed it: no request that still can come would have to wait, so expiry changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "id long, host string, arrival_us long, slot_us long"
STORE = "spark.sql.streaming.stateStore.providerClass"


def slots(arrivals: np.ndarray, free: int | None, gap: int) -> np.ndarray:
    """Slots of arrivals in order, the first one not before ``free``."""
    step = np.arange(len(arrivals), dtype=np.int64) * gap
    first = arrivals - step
    if free is not None:
        first[0] = max(first[0], free)
    return np.maximum.accumulate(first) + step


class Throttle(StatefulProcessor):
    """Gives the requests of a host in a micro-batch their slots, by arrival, then id."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free = handle.getValueState("free", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mine = pd.concat(list(rows)).sort_values(["arrival_us", "id"], kind="stable")
        free = self.free.get()[0] if self.free.exists() else None
        at = slots(mine["arrival_us"].to_numpy(np.int64), free, self.gap)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        free = int(at[-1]) + self.gap
        self.free.update((free,))
        self.handle.registerTimer(max(free // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"id": mine["id"].to_numpy(), "host": key[0], "arrival_us": mine["arrival_us"].to_numpy(), "slot_us": at})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.free.clear()
        return iter([])

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that are started inside keep their state in the store that keyed state and timers need."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def throttled_stream(requests: DataFrame, gap_us: int, delay: str = "10 minutes") -> DataFrame:
    """requests (id, host, arrival: timestamp) with the slot that each gets, ``gap_us`` or more after the one before on its host.

    A request that comes after later ones of an earlier micro-batch, but within ``delay``, gets the host's next slot: given slots never
    move. One that is later than that is left out, as the watermark says. Rows without a host or an arrival are left out.
    A micro-batch's requests to one host are ordered in one task, which holds them; the size of a micro-batch bounds that.
    """
    rows = requests.where("host is not null and arrival is not null").select("id", F.col("host").cast("string").alias("host"), "arrival", F.unix_micros("arrival").alias("arrival_us"))
    keyed = rows.withWatermark("arrival", delay).groupBy("host")
    return keyed.transformWithStateInPandas(statefulProcessor=Throttle(gap_us), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
