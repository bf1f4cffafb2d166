"""Structured Streaming: the replay ring as keyed state, and running metrics.

The ring keeps, per key (a worker's rank), a write count and the last
``capacity`` rows, one slot each, in a state store on disk; a micro-batch
writes only the slots that it touches, and the state stays bounded by
``capacity`` rows a key, whatever the stream's length. The buffer is read from
the checkpoint (``contents``), so samplers need no copy of it. Exactly-once
sinks come from ``foreachBatch`` with the batch id (``regenerate`` below).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Setting and value that the ring's kind of state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Ring(StatefulProcessor):
    def __init__(self, key: str, order: str, value: str, capacity: int):
        self.names, self.capacity = (key, order, value), capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.written = handle.getValueState("written", "n bigint")
        self.slots = handle.getMapState("slots", "slot bigint", "value bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        name, order, value = self.names
        before = int(self.written.get()[0]) if self.written.exists() else 0
        n, last = 0, None
        for some in rows:
            # Of the rows that share a slot only the last stays: no more than ``capacity`` are held.
            n += len(some)
            some = some[[order, value]] if last is None else pd.concat([last, some[[order, value]]])
            last = some.sort_values([order, value]).tail(self.capacity)
        if last is None:
            return
        at = [(before + n - len(last) + i) % self.capacity for i in range(len(last))]
        kept = [int(v) for v in last[value]]
        for slot, v in zip(at, kept):
            self.slots.updateValue((slot,), (v,))
        self.written.update((before + n,))
        yield pd.DataFrame({name: [key[0]] * len(at), "slot": at, value: kept})

    def close(self) -> None:
        pass


def ring(rows: DataFrame, key: str, order: str, value: str, capacity: int) -> DataFrame:
    """After each batch: (key, slot, value) of the slots that it wrote. ``order`` and ``value`` are bigint columns. The session needs ``STORE``."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, order, value).groupBy(key).transformWithStateInPandas(_Ring(key, order, value, capacity), f"{key} {kind}, slot bigint, {value} bigint", "Update", "None")


def contents(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, slot, value) of every ring as the last committed batch left it, from the checkpoint of its query."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "slots").load()
    return state.select("key.*", F.col("user_map_key.slot").alias("slot"), F.col("user_map_value.value").alias("value"))


def read_slots(held: DataFrame, key: str, step: int, size: int) -> DataFrame:
    """The ``step``-th run of ``size`` slots of every ring, from the start again behind the end: (key, place, slot, value)."""
    n = held.groupBy(F.col(key).alias("of")).agg(F.count("*").alias("n"))
    wanted = n.select("of", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("place"), "n").withColumn("at", F.pmod(F.lit(step * size) + F.col("place"), F.col("n")))
    return held.join(wanted, (F.col(key) == F.col("of")) & (F.col("slot") == F.col("at"))).select(key, "place", "slot", "value")


def running_means(rows: DataFrame, ts: str, key: str, value: str, interval: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean of each metric per log interval (an extension of the batch form).

    Events whose interval had ended ``late`` before the newest event of the
    batches before are left out: run it in ``update`` or ``append`` mode,
    ``complete`` mode would keep every interval open.
    """
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, interval).alias("w"), key).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "mean", "n")


def regenerate(rows: DataFrame, every: int, fill: Callable[[DataFrame, int], None], reuse: Callable[[DataFrame, int], None], checkpoint: str, held: Callable[[], int] = lambda: 1):
    """Start a query that refills the buffer on every ``every``-th batch, or when it ``held`` nothing, and samples it on the others."""

    def step(batch: DataFrame, number: int) -> None:
        (fill if number % every == 0 or held() == 0 else reuse)(batch, number)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
