"""Exact bursts on a stream: the rows of `operators.bursts.ping_burst`, whatever the order of arrival.

Time is cut into cells as wide as the window, as in the batch operator, and a
cell's first `threshold` rows are enough. A cell is settled by a timer once the
watermark has passed its end; only then are its rows in their final order. The
event time of a row is the end of its cell, so that a cell is late as a whole
and rows may be thinned before the shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from flowspark.functions.time import SECOND, cell_of
from flowspark.operators import filters

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# State with timers needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _cell_end_ms(cell: int, window_us: int) -> int:
    return -(-(cell + 1) * window_us // 1000)


class FirstBurst(StatefulProcessor):
    """Per key: the open cells' first times, the last times of settled cells, and whether the burst was found."""

    def __init__(self, keys: Sequence[str], threshold: int, window_us: int):
        self.keys, self.threshold, self.window_us = list(keys), threshold, window_us

    def init(self, handle) -> None:
        self.handle = handle
        self.found = handle.getValueState("found", "found boolean")
        self.settled = handle.getValueState("settled", "cell bigint, times array<bigint>")
        self.open = handle.getMapState("open", "cell bigint", "times array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[int]] = {}
        for frame in rows:
            for cell, time in zip(frame["burst_cell"].tolist(), frame["ts_us"].tolist()):
                times = new.setdefault(cell, [])
                times.append(time)
                if len(times) > 4 * self.threshold:
                    new[cell] = sorted(times)[: self.threshold]
        if new and not self.found.exists():
            settled = self.settled.get()
            for cell, times in new.items():
                # A cell that was settled is never opened again.
                if settled is not None and cell <= settled[0]:
                    continue
                held = self.open.getValue((cell,)) if self.open.containsKey((cell,)) else None
                if held is None:
                    self.handle.registerTimer(_cell_end_ms(cell, self.window_us))
                self.open.updateValue((cell,), (sorted([*(held[0] if held else ()), *times])[: self.threshold],))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.found.exists():
            return
        passed = timerValues.getCurrentWatermarkInMs()
        ready = sorted(cell[0] for cell in self.open.keys() if _cell_end_ms(cell[0], self.window_us) <= passed)
        if not ready:
            return
        settled = self.settled.get()
        run = list(settled[1]) if settled is not None else []
        span = self.threshold - 1
        for cell in ready:
            run += self.open.getValue((cell,))[0]
            for end in range(span, len(run)):
                if run[end] - run[end - span] <= self.window_us:
                    self.found.update((True,))
                    self.open.clear()
                    self.settled.clear()
                    yield pd.DataFrame([[*key, run[end - span], run[end], self.threshold]], columns=[*self.keys, "start_us", "end_us", "count"])
                    return
            run = run[len(run) - span :] if len(run) > span else run
            self.open.removeKey((cell,))
        self.settled.update((ready[-1], run))


def _thinned(keys: Sequence[str], threshold: int):
    """The first `threshold` rows of each key and cell of each batch that a task holds."""

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values("ts_us", kind="stable").groupby([*keys, "burst_cell"], dropna=False, sort=False).head(threshold)

    return thin


def stream_ping_bursts(
    flows: DataFrame, threshold: int = 5, window_us: int = 5 * SECOND, keys: Sequence[str] = ("dst_ip",), delay_us: int = 60 * SECOND
) -> DataFrame:
    """First burst of echo requests per target on a stream: `start_us`, `end_us`, `count`, as `ping_burst` gives them.

    A burst is given once, when no flow that is at most `delay_us` behind the
    newest one can come before it. Later flows are dropped, whole cells of time
    at once. Flows without a time are no part of a burst. A key's state is at
    most `threshold` times for each of its cells in `delay_us`, and one flag
    once its burst is known.
    """
    flows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kinds = dict(flows.dtypes)
    rows = filters.echo_by_type(flows).filter(F.col("ts_us").isNotNull()).select(*keys, "ts_us", cell_of("ts_us", window_us).alias("burst_cell"))
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    thinned = rows.mapInPandas(_thinned(keys, threshold), f"{named}, ts_us bigint, burst_cell bigint")
    end = F.timestamp_millis(F.ceil((F.col("burst_cell") + 1) * window_us / 1000).cast("bigint"))
    timed = thinned.withColumn("cell_end", end).withWatermark("cell_end", f"{delay_us + window_us} microseconds")
    return timed.groupBy(*keys).transformWithStateInPandas(
        FirstBurst(keys, threshold, window_us),
        outputStructType=f"{named}, start_us bigint, end_us bigint, count bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
