"""Structured Streaming forms of the window, session, look-back and anchor operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def windowed(stream: DataFrame, by: Sequence[str], time: str, aggregates: Sequence[Column], width: str, step: str | None = None,
             delay: str = "10 minutes", offset: str | None = None) -> DataFrame:
    """Tumbling, or with `step` sliding, windows; late rows beyond the delay go."""
    w = F.window(time, width, step or width, offset) if offset else F.window(time, width, step or width)
    return stream.withWatermark(time, delay).groupBy(*by, w.alias("w")).agg(*aggregates)


def sessions(stream: DataFrame, by: Sequence[str], time: str, gap: str, aggregates: Sequence[Column], delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(*by, F.session_window(time, gap).alias("w")).agg(*aggregates)


def once(stream: DataFrame, keys: Sequence[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Rows without the repeats that arrive within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def lookback(probes: DataFrame, events: DataFrame, key: str, onset: str, time: str, width: str, delay: str = "10 minutes") -> DataFrame:
    """Stream-stream join of each probe with the events of [onset - width, onset)."""
    p, e = probes.withWatermark(onset, delay).alias("p"), events.withWatermark(time, delay).alias("e")
    return p.join(e, F.expr(f"p.{key} = e.{key} AND e.{time} >= p.{onset} - INTERVAL {width} AND e.{time} < p.{onset}"))


class Anchor(StatefulProcessor):
    """One number for each key, with a timer that drops it when the key has been idle."""

    def __init__(self, columns: Sequence[str], order: str, value: str, confidence: str, keep: float, least: float, idle_ms: int | None) -> None:
        self.columns, self.order, self.value, self.confidence = list(columns), order, value, confidence
        self.keep, self.least, self.idle_ms = keep, least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchor = handle.getValueState("anchor", "anchor double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.anchor.get()[0] if self.anchor.exists() else None
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        usable = batch[self.value].notna()
        trusted = usable & (batch[self.confidence] >= self.least)
        found = []
        for v, known, moves in zip(batch[self.value], usable, trusted):
            if held is None:
                held = float(v) if known else None
            elif moves:
                held += (1 - self.keep) * (float(v) - held)
            found.append(held)
        if held is not None:
            self.anchor.update((held,))
            if self.idle_ms is not None:
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield batch[self.columns].assign(anchor=pd.Series(found, index=batch.index, dtype="float64"))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.anchor.clear()
        return iter(())

    def close(self) -> None:
        """Nothing is held outside the state."""


def anchors(stream: DataFrame, by: Sequence[str], order: str, value: str, confidence: str, keep: float = 0.8, least: float = 0.12,
            idle_ms: int | None = None) -> DataFrame:
    """(by, order, anchor): the gated anchor of each key, its state kept between batches.

    Rows of a key in one batch are taken in order; a later batch goes on from the state. Order across batches
    is that of arrival. A key without rows for `idle_ms` loses its state by a timer, so ended sessions take no room. The session's state store
    becomes RocksDB, which this kind of state needs and which keeps it out of the executors' heap.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*by, order)], "anchor double"])
    processor = Anchor([*by, order], order, value, confidence, keep, least, idle_ms)
    return stream.select(*by, order, value, confidence).groupBy(*by).transformWithStateInPandas(
        processor, schema, "append", "none" if idle_ms is None else "processingTime")
