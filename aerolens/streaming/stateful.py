"""Keyed steps on streams: transformWithStateInPandas around the step functions of operators.state."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from aerolens.operators.state import Step


class KeyedStep(StatefulProcessor):
    """Runs a step over the rows of a key in order and keeps its state.

    ttl_ms ends a state by the clock (0: never). expire_ms ends it by event time
    instead: when the watermark has passed the key's latest time by that much, a
    timer puts out what finish gives and clears the state. Rows more than late_ms
    before the latest time that earlier batches brought are late: they are
    counted in the state and, unless drop_late, take part. warm makes the first
    state of a key from its row in the initial table.
    """

    def __init__(self, step: Step, order: Sequence[str], columns: Sequence[str], ttl_ms: int = 0, warm: Callable[[dict], Any] | None = None, *, ts: str = "ts", expire_ms: int | None = None, finish: Callable[[Any], list[dict]] = lambda state: [], late_ms: int | None = None, drop_late: bool = False) -> None:
        self.step, self.order, self.columns, self.ttl_ms, self.warm = step, list(order), list(columns), ttl_ms, warm
        self.ts, self.expire_ms, self.finish, self.late_ms, self.drop_late = ts, expire_ms, finish, late_ms, drop_late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value binary", self.ttl_ms or None)
        if self.expire_ms is not None or self.late_ms is not None:
            self.times = handle.getValueState("times", "high long, late long", self.ttl_ms or None)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.to_dict("records"):
            self.state.update((pickle.dumps(self.warm(row)),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        if self.expire_ms is not None or self.late_ms is not None:
            batch = self._timed(batch)
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        state, out = self.step(state, batch.to_dict("records"))
        self.state.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=self.columns)

    def _timed(self, batch: pd.DataFrame) -> pd.DataFrame:
        """The rows to take in; what is known of the key's times and its timer are brought up to date."""
        high, late = self.times.get() if self.times.exists() else (None, 0)
        ms = batch[self.ts].astype("datetime64[ms]").astype("int64")
        if self.late_ms is not None and high is not None:
            behind = ms < high - self.late_ms
            late += int(behind.sum())
            if self.drop_late:
                batch = batch[~behind]
        latest = max(int(ms.max()), high if high is not None else int(ms.max()))
        self.times.update((latest, late))
        if self.expire_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + self.expire_ms)
        return batch

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.finish(pickle.loads(self.state.get()[0])) if self.state.exists() else []
        self.state.clear()
        # late rows of an ended key stay counted
        self.times.update((self.times.get()[0], self.times.get()[1]))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def run_keyed_stream(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str, ttl_ms: int = 0, initial: DataFrame | None = None, warm: Callable[[dict], Any] | None = None,
    *, ts: str = "ts", watermark: str | None = None, expire_seconds: float | None = None, finish: Callable[[Any], list[dict]] = lambda state: [], late_seconds: float | None = None, drop_late: bool = False,
) -> DataFrame:
    """Stream form of operators.state.run_keyed; needs the RocksDB state store.

    initial is a table of what an earlier run knew, one row a key, and warm
    turns such a row into a state, so a stream need not start cold. With
    expire_seconds a key ends by event time and finish gives its last rows; the
    watermark says how far behind the latest time of all rows may come, and Spark
    drops what comes later. late_seconds counts the rows of a key that come
    later than that after its latest time (see late_counts); they pass unless
    drop_late.
    """
    columns = [f.split()[0] for f in schema.split(", ")]
    ms = lambda seconds: None if seconds is None else int(1000 * seconds)
    processor = KeyedStep(step, order, columns, ttl_ms, warm, ts=ts, expire_ms=ms(expire_seconds), finish=finish, late_ms=ms(late_seconds), drop_late=drop_late)
    first = None if initial is None else initial.groupBy(*keys)
    if expire_seconds is not None:
        df = df.withWatermark(ts, watermark or "0 seconds")
    mode = "eventTime" if expire_seconds is not None else "processingTime" if ttl_ms else "none"
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", mode, first)


def late_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, late: how many rows of each key came late, from a stream's checkpoint; keys without any are left out."""
    states = spark.read.format("statestore").option("stateVarName", "times").load(checkpoint)
    return states.selectExpr("key", "value.late AS late").filter("late > 0")


def flush(spark: SparkSession, checkpoint: str, finish: Callable[[Any], list[dict]], schema: str) -> DataFrame:
    """What the states of a stream would put out if they ended now, read from its checkpoint; the stream itself goes on.

    finish is that of the batch form: it gives the rows that a state still holds.
    """
    columns = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row for value in batch["value"] for row in finish(pickle.loads(value))], columns=columns)

    states = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
    return states.selectExpr("value.value AS value").mapInPandas(run, schema)
