"""Continuous queries: a registry of DataFrame functions over shared streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aerolens.operators.filters import select_taps, shared_filter

TAPS = ("raw", "aggregated", "merged", "ip", "tcp")


@dataclass
class StreamQuery:
    """name, what it reads (taps, packet filter, duplicates or not) and what it computes."""

    name: str
    transform: Callable[[DataFrame], DataFrame]
    taps: Sequence[str] = ("raw",)
    filter: Column | None = None
    dupes: bool = False
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        unknown = set(self.taps) - set(TAPS)
        if unknown:
            raise ValueError(f"unknown taps: {sorted(unknown)}")

    def plan(self, frames: DataFrame) -> DataFrame:
        rows = select_taps(frames, self.taps, self.dupes)
        return self.transform(rows if self.filter is None else rows.filter(self.filter))


def plans(frames: DataFrame, queries: Sequence[StreamQuery]) -> dict[str, DataFrame]:
    """Each query over the frames that any of them wants."""
    wanted = shared_filter(frames, [q.filter for q in queries])
    return {q.name: q.plan(wanted) for q in queries}


def start(frames: DataFrame, queries: Sequence[StreamQuery], path: str, checkpoint: str, **trigger) -> list[StreamingQuery]:
    """One streaming write per query, into a Parquet folder of its own."""
    return [
        df.writeStream.queryName(name).format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
        for name, df in plans(frames, queries).items()
    ]


def fan_out(frames: DataFrame, queries: Sequence[StreamQuery], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """All queries over one read of the stream: each micro-batch is kept while every query writes its part.

    For queries that look at one row at a time. A query's rows lie in
    path/name/batch=number and take the place of what an earlier try of the same
    batch left, so a restart writes nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for q in queries:
                q.plan(batch).write.mode("overwrite").parquet(f"{path}/{q.name}/batch={number}")
        finally:
            batch.unpersist()

    wanted = shared_filter(frames, [q.filter for q in queries])
    return wanted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def interval_stream(frames: DataFrame, keys: Sequence[str], interval: str = "300 seconds", late: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Packets and bytes of each key and event-time interval; rows later than the watermark are dropped by Spark."""
    w = frames.withWatermark(ts, late).groupBy(F.window(ts, interval).alias("w"), *keys)
    return w.agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).select(F.col("w.start").alias("start"), *keys, "packets", "bytes")


def unique_stream(frames: DataFrame, keys: Sequence[str], within: str = "1 hour", ts: str = "ts") -> DataFrame:
    """First occurrences of keys within a time."""
    return frames.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def session_stream(requests: DataFrame, keys: Sequence[str], gap: str = "20 minutes", late: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Request sessions of each key."""
    out = requests.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("requests"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "requests")


def upsert_stream(changes: DataFrame, path: str, key: str, version: str, checkpoint: str) -> StreamingQuery:
    """Keep a keyed table: each micro-batch is merged into the last version's folder and written as the next."""
    from aerolens.sources.frames import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={number - 1}") if number else None
        upsert(old, batch, key, version).write.mode("overwrite").parquet(f"{path}/v={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
