"""Projections of frames: bytes cut off, merged frames as text, shifted times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_tail(raw: Column, n: int = 4) -> Column:
    """Without the last n bytes, the checksum."""
    return F.substring(raw, F.lit(1), F.greatest(F.length(raw) - n, F.lit(0)))


def strip_to_header(raw: Column, header: int = 24) -> Column:
    return F.substring(raw, 1, header)


def drop_members(merged: DataFrame) -> DataFrame:
    """Merged frames without their captures."""
    return merged.drop("members", "is_dupe")


def print_merged(merged: DataFrame, detailed: bool = False) -> DataFrame:
    """One line a merged frame, or a capture where detailed."""
    head = F.format_string("%d ts=%d chan=%d n=%d%s", "frame_id", "ts_us", "channel", F.size("members"), F.when(F.col("is_dupe"), F.lit(" dupe")).otherwise(F.lit("")))
    if not detailed:
        return merged.select("frame_id", head.alias("line"))
    rows = merged.select("frame_id", "ts_us", F.explode("members").alias("m"))
    line = F.format_string("%d sniffer=%d dt=%d chan=%d rssi=%d noise=%d", "frame_id", "m.sniffer_id", F.col("m.ts_us") - F.col("ts_us"), "m.channel", "m.rssi", "m.noise")
    return rows.select("frame_id", line.alias("line"))


def shift_time(df: DataFrame, delta_us: int, ts: str = "ts", now: Column | None = None) -> DataFrame:
    """All times moved by delta; 0 moves the first frame to now."""
    if delta_us:
        return df.withColumn(ts, F.timestamp_micros(F.unix_micros(ts) + delta_us))
    first = df.agg(F.min(F.unix_micros(ts))).scalar()
    return df.withColumn(ts, F.timestamp_micros(F.unix_micros(ts) - first + F.unix_micros(now if now is not None else F.current_timestamp())))
