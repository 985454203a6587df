"""Registered queries of sources, sinks and streams: what they write is written from the driver's tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolens.operators import networks
from aerolens.plans.fixtures import run_sql, view
from aerolens.plans.frames import BEACONS, F_ID, NETWORK_SQL, query
from aerolens.session import shared_dir, staged, table
from aerolens.sources import frames as sinks
from aerolens.streaming import queries as streams
from aerolens.streaming.stateful import run_keyed_stream


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/aerolens-{name}-{uuid.uuid4().hex}"


@query("snk_1_daily", "SELECT CAST(ts AS DATE) AS day, count(*) AS frames, CAST(sum(length) AS BIGINT) AS bytes FROM fx_frames WHERE CAST(ts AS DATE) >= DATE '2024-01-10' GROUP BY 1")
def _(spark, d):
    """Frames written in a folder a day, older days pruned when read."""
    folder = _folder(spark, "daily")
    sinks.write_daily(view(spark, d, "fx_frames"), folder)
    kept = sinks.prune_daily(spark, folder, "2024-01-10")
    return kept.groupBy(F.col("date").alias("day")).agg(F.count("*").alias("frames"), F.sum("length").cast("long").alias("bytes"))


@query("snk_2_routes", "SELECT route, count(*) AS frames FROM (SELECT CASE WHEN dport < 1024 THEN 'system' WHEN sport < 1024 THEN 'reply' ELSE 'other' END AS route FROM fx_frames) AS r WHERE route <> 'other' GROUP BY route")
def _(spark, d):
    """Frames written in a folder a route; two of them are read."""
    from aerolens.operators.filters import route

    folder = _folder(spark, "routed")
    sinks.write_routed(route(view(spark, d, "fx_frames"), [("system", F.col("dport") < 1024), ("reply", F.col("sport") < 1024)], "other"), folder)
    return spark.read.parquet(folder).filter(F.col("route").isin("system", "reply")).groupBy("route").agg(F.count("*").alias("frames"))


@query("snk_3_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def _(spark, d):
    """A keyed table brought up to date in three rounds of changes; the last round's table is the latest of each key."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    current = None
    for part in range(3):
        current = staged(sinks.upsert(current, events.filter(F.col("event_id") % 3 == part), "user_id", "event_id"), "keyed")
    return current


_TAPPED = "CASE frame_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'merged' ELSE 'ip' END"


@query("set_2_queries", f"""WITH t AS (SELECT frame_id, length, retry, dport, {_TAPPED} AS tap FROM fx_frames)
SELECT 'short' AS name, count(*) AS frames, CAST(sum(length) AS BIGINT) AS bytes FROM t WHERE tap = 'raw' AND length < 700
UNION ALL SELECT 'system', count(*), CAST(sum(length) AS BIGINT) FROM t WHERE tap IN ('merged', 'ip') AND NOT (tap = 'merged' AND retry) AND dport < 20000
UNION ALL SELECT 'all', count(*), CAST(sum(length) AS BIGINT) FROM t WHERE tap IN ('raw', 'merged')""")
def _(spark, d):
    """Three queries over one streaming read of the frames, written batch by batch and read back."""
    tapped = view(spark, d, "fx_frames").select(F_ID, "length", "dport", F.col("retry").alias("is_dupe"), F.expr(_TAPPED).alias("tap"))
    folder = _folder(spark, "frames")
    tapped.write.parquet(folder)
    rows = lambda df: df.select(F_ID, "length")
    wanted = [
        streams.StreamQuery("short", rows, ["raw"], F.col("length") < 700),
        streams.StreamQuery("system", rows, ["merged", "ip"], F.col("dport") < 20_000),
        streams.StreamQuery("all", rows, ["raw", "merged"], dupes=True),
    ]
    out = _folder(spark, "queries")
    streams.fan_out(spark.readStream.schema(tapped.schema).parquet(folder), wanted, out, _folder(spark, "checkpoint")).awaitTermination()
    found = [spark.read.parquet(f"{out}/{q.name}").select(F.lit(q.name).alias("name"), "length") for q in wanted]
    both: DataFrame = found[0].unionByName(found[1]).unionByName(found[2])
    return both.groupBy("name").agg(F.count("*").alias("frames"), F.sum("length").cast("long").alias("bytes"))


@query("str_11_intervals", "SELECT US(ts) // 86400000000 * 86400000000 AS start_us, bssid, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM fx_frames GROUP BY 1, 2")
def _(spark, d):
    out = streams.interval_stream(view(spark, d, "fx_frames"), ["bssid"], "1 day")
    return out.select(F.unix_micros("start").alias("start_us"), "bssid", "packets", F.col("bytes").cast("long").alias("bytes"))


CUT = "TIMESTAMP '2024-01-12 00:00:00'"


@query("str_13_warm", f"WITH RECURSIVE {NETWORK_SQL} SELECT CAST(bssid AS VARCHAR) AS bssid, frame_id, e.event AS event, e.old AS old, e.new AS new, e.changed AS changed, e.odd AS odd FROM (SELECT bssid, frame_id, unnest(events) AS e FROM s WHERE ts >= {CUT}) AS x")
def _(spark, d):
    """Networks known from the rows before a time, and a stream that goes on from there with the rows after it."""
    rows = run_sql(spark, d, BEACONS.replace("//", "div")).withColumns({c: F.col(c).cast("string") for c in ("bssid", "ta")})
    known = staged(networks.network_state(rows.filter(f"ts < {CUT}")), "networks")
    told = networks.descriptions(rows.filter(f"ts >= {CUT}"))[0]
    folder, out = _folder(spark, "beacons"), _folder(spark, "events")
    told.write.parquet(folder)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(told.schema).parquet(folder)
        events = run_keyed_stream(stream, ["bssid"], ["ts", "frame_id"], networks.network_step(), networks.EVENTS, initial=known, warm=networks.known_network)
        events.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(networks.EVENTS).parquet(out).drop("ts")
