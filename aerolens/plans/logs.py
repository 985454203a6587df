"""Registered queries of logs, typed tables and metric series; their SQL reads the text of the lines itself."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolens.functions import metrics
from aerolens.plans.fixtures import run_sql, view
from aerolens.plans.frames import query

#: The host that all others send to.
SERVER = "server"


def _sql(text: str) -> str:
    """S(key), L(key), D(key): the field of a line as text, integer and number, as DuckDB reads it."""
    field = lambda key: "nullif(trim(regexp_extract(data, '(?:^|\\s)" + re.sub("[-_]", "[-_]", key) + "=(\"[^\"]*\"|[^\\s\"]*)', 1), '\"'), '')"
    text = re.sub(r"\bS\(([\w-]+)\)", lambda m: field(m[1]), text)
    text = re.sub(r"\bL\(([\w-]+)\)", lambda m: f"TRY_CAST({field(m[1])} AS BIGINT)", text)
    return re.sub(r"\bD\(([\w-]+)\)", lambda m: f"TRY_CAST({field(m[1])} AS DOUBLE)", text)


# --- reading logs

LINES = "SELECT event_id, event_id % 7 AS file, CASE WHEN event_id % 19 = 7 THEN NULL WHEN event_id % 19 = 8 THEN concat(level, ' ', data) WHEN event_id % 19 = 9 THEN concat('Feb 30 10:00:00.000 ', source, ' ', level, ' ', data) ELSE concat(LOGTIME(ts), ' ', source, ' ', level, CASE WHEN event_id % 2 = 0 THEN ': ' ELSE '   ' END, data) END AS value FROM fx_loglines"
_GOOD = "value IS NOT NULL AND event_id % 19 NOT IN (8, 9)"


@query("src_5_log", f"SELECT l.event_id, US(ts) // 1000 * 1000 AS us, source, level, data FROM fx_loglines AS l JOIN ({LINES}) AS v ON v.event_id = l.event_id WHERE value IS NOT NULL AND l.event_id % 19 NOT IN (8, 9)")
def _(spark, d):
    entries, _ = metrics.parse_log(run_sql(spark, d, LINES), F.lit("2024-02-01").cast("timestamp"))
    return entries.select("event_id", F.unix_micros("ts").alias("us"), "source", "level", "data")


@query("src_5_rejects", f"SELECT value, count(*) AS n FROM ({LINES}) AS v WHERE NOT ({_GOOD}) GROUP BY value")
def _(spark, d):
    return metrics.parse_log(run_sql(spark, d, LINES), F.lit("2024-02-01").cast("timestamp"))[1].groupBy("value").agg(F.count("*").alias("n"))


def _merged(spark, d, least: int) -> DataFrame:
    logs = view(spark, d, "fx_loglines")
    both = logs.filter("source like 'wifi%'").unionByName(logs.filter("source not like 'wifi%'")).withColumn("rank", metrics.level_rank(F.col("level")))
    return both.filter(F.col("rank") >= least).orderBy("ts", "event_id").select("event_id", "ts", "data")


@query("srt_5_log_merge", "SELECT event_id, ts, data FROM fx_loglines WHERE level IN ('INFO', 'WARN', 'ERR', 'CRIT') ORDER BY ts, event_id")
def _(spark, d):
    return _merged(spark, d, 2)


@query("srt_5_log_merge_all", "SELECT event_id, ts, data FROM fx_loglines ORDER BY ts, event_id")
def _(spark, d):
    return _merged(spark, d, 0)


# lines of a file come out of order by up to some hours
ARRIVALS = "SELECT event_id, event_id % 7 AS file, ts, US(ts) + (event_id * 7919) % 20000 * 1000000 AS arrival FROM fx_loglines"


@query("srt_2_log_order", f"WITH e AS ({ARRIVALS}), r AS (SELECT *, US(ts) AS us, row_number() OVER (PARTITION BY file ORDER BY arrival, event_id) AS line, max(US(ts)) OVER (PARTITION BY file ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) AS top FROM e), p AS (SELECT *, (SELECT min(n.line) FROM r AS n WHERE n.file = r.file AND n.line >= r.line AND n.top >= r.us + 3600000000) AS leaves FROM r) SELECT event_id, row_number() OVER (PARTITION BY file ORDER BY leaves NULLS LAST, us, line) AS place FROM p")
def _(spark, d):
    entries = run_sql(spark, d, ARRIVALS).withColumn("line", F.struct("arrival", "event_id"))
    return metrics.log_order(entries, ["file"], arrival="line", window_seconds=3600).select("event_id", F.col("place").cast("long").alias("place"))


@query("fn_12_kv", _sql("SELECT event_id, S(host) AS host, S(kern-recv) AS recv, S(query) AS query FROM fx_loglines"))
def _(spark, d):
    rows = metrics.with_fields(view(spark, d, "fx_loglines"))
    field = lambda k: F.try_element_at("fields", F.lit(k))
    return rows.select("event_id", field("host").alias("host"), field("kern-recv").alias("recv"), field("query").alias("query"))


# --- typed tables

#: Per table: the test of its entries, the keys of its reports, and its columns.
_TABLES = {
    "pcap_stats": ("source = 'pcap' AND data LIKE 'STATS %'", "S(host)", "S(host) AS host, L(kern-recv) AS kernel_recv, L(kern-drop) AS kernel_drop, L(mem-drop) AS mem_drop, L(pre-capt-pkts) AS all_capt_packets, L(pre-capt-bytes) AS all_capt_bytes, L(post-capt-pkts) AS filt_capt_packets, L(post-capt-bytes) AS filt_capt_bytes"),
    "query_stats": ("source = 'queries' AND data LIKE 'STATS %'", "S(host), S(query)", "S(host) AS host, S(query) AS query, L(in-pkts) AS in_packets, L(out-pkts) AS out_msgs, L(out-bytes) AS out_bytes, L(drop-pkts) AS dropped_msgs"),
    "toserver_query_stats": ("source = 'to_server' AND data LIKE 'STATS %'", "S(host)", "S(host) AS host, S(query) AS query, L(count) AS dequeued_msgs, L(bytes) AS dequeued_bytes"),
    "toserver_output_stats": ("source = 'to_server' AND data LIKE 'OUT-STATS %'", "S(host)", "S(host) AS host, L(count) AS sent_msgs, L(bytes) AS sent_bytes, D(avg-compress-rate) AS compress_rate, D(avg-compress-size) AS avg_compress_size, D(avg-cpu) AS avg_cpu"),
    "overlay_sniffer_stats": ("source = 'wifi_ol' AND data LIKE 'STATS %'", "S(host)", "S(host) AS host, L(routes) AS total_routes, L(self-routes) AS self_routes, L(no-route-pkts) AS no_route_packets, L(unclassified) AS unclassified_packets, L(bcast-pkts) AS bcast_packets, L(waitq-drops) AS waitq_dropped_msgs, L(waitq-drop-bytes) AS waitq_dropped_bytes, L(ttl-drops) AS ttl_dropped_msgs, L(ttl-drop-bytes) AS ttl_dropped_bytes, L(from-self-pkts) AS from_self_packets, L(from-peers-pkts) AS from_peers_packets, L(recv) AS net_recv_msgs, L(recv-bytes) AS net_recv_bytes"),
    "overlay_server_stats": ("source LIKE 'wifi#_ol#__%' ESCAPE '#' AND data LIKE 'STATS %'", "S(host)", "S(host) AS host, substr(source, 9) AS testbed, L(routes) AS total_routes"),
    "overlay_server_sockrecv": ("source = 'ol_in_proxy' AND data LIKE 'STATS %'", "S(host)", "S(host) AS host, L(recv) AS net_recv_msgs, L(recv-bytes) AS net_recv_bytes"),
    "overlay_peer_input_stats": ("source LIKE 'wifi#_ol%' ESCAPE '#' AND data LIKE 'IN-STATS %'", "S(host)", "S(host) AS host, S(peer) AS peer, L(in-pkts) AS recv_packets, L(in-ctrl) AS recv_ctrl_msgs, L(in-bytes) AS recv_bytes"),
    "overlay_peer_output_stats": ("source LIKE 'wifi#_ol%' ESCAPE '#' AND data LIKE 'OUT-STATS %'", "S(host)", "S(host) AS host, S(peer) AS peer, L(queued-pkts) AS enqueued_packets, L(queued-ctrl) AS enqueued_ctrl_msgs, L(queued-bytes) AS enqueued_bytes, L(queued-reroutes) AS enqueued_reroute_msgs, L(drop-pkts) AS dropped_packets, L(drop-ctrl) AS dropped_ctrl_msgs, L(drop-bytes) AS dropped_bytes, L(out-all) AS dequeued_msgs, L(send-bytes) AS sent_bytes, D(compress-rate) AS compress_rate, D(avg-compress-size) AS avg_compress_size, D(avg-cpu) AS avg_cpu"),
}


def _table_sql(test: str, keys: str, columns: str) -> str:
    names = re.findall(r" AS (\w+)", columns)
    whole = " AND ".join(f"{n} IS NOT NULL" for n in names)
    first = ", ".join(names[: keys.count("S(")])
    return _sql(f"WITH t AS (SELECT event_id, US(ts) AS us, {columns} FROM fx_loglines WHERE {test}), d AS (SELECT *, coalesce(CAST(floor((us - lag(us) OVER (PARTITION BY {first} ORDER BY us, event_id)) / 1000) AS BIGINT), 10000) AS duration_msec FROM t) SELECT event_id, {', '.join(names)}, duration_msec FROM d WHERE {whole}")


def _table(name: str):
    def run(spark, d):
        good, _ = metrics.typed_table(view(spark, d, "fx_loglines"), metrics.TABLES[name], order=["event_id"])
        return good.drop("ts")

    return run


for _name, _parts in _TABLES.items():
    query("met_1_pcap" if _name == "pcap_stats" else f"met_1_{_name}", _table_sql(*_parts))(_table(_name))


@query("met_1_rejects", _sql("SELECT event_id FROM fx_loglines WHERE source = 'pcap' AND data LIKE 'STATS %' AND (S(host) IS NULL OR L(kern-recv) IS NULL OR L(kern-drop) IS NULL OR L(mem-drop) IS NULL OR L(pre-capt-pkts) IS NULL OR L(pre-capt-bytes) IS NULL OR L(post-capt-pkts) IS NULL OR L(post-capt-bytes) IS NULL)"))
def _(spark, d):
    return metrics.typed_table(view(spark, d, "fx_loglines"), metrics.TABLES["pcap_stats"])[1].select("event_id")


# --- metrics

_PCAP = "source IN ('pcap', 'script') AND data LIKE 'STATS %'"
_OL = "source = 'wifi_ol' AND data LIKE 'STATS %'"
_SYS = "source = 'system' AND data LIKE 'SYSINFO %'"
_SELF = "source = 'wifi_ol' AND data LIKE 'NET-USAGE %'"
_RECORDS = "list_filter(string_split(data, '|'), lambda r: regexp_extract(r, 'src=(\\S+)', 1) = regexp_extract(r, 'dst=(\\S+)', 1))"
_SELF_SUM = lambda key: f"CASE WHEN len({_RECORDS}) > 0 THEN list_sum(list_transform({_RECORDS}, lambda r: coalesce(TRY_CAST(regexp_extract(r, '{key}=(\\S+)', 1) AS DOUBLE), 0))) END"
_RATE, _KBIT = "/ 10.0", "* 8 / (1024 * 10.0)"

#: Metric: the test of its entries, host and value. Those of routes belong to the server.
_METRICS = {
    "cpu": (_SYS, "S(host)", "D(cpu-10)"), "mem": (_SYS, "S(host)", "D(maxrss-kb) / 1024"), "alloc-pkts": (_SYS, "S(host)", "TRY_CAST(split_part(S(alloc-pkts), '/', 1) AS DOUBLE)"), "alloc-payloads": (_SYS, "S(host)", "TRY_CAST(split_part(S(alloc-pkts), '/', 1) AS DOUBLE)"),
    "mem-drops": (_PCAP, "S(host)", f"D(mem-drop) {_RATE}"), "kern-recv": (_PCAP, "S(host)", f"D(kern-recv) {_RATE}"), "kern-drops": (_PCAP, "S(host)", f"D(kern-drop) {_RATE}"), "pcap-bytes": (_PCAP, "S(host)", f"D(pre-capt-bytes) {_KBIT}"), "pcap-pkts": (_PCAP, "S(host)", f"D(pre-capt-pkts) {_RATE}"),
    "captured-bytes": (_PCAP, "S(host)", f"D(post-capt-bytes) {_KBIT}"), "captured-pkts": (_PCAP, "S(host)", f"D(post-capt-pkts) {_RATE}"),
    "log-queue-drops": ("source IN ('pcap', 'script') AND data LIKE 'APP-STATS %'", "S(host)", f"D(log-qdrops) {_RATE}"), "pkt-queue-drops": ("source IN ('pcap', 'script') AND data LIKE 'APP-STATS %'", "S(host)", f"D(pkt-qdrops) {_RATE}"),
    "no-route-pkts": (_OL, "S(host)", "D(no-route-pkts)"), "overlay-drops": (_OL, "S(host)", f"D(drops) {_RATE}"), "overlay-drop-bytes": (_OL, "S(host)", f"D(drop-bytes) {_KBIT}"), "overlay-waitq-drops": (_OL, "S(host)", f"D(waitq-drops) {_RATE}"), "overlay-waitq-drop-bytes": (_OL, "S(host)", f"D(waitq-drop-bytes) {_KBIT}"),
    "overlay-produced": (_OL, "S(host)", f"D(out-pkts) {_RATE}"), "overlay-bytes-in": ("source = 'wifi_ol' AND data LIKE 'IN-STATS %'", "S(host)", f"D(in-bytes) {_KBIT}"), "overlay-bytes-out": ("source = 'wifi_ol' AND data LIKE 'OUT-STATS %'", "S(host)", f"D(send-bytes) {_KBIT}"),
    "overlay-bytes-self": (_SELF, "S(src)", f"{_SELF_SUM('capt_bytes')} {_KBIT}"), "overlay-pkts-self": (_SELF, "S(src)", f"{_SELF_SUM('capt_pkts')} {_RATE}"),
    "overlay-pkts-in": ("source = 'wifi_ol' AND data LIKE 'IN-STATS %'", "S(host)", f"(D(in-pkts) + D(in-ctrl)) {_RATE}"), "overlay-pkts-out": ("source = 'wifi_ol' AND data LIKE 'OUT-STATS %'", "S(host)", f"D(out-all) {_RATE}"), "ol-waitq-drops": (_OL, "S(host)", f"D(waitq-drops) {_RATE}"),
    "to-server": ("source IN ('to_server', 'net_proxy') AND data LIKE 'STATS %'", "S(host)", f"(D(bytes) + D(count) * 88) * 0.35 {_KBIT}"), "assigned-bssids": (_OL, "S(host)", "D(self-routes)"),
    "route-additions": ("source = 'wifi_ol'", f"'{SERVER}'", "TRY_CAST(regexp_extract(data, '^created (\\d+) new routes; updated (\\d+) routes', 1) AS DOUBLE)"), "route-changes": ("source = 'wifi_ol'", f"'{SERVER}'", "TRY_CAST(regexp_extract(data, '^created (\\d+) new routes; updated (\\d+) routes', 2) AS DOUBLE)"),
    "merge-rate": ("source = 'wifi_merge' AND data LIKE 'STATS %'", "S(host)", "CASE WHEN D(out-merges) <> 0 THEN D(avg-merge) END"),
}
_UNACCOUNTED = f"SELECT event_id, ts, S(host) AS host, CASE WHEN {_PCAP} THEN D(post-capt-pkts) WHEN {_OL} THEN CASE WHEN coalesce(D(waitq-drops), D(drops), D(out-pkts)) IS NOT NULL THEN -coalesce(D(waitq-drops), 0) - coalesce(D(drops), 0) - coalesce(D(out-pkts), 0) END WHEN source = 'wifi_ol' AND data LIKE 'IN-STATS %' THEN D(in-pkts) + D(in-ctrl) WHEN source = 'wifi_ol' AND data LIKE 'OUT-STATS %' THEN -D(out-all) END / 1 AS v FROM fx_loglines"
_NET = f"""SELECT event_id, ts, S(host) AS src, '{SERVER}' AS dst, 'merged' AS class, D(bytes) AS bytes FROM fx_loglines WHERE source IN ('to_server', 'net_proxy') AND data LIKE 'STATS %' AND S(port) = 'on_wire'
UNION ALL SELECT event_id, ts, S(host), '{SERVER}', 'raw', (D(post-capt-bytes) + D(post-capt-pkts) * 88) * 0.35 FROM fx_loglines WHERE source = 'script' AND data LIKE 'STATS %'
UNION ALL SELECT event_id, ts, src, dst, 'overlay', bytes FROM (SELECT event_id, ts, regexp_extract(r, 'src=(\\S+)', 1) AS src, regexp_extract(r, 'dst=(\\S+)', 1) AS dst, TRY_CAST(regexp_extract(r, 'capt_bytes=(\\S+)', 1) AS DOUBLE) AS bytes FROM (SELECT event_id, ts, unnest(string_split(data, '|')) AS r FROM fx_loglines WHERE {_SELF}) AS u) AS o WHERE bytes <> 0 AND src <> '{SERVER}'"""
# a path of one link for each pair of hosts
_ALL = f"""WITH n AS ({_NET}), net AS (SELECT *, least(src, dst) AS a, greatest(src, dst) AS b FROM n WHERE src <> dst AND bytes IS NOT NULL),
v AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, ts, {host} AS host, {value} AS v FROM fx_loglines WHERE {test}" for m, (test, host, value) in _METRICS.items())}
UNION ALL SELECT 'unaccounted-packets', ts, host, sum(v) OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) FROM ({_UNACCOUNTED}) AS u WHERE v IS NOT NULL AND host IS NOT NULL
UNION ALL SELECT 'net-links', ts, concat(a, '-', b), bytes FROM net
UNION ALL SELECT 'net', ts, unnest([a, b]), bytes FROM net)"""
_SHOWN = f"v IS NOT NULL AND host IS NOT NULL AND (host <> '{SERVER}' OR metric LIKE 'route-%')"


def _paths(ends: DataFrame) -> DataFrame:
    return ends.withColumn("links", F.array(F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))))


def _values(spark, d) -> DataFrame:
    entries = view(spark, d, "fx_loglines")
    return metrics.metric_values(entries, metrics.METRICS, SERVER, paths=_paths, order=["event_id"])


@query("met_2_metrics", _sql(f"{_ALL} SELECT metric, host, count(*) AS entries, round(sum(v), 3) AS total FROM v WHERE {_SHOWN} GROUP BY metric, host"))
def _(spark, d):
    return _values(spark, d).groupBy("metric", "host").agg(F.count("*").alias("entries"), F.round(F.sum("value"), 3).alias("total"))


_HOUR = "US(ts) // 3600000000 * 3600000000"


def _series_sql(name: str, aggregate: str) -> str:
    return _sql(f"{_ALL} SELECT host, {_HOUR} AS start_us, CAST(floor(avg(US(ts))) AS BIGINT) AS us, round({aggregate}(v), 6) AS value FROM v WHERE metric = '{name}' AND {_SHOWN} GROUP BY host, {_HOUR}")


def _series(spark, d, name: str) -> DataFrame:
    out = metrics.metric_series(view(spark, d, "fx_loglines"), name, SERVER, window=3600)
    return out.select("host", F.expr("unix_micros(ts) div 3600000000 * 3600000000").alias("start_us"), F.unix_micros("ts").alias("us"), F.round("value", 6).alias("value"))


@query("met_3_series", _series_sql("kern-recv", "sum"))
def _(spark, d):
    return _series(spark, d, "kern-recv")


@query("met_3_measure", _series_sql("cpu", "avg"))
def _(spark, d):
    return _series(spark, d, "cpu")


@query("met_4_hosts", _sql(f"{_ALL} SELECT metric, host, count(*) AS entries, round(sum(v), 3) AS total FROM v WHERE v IS NOT NULL AND host IN ('{SERVER}', 'node3') AND metric IN ('kern-recv', 'route-changes') GROUP BY metric, host"))
def _(spark, d):
    rows = metrics.metric_values(view(spark, d, "fx_loglines"), ["kern-recv", "route-changes"], SERVER, hosts=[SERVER, "node3"])
    return rows.groupBy("metric", "host").agg(F.count("*").alias("entries"), F.round(F.sum("value"), 3).alias("total"))


@query("met_5_routes", "SELECT event, count(*) AS messages, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'addition' AS event, CAST(nullif(regexp_extract(data, '^created (\\d+) new routes; updated (\\d+) routes', 1), '') AS BIGINT) AS n FROM fx_loglines WHERE source = 'wifi_ol' UNION ALL SELECT 'change', CAST(nullif(regexp_extract(data, '^created (\\d+) new routes; updated (\\d+) routes', 2), '') AS BIGINT) FROM fx_loglines WHERE source = 'wifi_ol') AS e WHERE n IS NOT NULL GROUP BY event")
def _(spark, d):
    return metrics.route_events(view(spark, d, "fx_loglines"), SERVER).groupBy("event").agg(F.count("*").alias("messages"), F.sum("n").alias("n"))


@query("met_6_merge_rate", _series_sql("merge-rate", "avg"))
def _(spark, d):
    return _series(spark, d, "merge-rate")


@query("met_6_merge_counts", "SELECT sniffer_id AS host, sum(length) / sum(channel) AS rate FROM fx_frames WHERE channel > 1 GROUP BY sniffer_id")
def _(spark, d):
    counts = view(spark, d, "fx_frames").select(F.col("sniffer_id").alias("host"), F.col("length").alias("n_in"), F.expr("case when channel > 1 then channel else 0 end").alias("n_out"))
    return metrics.merge_rate(counts)
