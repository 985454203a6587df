"""Views that give the operators wireless-shaped input from the driver's tables.

One SQL text serves Spark and DuckDB; `US(x)` stands for the microseconds of a
time and `LOGTIME(x)` for the time of a log line in the dialect at hand; Spark
reckons `ONCE(x)` once, however often the column is used.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aerolens.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "fx_frames": """
SELECT event_id AS frame_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS ta, user_id % 20 AS bssid,
       CAST(event_id % 7 AS INT) AS sniffer_id, 1 + CAST(event_id % 11 AS INT) AS channel,
       CAST((event_id * 37) % 4096 AS INT) AS seq, event_type = 'error' AS retry,
       24 + CAST((event_id * 13) % 1477 AS INT) AS length,
       CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS ftype,
       CASE event_type WHEN 'signup' THEN 8 WHEN 'purchase' THEN 4 WHEN 'error' THEN 13 WHEN 'view' THEN 0 ELSE 8 END AS fsubtype,
       CAST((event_id * 7919) % 65536 AS INT) AS sport, CAST((event_id * 104729) % 65536 AS INT) AS dport,
       -50 - CAST(event_id % 40 AS INT) AS rssi, -95 AS noise, user_id % 3 = 1 AS protected
FROM events""",
    # stations that number their frames; those of ta % 4 = 0 with one counter for all, and station 0 sends a third of all frames
    "fx_numbered_frames": """
SELECT frame_id, ts, concat('02:00:00:00:00:', CAST(10 + ta AS VARCHAR(4))) AS ta, ra, tid, ftype, fsubtype, retry, protected, dir, length, ethertype, ibss, bcn_int,
       CAST(CASE WHEN ftype = 1 THEN NULL
                 WHEN fsubtype >= 8 AND ftype = 2 AND ta % 4 <> 0 THEN 2 * row_number() OVER (PARTITION BY ta, ra, tid ORDER BY ts, frame_id) - frame_id % 2
                 ELSE 3 * row_number() OVER (PARTITION BY ta ORDER BY ts, frame_id) - frame_id % 3 + CASE WHEN frame_id % 19 = 0 THEN 50 ELSE 0 END END AS INT) % 4096 AS seq
FROM (
  SELECT event_id AS frame_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN user_id % 3 = 0 THEN 0 ELSE CAST(user_id % 40 AS INT) END AS ta,
         CASE WHEN event_id % 13 = 0 THEN 'ff:ff:ff:ff:ff:ff' ELSE concat('00:00:00:00:00:', CAST(10 + event_id % 3 AS VARCHAR(4))) END AS ra,
         CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS ftype,
         CAST(CASE event_type WHEN 'signup' THEN 8 WHEN 'purchase' THEN 4 WHEN 'error' THEN 13 WHEN 'view' THEN CASE WHEN event_id % 7 = 0 THEN 12 ELSE 8 END ELSE event_id % 5 END AS INT) AS fsubtype,
         CASE WHEN event_type = 'view' THEN CAST(event_id % 2 * 5 AS INT) END AS tid, event_id % 10 = 3 AS retry, event_id % 6 = 1 AS protected, CAST(event_id % 4 AS INT) AS dir,
         24 + CAST((event_id * 13) % 1477 AS INT) AS length, CASE WHEN event_id % 3 > 0 THEN 2048 END AS ethertype,
         event_type = 'signup' AND user_id % 5 = 0 AS ibss, CASE WHEN event_type = 'signup' THEN 100 + CAST(user_id % 2 * (event_id % 2) AS INT) END AS bcn_int
  FROM events) AS e""",
    # twelve captures a content, within a second or, of control frames, within a millisecond
    "fx_captures": """
SELECT event_id AS frame_id, event_id - event_id % 12 AS payload_hash,
       (event_id - event_id % 12) * 400000 + (event_id * 7919) % 12 * CASE WHEN (event_id - event_id % 12) % 60 = 0 THEN 70 ELSE 90000 END + user_id % 50 AS ts_us,
       CAST((event_id * event_id + user_id) % 4 AS INT) AS sniffer_id, 1 + CAST(user_id % 3 AS INT) AS channel,
       -50 - CAST((event_id * 17) % 40 AS INT) AS rssi, -95 - CAST(user_id % 6 AS INT) AS noise,
       (event_id - event_id % 12) % 60 = 0 AS is_ctrl, CAST(100 + user_id * 7 % 400 AS INT) AS err_us
FROM events""",
    "fx_web_packets": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, up, CAST((event_id * 31) % 7 AS INT) AS sniffer_id,
       CASE WHEN up THEN c ELSE s END AS src, CASE WHEN up THEN 5000 + CAST(user_id % 3 AS INT) ELSE w END AS sport,
       CASE WHEN up THEN s ELSE c END AS dst, CASE WHEN up THEN w ELSE 5000 + CAST(user_id % 3 AS INT) END AS dport,
       up AND event_id % 5 = 0 AS syn, (event_id * 13) % 50 AS seq, CAST(event_id % 4 AS INT) * 100 AS payload_len,
       CASE WHEN event_id % 3 = 0 THEN concat('h', CAST(user_id % 5 AS VARCHAR(8)), '.com', CASE WHEN event_id % 2 = 0 THEN ':80' ELSE '' END) END AS host,
       CASE WHEN event_id % 5 = 1 THEN concat('c', CAST((event_id * 7) % 1000 AS VARCHAR(8)), '.com') END AS cookie,
       CASE WHEN event_id % 4 = 1 THEN concat('q=t', CAST(event_id % 9 AS VARCHAR(8))) END AS term
FROM (SELECT *, (event_id * 7919) % 5 < 3 AS up, concat('c', CAST(user_id AS VARCHAR(8))) AS c, concat('s', CAST(user_id % 4 AS VARCHAR(8))) AS s, CASE WHEN event_id % 11 = 0 THEN 443 ELSE 80 END AS w FROM events) AS e""",
    "fx_station_stats": """
SELECT l_partkey AS mac, 300 AS duration_sec,
       CASE WHEN l_partkey % 6 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(l_orderkey % (1 + l_partkey % 97) * 100 AS INT)
            ELSE CAST(l_shipdate AS TIMESTAMP) END AS ts,
       CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey % 12 AS INT) END AS capt_node_id,
       CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_suppkey % 12 AS INT) END AS agg_node_id,
       CAST(l_quantity AS BIGINT) AS packets, CAST(floor(l_extendedprice) AS BIGINT) AS bytes,
       CASE WHEN l_partkey % 5 = 0 THEN l_orderkey % 2 ELSE CAST(l_quantity AS BIGINT) END AS non_ctrl_packets,
       CAST(l_quantity AS BIGINT) + l_linenumber AS inferred_packets,
       CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS data_bytes, CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS encrypt_data_bytes,
       CASE WHEN l_partkey % 7 = 6 THEN l_linenumber ELSE 1 + CAST(l_partkey % 7 AS INT) END AS flags,
       CASE WHEN l_partkey % 4 IN (0, 1) THEN 0 WHEN l_partkey % 4 = 2 THEN CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END ELSE l_orderkey % 4 END AS beacons,
       CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE l_orderkey % 4 + l_linenumber END AS inferred_beacons
FROM lineitem""",
    "fx_bss_stats": """
SELECT s_suppkey AS bssid, s_name AS ssid, CASE WHEN s_nationkey % 5 = 0 THEN 1 ELSE 0 END AS is_ibss,
       CASE WHEN s_suppkey % 4 = 0 THEN 1057 WHEN s_suppkey % 4 = 1 THEN 1 WHEN s_suppkey % 4 = 2 THEN 4 ELSE 0 END AS channels,
       CAST((s_suppkey * 5) % 32 AS INT) AS encryption_types
FROM supplier""",
    "fx_pcap_stats": """
SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_orderkey % 12 AS INT) AS node_id,
       o_orderkey % 1000 AS filt_capt_packets, CAST(floor(o_totalprice) AS BIGINT) AS filt_capt_bytes
FROM orders""",
    "fx_associations": """
SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, o_custkey AS station_mac, o_orderkey % 120 AS bssid,
       CAST(o_orderkey % 12 AS INT) AS capt_node_id
FROM orders""",
    "fx_probe_requests": """
SELECT CAST(ts AS TIMESTAMP) AS ts, user_id AS src_mac, event_id % 5 AS bssid,
       CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('net', CAST(event_id % 17 AS VARCHAR(8))) END AS ssid
FROM events WHERE event_type = 'purchase'""",
    "fx_web_requests": """
SELECT CAST(ts AS TIMESTAMP) AS ts, user_id AS src_mac,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('www.site', CAST(event_id % 9 AS VARCHAR(8)), '.com') END AS http_host,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('site', CAST(event_id % 9 AS VARCHAR(8)), '.com') END AS cookie_domain
FROM events WHERE event_type IN ('view', 'click')""",
    "fx_alerts": """
SELECT CAST(ts AS TIMESTAMP) AS ts, user_id AS src_mac, event_id % 8 AS sig_id, 1 AS sig_rev,
       CAST(event_id % 3 AS INT) AS priority, concat('sig ', CAST(event_id % 8 AS VARCHAR(8))) AS message
FROM events WHERE event_type = 'error'""",
    # log lines of every kind; some miss their last field, hold no number, or use underscores
    "fx_loglines": """
SELECT event_id, ts, source, level,
       ONCE(CASE WHEN event_id % 11 = 3 THEN regexp_replace(data, ' [^ ]*$', '') WHEN event_id % 13 = 5 THEN regexp_replace(data, '=[0-9]+$', '=x') ELSE data END) AS data
FROM (
  SELECT event_id, ts, CASE WHEN event_id % 9 = 4 THEN 'WARN' WHEN event_id % 9 = 5 THEN 'DEBUG' ELSE 'INFO' END AS level,
         CASE k WHEN 0 THEN 'pcap' WHEN 1 THEN 'script' WHEN 2 THEN 'queries' WHEN 3 THEN 'to_server' WHEN 4 THEN 'to_server' WHEN 5 THEN 'wifi_ol' WHEN 6 THEN 'wifi_ol_lab' WHEN 7 THEN 'ol_in_proxy'
                WHEN 8 THEN 'wifi_ol' WHEN 9 THEN 'wifi_ol' WHEN 10 THEN 'system' WHEN 11 THEN 'wifi_merge' WHEN 12 THEN 'wifi_ol' WHEN 13 THEN 'pcap' ELSE 'wifi_ol' END AS source,
         ONCE(CASE k WHEN 0 THEN concat('STATS host=', h, ' kern-recv=', a, ' kern-drop=', b, ' mem-drop=', c, ' pre-capt-pkts=', a, ' pre-capt-bytes=', d, ' post-capt-pkts=', b, ' post-capt-bytes=', d)
                WHEN 1 THEN concat('STATS host=', h, ' kern_recv=', a, ' kern_drop=', b, ' pre_capt_pkts=', a, ' pre_capt_bytes=', d, ' post_capt_pkts=', b, ' post_capt_bytes=', d)
                WHEN 2 THEN concat('STATS host=', h, ' query="q ', c, '" in-pkts=', a, ' out-pkts=', b, ' out-bytes=', d, ' drop-pkts=', c)
                WHEN 3 THEN concat('STATS host=', h, ' query=q', c, ' port=', CASE WHEN c > 4 THEN 'on_wire' ELSE 'log' END, ' count=', b, ' bytes=', d)
                WHEN 4 THEN concat('OUT-STATS host=', h, ' count=', b, ' bytes=', d, ' avg-compress-rate=0.', c, ' avg-compress-size=', a, '.5 avg-cpu=', c)
                WHEN 5 THEN concat('STATS host=', h, ' routes=', a, ' self-routes=', b, ' no-route-pkts=', c, ' unclassified=', c, ' bcast-pkts=', b, ' drops=', c, ' drop-bytes=', d, ' waitq-drops=', b, ' waitq-drop-bytes=', d,
                                   ' ttl-drops=', c, ' ttl-drop-bytes=', d, ' out-pkts=', a, ' from-self-pkts=', a, ' from-peers-pkts=', b, ' recv=', b, ' recv-bytes=', d)
                WHEN 6 THEN concat('STATS host=', h, ' routes=', a)
                WHEN 7 THEN concat('STATS host=', h, ' recv=', a, ' recv-bytes=', d)
                WHEN 8 THEN concat('IN-STATS host=', h, ' peer=node', c, ' in-pkts=', a, ' in-ctrl=', b, ' in-bytes=', d)
                WHEN 9 THEN concat('OUT-STATS host=', h, ' peer=node', c, ' queued-pkts=', a, ' queued-ctrl=', b, ' queued-bytes=', d, ' queued-reroutes=', c, ' drop-pkts=', b, ' drop-ctrl=', c, ' drop-bytes=', d,
                                   ' out-all=', a, ' send-bytes=', d, ' compress-rate=0.', c, ' avg-compress-size=', a, ' avg-cpu=', c)
                WHEN 10 THEN concat('SYSINFO host=', h, ' cpu-10=', a, '.25 maxrss-kb=', d, ' alloc-pkts=', a, '/', b)
                WHEN 11 THEN concat('STATS host=', h, ' avg_merge=1.', c, ' out_merges=', c)
                WHEN 12 THEN concat('created ', b, ' new routes; updated ', c, ' routes')
                WHEN 13 THEN concat('APP-STATS host=', h, ' log-qdrops=', b, ' pkt-qdrops=', c)
                ELSE concat('NET-USAGE src=node', c, ' dst=node', b % 9, ' capt_pkts=', b, ' capt_bytes=', d, ' | src=node', c, ' dst=node', c, ' capt_pkts=', c, ' capt_bytes=', a) END) AS data
  FROM (
    SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST((event_id + user_id) % 15 AS INT) AS k, CASE WHEN user_id % 8 = 0 THEN 'server' ELSE concat('node', CAST(user_id % 8 AS VARCHAR(8))) END AS h,
           CAST((event_id * 31) % 1000 AS VARCHAR(8)) AS a, CAST(event_id % 17 AS INT) AS b, CAST(user_id % 7 AS INT) AS c, CAST((event_id * 7919) % 65536 AS VARCHAR(8)) AS d
    FROM events) AS e) AS l""",
    # fixed values: bits of the cipher set
    "lu_encryptions": """
SELECT CAST(id AS INT) AS encryption_id, name AS encryption_desc
FROM (VALUES (0, 'none'), (1, 'WEP'), (2, 'TKIP'), (4, 'CCMP'), (8, 'PSK'), (16, '802.1X'), (256, 'vendor-specific'), (512, 'unknown')) AS t(id, name)""",
    # fixed values: roles of stations, as bits of their flags
    "lu_station_flags": """
SELECT CAST(id AS INT) AS flag, name AS flag_desc FROM (VALUES (1, 'acted as client'), (2, 'acted as access point'), (4, 'acted as IBSS')) AS t(id, name)""",
    # fixed values: what was captured of a web request, as bits of its flags
    "lu_web_request_flags": """
SELECT CAST(id AS INT) AS flag, name AS flag_desc
FROM (VALUES (1, '>0 packets captured from request stream'), (2, '>0 packets captured from response stream'), (4, 'SYN captured from request stream'), (8, 'first TCP data segment captured from request stream'),
  (16, 'value of HTTP ''Host'' header from request stream'), (32, 'value of HTTP ''Set-Cookie'' header from response stream')) AS t(id, name)""",
    # one row a capture node, the server is 0; here named after the suppliers
    "lu_nodes": """
SELECT CAST(s_suppkey % 12 AS INT) AS node_id, min(s_name) AS hostname, CASE WHEN s_suppkey % 12 < 8 THEN 'indoor' END AS testbed FROM supplier GROUP BY s_suppkey % 12""",
    # fixed values: names of frame types and subtypes, spelled as users know them
    "lu_wifi_types": """
SELECT CAST(a AS INT) AS type_id, CAST(b AS INT) AS subtype_id, name AS type_desc
FROM (VALUES (0, 0, 'Assocation Request'), (0, 1, 'Assocation Response'), (0, 2, 'Reassocation Request'), (0, 3, 'Reassocation Response'),
  (0, 4, 'Probe Request'), (0, 5, 'Probe Response'), (0, 8, 'Beacon'), (0, 9, 'ATIM'), (0, 10, 'Disassociation'), (0, 11, 'Authentication'),
  (0, 12, 'Deauthentication'), (0, 13, 'Action'),
  (1, 8, 'BlockACK Request'), (1, 9, 'BlockACK'), (1, 10, 'PS-Poll'), (1, 11, 'RTS'), (1, 12, 'CTS'), (1, 13, 'Ack'), (1, 14, 'CF-End'), (1, 15, 'CF-End+CF-Ack'),
  (2, 0, 'Data'), (2, 1, 'Data+CF+Ack'), (2, 2, 'Data+CF-Poll'), (2, 3, 'Data+CF-Ack+CF-Poll'), (2, 4, 'Null Data'), (2, 5, 'CF-Ack'),
  (2, 6, 'CF-Poll'), (2, 7, 'CF-Ack+CF-Poll'), (2, 8, 'QoS Data'), (2, 9, 'QoS Data+CF+Ack'), (2, 10, 'QoS Data+CF-Poll'),
  (2, 11, 'QoS Data+CF-Ack+CF-Poll'), (2, 12, 'QoS Null Data'), (2, 13, 'QoS CF-Ack'), (2, 14, 'QoS CF-Poll'), (2, 15, 'QoS CF-Ack+CF-Poll')) AS t(a, b, name)""",
}


def _used(sql: str, names) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [n for n in names if n in words]


def with_views(sql: str, dialect: str = "spark") -> str:
    """The query with the views that it names as leading CTEs, in one dialect."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _used(sql, VIEWS))
    text = sql.lstrip()
    if ctes:
        opening = re.match(r"WITH (RECURSIVE )?", text)
        rest = f",\n{text[opening.end():]}" if opening else f"\n{text}"
        text = f"WITH {(opening and opening[1]) or ''}{ctes}{rest}"
    text = re.sub(r"\bLOGTIME\((\w+)\)", r"date_format(\1, 'MMM dd HH:mm:ss.SSS')" if dialect == "spark" else r"strftime(\1, '%b %d %H:%M:%S.%g')", text)
    text = re.sub(r"\bONCE\((.*?)\) AS data", r"explode(array(\1)) AS data" if dialect == "spark" else r"\1 AS data", text, flags=re.DOTALL)
    return re.sub(r"\bUS\(", "unix_micros(" if dialect == "spark" else "epoch_us(", text)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a query over the driver's tables and the views above."""
    text = with_views(sql)
    for name in _used(text, TABLES):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")


def sql_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
