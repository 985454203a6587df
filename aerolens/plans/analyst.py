"""The analyst's SQL layer: q01 to q49 and v01 over station, network, association and alert tables.

Ties of a limit are broken by the key, spans are seconds, scaled sums are doubles.
"""

from __future__ import annotations

REAL_IBSS = "SELECT mac FROM fx_station_stats WHERE beacons > 0 AND data_bytes > 0 AND flags = 6"
TOP_SENDER = "SELECT mac FROM (SELECT mac, sum(bytes) AS s FROM fx_station_stats WHERE capt_node_id IS NOT NULL GROUP BY mac ORDER BY s DESC, mac LIMIT 1) AS top"
LONG_AP = "SELECT mac FROM fx_station_stats WHERE flags = 2 GROUP BY mac HAVING US(max(ts)) - US(min(ts)) > 86400000000"
STANDARD = "(1, 32, 1024, 1025, 1056, 1057, 33)"
SPAN = "(US(max(ts)) - US(min(ts))) / 1e6"
PICKED = "(3, 17, 42, 77, 120)"
POOR_AP = """SELECT mac, {what} FROM fx_station_stats WHERE inferred_beacons IS NOT NULL AND agg_node_id IS NOT NULL
  GROUP BY mac HAVING sum(beacons) < 10 AND sum(beacons) > 0 AND sum(inferred_beacons) > 0"""
POOR_CLIENT = """SELECT mac, {what} FROM fx_station_stats WHERE inferred_packets IS NOT NULL AND agg_node_id IS NOT NULL
  GROUP BY mac HAVING sum(beacons) = 0 AND sum(inferred_beacons) = 0 AND sum(inferred_packets) > 0 AND sum(non_ctrl_packets) < 10"""
ASSOCIATIONS = f"""SELECT a.station_mac, b.uniq, a.total, a.span_sec, a.latest
FROM (SELECT station_mac, count(*) AS total, {SPAN} AS span_sec, max(ts) AS latest FROM fx_associations GROUP BY station_mac) AS a
JOIN (SELECT station_mac, count(DISTINCT bssid) AS uniq FROM fx_associations GROUP BY station_mac) AS b ON a.station_mac = b.station_mac"""


def _sum(col: str) -> str:
    return f"CAST(sum({col}) AS BIGINT)"


def _gib(col: str) -> str:
    return f"sum({col}) / 1073741824e0"


def _span_stats(source: str) -> str:
    return f"SELECT count(*) AS cnt, min(span) AS min_span, max(span) AS max_span, avg(span) AS avg_span FROM ({source.format(what=SPAN + ' AS span')}) AS a"


def _span_histogram(source: str) -> str:
    bins = "span < 300 AS lt_5_min, span < 600 AS lt_10_min, span < 3600 AS lt_1_hour, span < 28800 AS lt_8_hours"
    return f"SELECT count(*) AS cnt, lt_5_min, lt_10_min, lt_1_hour, lt_8_hours FROM (SELECT {bins} FROM ({source.format(what=SPAN + ' AS span')}) AS a) AS b GROUP BY lt_5_min, lt_10_min, lt_1_hour, lt_8_hours ORDER BY lt_5_min, lt_10_min, lt_1_hour, lt_8_hours"


def _count_histogram(source: str, col: str) -> str:
    return f"SELECT count(*) AS cnt, is_1, lt_5 FROM (SELECT c = 1 AS is_1, c < 5 AS lt_5 FROM ({source.format(what=f'sum({col}) AS c')}) AS a) AS b GROUP BY is_1, lt_5 ORDER BY is_1, lt_5"


def _no_beacon(more: str = "") -> str:
    return f"""SELECT mac, min(ts) AS first_ts, max(ts) AS last_ts, {_sum('inferred_beacons')} AS ibcn, {_sum('packets')} AS pkts
FROM fx_station_stats WHERE inferred_beacons IS NOT NULL AND mac IN (SELECT mac FROM fx_station_stats WHERE (flags & 2) = 2){more}
GROUP BY mac HAVING sum(beacons) = 0 AND sum(inferred_beacons) > 0"""


SENDERS = f"max(capt_node_id) AS node_id, {_sum('packets')} AS packets, {_sum('bytes')} AS bytes, {_sum('data_bytes')} AS data_bytes, {_sum('encrypt_data_bytes')} AS encr_data_bytes"

QUERIES: dict[str, str] = {
    "q01": "SELECT DISTINCT ssid FROM fx_bss_stats WHERE bssid IN (SELECT mac FROM fx_station_stats WHERE flags = 6)",
    "q02": "SELECT count(*) AS cnt FROM fx_bss_stats WHERE is_ibss = 0",
    "q03": "SELECT count(DISTINCT mac) AS cnt FROM fx_station_stats WHERE beacons > 0 AND data_bytes >= 0 AND flags = 2",
    "q04": f"SELECT bssid, ssid, encryption_types FROM fx_bss_stats WHERE bssid IN ({REAL_IBSS})",
    "q05": f"SELECT count(DISTINCT mac) AS cnt FROM ({REAL_IBSS}) AS a",
    "q06": f"SELECT (SELECT count(*) FROM fx_bss_stats WHERE is_ibss = 0) + (SELECT count(*) FROM fx_bss_stats WHERE bssid IN ({REAL_IBSS})) AS total",
    "q07": "SELECT count(*) AS cnt FROM fx_bss_stats WHERE is_ibss = 0 AND encryption_types > 0",
    "q08": "SELECT count(*) AS cnt, encryption_desc FROM fx_bss_stats AS b JOIN lu_encryptions AS e ON (b.encryption_types & e.encryption_id) > 0 WHERE is_ibss = 0 AND b.encryption_types > 0 GROUP BY encryption_desc",
    "q09": f"SELECT ssid, bssid, encryption_types FROM fx_bss_stats WHERE bssid IN ({REAL_IBSS})",
    "q10": "SELECT count(DISTINCT mac) AS cnt FROM fx_station_stats WHERE (flags & 2) = 0",
    "q11": "SELECT count(DISTINCT mac) AS cnt FROM fx_station_stats WHERE (flags & 3) = 1",
    "q12": f"SELECT {_sum('filt_capt_packets')} AS packets, {_sum('filt_capt_bytes')} AS bytes, max(ts) AS last_ts, min(ts) AS first_ts FROM fx_pcap_stats",
    "q13": f"SELECT sum(filt_capt_packets) / 1e6 AS mpackets, {_gib('filt_capt_bytes')} AS gibytes, max(ts) AS last_ts, min(ts) AS first_ts FROM fx_pcap_stats",
    "q14": f"SELECT sum(packets) / 1e6 AS mpackets, {_gib('bytes')} AS gibytes, {_gib('data_bytes')} AS data_gibytes, {_gib('encrypt_data_bytes')} AS encr_data_gibytes FROM fx_station_stats WHERE capt_node_id IS NOT NULL",
    "q15": f"SELECT mac, {SENDERS} FROM fx_station_stats WHERE capt_node_id IS NOT NULL GROUP BY mac ORDER BY bytes DESC, mac LIMIT 10",
    "q16": f"SELECT mac, max(capt_node_id) AS node_id, sum(packets) / 1e6 AS mpackets, {_gib('bytes')} AS gibytes, {_gib('data_bytes')} AS data_gibytes, {_gib('encrypt_data_bytes')} AS encr_data_gibytes FROM fx_station_stats WHERE capt_node_id IS NOT NULL GROUP BY mac ORDER BY gibytes DESC, mac LIMIT 10",
    "q17": f"SELECT {_sum('bytes')} AS bytes FROM fx_station_stats WHERE capt_node_id IS NOT NULL AND mac NOT IN ({TOP_SENDER})",
    "q18": f"SELECT sum(encrypt_data_bytes) / sum(data_bytes) AS encrypted FROM fx_station_stats WHERE capt_node_id IS NOT NULL AND mac NOT IN ({TOP_SENDER})",
    "q19": f"SELECT mac, CAST(bit_or(flags) AS INT) AS flags, {SPAN} AS span_sec, {_sum('non_ctrl_packets')} AS pkts, {_sum('inferred_packets')} AS infer, CAST(sum(non_ctrl_packets) AS DOUBLE) / sum(inferred_packets) AS pkt_rat FROM fx_station_stats WHERE coalesce(inferred_packets, 0) > 0 AND capt_node_id = 6 GROUP BY mac ORDER BY pkt_rat DESC, mac",
    "q20": "SELECT count(*) AS cnt FROM (SELECT mac, sum(inferred_packets) AS infer FROM fx_station_stats WHERE coalesce(inferred_packets, 0) > 0 AND capt_node_id = 6 GROUP BY mac) AS a WHERE a.infer = 1",
    "q21": "SELECT count(*) AS cnt FROM (SELECT mac, sum(inferred_packets) AS infer FROM fx_station_stats WHERE coalesce(inferred_packets, 0) > 0 AND capt_node_id = 6 GROUP BY mac) AS a WHERE a.infer > 1",
    "q22": "SELECT capt_node_id, count(DISTINCT mac) AS c FROM fx_station_stats WHERE capt_node_id IS NOT NULL AND ts > TIMESTAMP '1996-04-06 13:45:00' GROUP BY capt_node_id ORDER BY c DESC, capt_node_id",
    "q23": f"SELECT count(*) AS c FROM fx_bss_stats WHERE channels <> 0 AND bssid IN ({LONG_AP}) AND channels NOT IN {STANDARD}",
    "q24": f"SELECT count(*) AS c FROM fx_bss_stats WHERE channels <> 0 AND bssid IN ({LONG_AP}) AND channels IN {STANDARD}",
    "q25": """SELECT flags, count(*) AS cnt, avg(inf_bytes / dur) AS avg_rate, percentile_disc(0.5) WITHIN GROUP (ORDER BY inf_bytes / dur) AS median_rate
FROM (SELECT mac, CAST(bit_or(flags) AS INT) AS flags, sum(duration_sec) AS dur, CAST(sum(bytes) * sum(inferred_packets) AS DOUBLE) / sum(packets) AS inf_bytes
      FROM fx_station_stats WHERE agg_node_id IS NOT NULL AND inferred_packets IS NOT NULL AND mac <> 13 GROUP BY mac) AS a
GROUP BY flags ORDER BY flags""",
    "q26": "SELECT count(*) AS cnt, sig_id, sig_rev, priority, message FROM fx_alerts GROUP BY sig_id, sig_rev, priority, message ORDER BY priority, cnt DESC, sig_id",
    "q27": "SELECT count(*) AS c, h FROM (SELECT DISTINCT src_mac, coalesce(http_host, cookie_domain) AS h FROM fx_web_requests) AS a GROUP BY h ORDER BY c DESC, h",
    "q28": "SELECT bssid, ssid FROM fx_bss_stats WHERE ssid LIKE '%upplier%' AND ssid NOT LIKE 'MBTA%' AND ssid NOT LIKE 'Supplier%_1-%'",
    "q29": "SELECT min(w.ts) AS min_ts, max(w.ts) AS max_ts, station_mac, w.bssid, ssid FROM fx_associations AS w LEFT JOIN fx_bss_stats AS b ON w.bssid = b.bssid WHERE station_mac = 4 GROUP BY station_mac, w.bssid, ssid ORDER BY min_ts",
    "q30": "SELECT ts, w.bssid, ssid, is_ibss, capt_node_id FROM fx_associations AS w LEFT JOIN fx_bss_stats AS b ON w.bssid = b.bssid WHERE station_mac = 4 ORDER BY ts, w.bssid",
    "q31": f"{ASSOCIATIONS} ORDER BY total DESC, a.station_mac",
    "q32": f"{ASSOCIATIONS} ORDER BY uniq DESC, a.station_mac",
    "q33": "SELECT count(*) AS cnt, src_mac FROM (SELECT DISTINCT src_mac, bssid, ssid FROM fx_probe_requests) AS a GROUP BY src_mac HAVING count(*) < 50 ORDER BY cnt DESC, src_mac LIMIT 10",
    "q34": f"SELECT src_mac, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS cnt FROM fx_probe_requests WHERE src_mac IN {PICKED} GROUP BY src_mac",
    "q35": f"SELECT src_mac, count(DISTINCT ssid) AS cnt FROM fx_probe_requests WHERE src_mac IN {PICKED} GROUP BY src_mac",
    "q36": f"SELECT * FROM fx_web_requests WHERE src_mac IN {PICKED}",
    "q37": f"SELECT station_mac, count(*) AS cnt, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_associations WHERE station_mac IN {PICKED} GROUP BY station_mac",
    "q38": f"""SELECT count(*) AS cnt, poor_coverage, {_sum('bcns')} AS bcns, {_sum('ibcns')} AS ibcns, sum(bcns) / sum(ibcns) AS fidelity
FROM (SELECT mac, sum(beacons) < 10 AS poor_coverage, sum(beacons) AS bcns, sum(inferred_beacons) AS ibcns FROM fx_station_stats
      WHERE inferred_beacons IS NOT NULL AND agg_node_id IS NOT NULL GROUP BY mac HAVING sum(beacons) > 0 AND sum(inferred_beacons) > 0) AS a GROUP BY poor_coverage""",
    "q39": _no_beacon(),
    "q40": _no_beacon(" AND mac NOT IN (SELECT mac FROM fx_station_stats WHERE (flags & 4) = 4)"),
    "q41": f"""SELECT count(*) AS cnt, poor_coverage, {_sum('pkts')} AS pkts, {_sum('ipkts')} AS ipkts, sum(pkts) / sum(ipkts) AS fidelity
FROM (SELECT mac, sum(non_ctrl_packets) < 10 AS poor_coverage, sum(non_ctrl_packets) AS pkts, sum(inferred_packets) AS ipkts FROM fx_station_stats
      WHERE inferred_packets IS NOT NULL AND agg_node_id IS NOT NULL GROUP BY mac HAVING sum(beacons) = 0 AND sum(inferred_beacons) = 0 AND sum(inferred_packets) > 0) AS a GROUP BY poor_coverage""",
    "q42": _span_stats(POOR_AP),
    "q43": _span_stats(POOR_CLIENT),
    "q44": _span_histogram(POOR_AP),
    "q45": _span_histogram(POOR_CLIENT),
    "q46": _count_histogram(POOR_AP, "beacons"),
    "q47": _count_histogram(POOR_CLIENT, "non_ctrl_packets"),
    "q48": f"""SELECT capt_node_id, sum(beacons) / sum(inferred_beacons) AS beacon_fidelity, {_sum('beacons')} AS beacons, {_sum('inferred_beacons')} AS inferred_beacons
FROM (SELECT mac, capt_node_id, sum(beacons) AS beacons, sum(inferred_beacons) AS inferred_beacons FROM fx_station_stats
      WHERE mac <> 13 AND capt_node_id IS NOT NULL GROUP BY mac, capt_node_id HAVING sum(beacons) >= 3) AS a
GROUP BY capt_node_id ORDER BY beacon_fidelity DESC, capt_node_id""",
    "q49": f"""SELECT capt_node_id, sum(packets) / sum(inferred_packets) AS packet_fidelity, {_sum('packets')} AS packets, {_sum('inferred_packets')} AS inferred_packets
FROM (SELECT mac, capt_node_id, sum(non_ctrl_packets) AS packets, sum(inferred_packets) AS inferred_packets FROM fx_station_stats
      WHERE mac <> 13 AND capt_node_id IS NOT NULL AND non_ctrl_packets IS NOT NULL AND inferred_packets IS NOT NULL GROUP BY mac, capt_node_id HAVING sum(non_ctrl_packets) >= 10) AS a
GROUP BY capt_node_id ORDER BY packet_fidelity DESC, capt_node_id""",
    "v01": f"SELECT type_desc, sniffer_id, count(*) AS packets, {_sum('length')} AS bytes FROM lu_wifi_types AS lt JOIN fx_frames AS f ON lt.type_id = f.ftype AND lt.subtype_id = f.fsubtype GROUP BY type_desc, sniffer_id",
}

#: What Spark runs for a query whose SQL it can only plan with a list sent to every task, as it does for NOT IN; the same rows.
SPARK_FORMS: dict[str, str] = {
    # the two lists are tests on the rows of a station; a station without address on the second list leaves nothing
    "q40": """SELECT mac, min(ts) FILTER (WHERE counted) AS first_ts, max(ts) FILTER (WHERE counted) AS last_ts,
  CAST(sum(inferred_beacons) AS BIGINT) AS ibcn, CAST(sum(packets) FILTER (WHERE counted) AS BIGINT) AS pkts
FROM (SELECT *, inferred_beacons IS NOT NULL AS counted FROM fx_station_stats) AS s
WHERE mac IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_station_stats WHERE mac IS NULL AND (flags & 4) = 4)
GROUP BY mac HAVING bool_or((flags & 2) = 2) AND NOT coalesce(bool_or((flags & 4) = 4), FALSE) AND sum(beacons) FILTER (WHERE counted) = 0 AND sum(inferred_beacons) > 0""",
}
