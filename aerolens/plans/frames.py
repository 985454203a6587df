"""Registered queries of the frame, window, state, graph and metric operators, with SQL where SQL can say them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolens.functions import scalars
from aerolens.operators import aggregates, filters, graph, joins, networks, projections, state, stations, windows
from aerolens.plans.fixtures import run_sql, view
from aerolens.session import staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Port ranges whose traffic is told apart.
TCP_PORTS = "20-21 22 23 25 53 80 110 143 137-139 443 993-995 1194 1214 1900 3723-3724 4662 4672 6881-6889 6890-6999 1-65535"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


RANGES = [(int(p.split("-")[0]), int(p.split("-")[-1])) for p in TCP_PORTS.split()]
RANGES_SQL = "(VALUES " + ", ".join(f"({p.split('-')[0]}, {p.split('-')[-1]})" for p in TCP_PORTS.split()) + ") AS r(low, high)"
F_ID = "frame_id"


@query("fil_1_bssid", "SELECT frame_id FROM fx_frames WHERE nullif(bssid, 7) IS NULL OR bssid <> 3")
def _(spark, d):
    return filters.exclude_value(view(spark, d, "fx_frames").withColumn("bssid", F.nullif("bssid", F.lit(7))), "bssid", 3).select(F_ID)


@query("fil_2_ssid", "SELECT bssid, ssid FROM fx_bss_stats WHERE ssid IS NULL OR lower(ssid) <> 'supplier#000000007'")
def _(spark, d):
    return filters.exclude_value(view(spark, d, "fx_bss_stats"), "ssid", "supplier#000000007", ignore_case=True).select("bssid", "ssid")


@query("fil_3_beacons", "SELECT frame_id FROM fx_frames WHERE ((ftype * 4 + fsubtype * 16) & 12) = 0 AND ((ftype * 4 + fsubtype * 16) & 240) = 128")
def _(spark, d):
    return filters.mask_filter(view(spark, d, "fx_frames").withColumn("fc0", F.expr("ftype * 4 + fsubtype * 16")), "fc0", (0x0C, 0x00), (0xF0, 0x80)).select(F_ID)


@query("fil_4_length", "SELECT frame_id FROM fx_frames WHERE length > 300")
def _(spark, d):
    return filters.min_length(view(spark, d, "fx_frames"), longest_dropped=300).select(F_ID)


LENGTHS = "SELECT *, CASE WHEN frame_id % 17 = 0 THEN length - 24 ELSE 4 + length % 40 END AS n, CAST(frame_id % 13 // 12 AS INT) AS v, CASE WHEN frame_id % 19 = 0 THEN 3 ELSE ftype END AS t, CAST((fsubtype + frame_id % 7) % 16 AS INT) AS s FROM fx_numbered_frames"


@query("fil_5_rejects", f"SELECT rule, count(*) AS frames FROM (SELECT unnest(list_filter([CASE WHEN n < 2 THEN 'no_length' END, CASE WHEN v <> 0 THEN 'bad_version' END, CASE WHEN t = 3 THEN 'unknown_type' END, CASE WHEN t = 0 AND s IN (6, 7, 14, 15) THEN 'reserved_management' END, CASE WHEN t = 1 AND s < 8 THEN 'reserved_control' END, CASE WHEN t = 0 AND n < 24 THEN 'short_management' END, CASE WHEN t = 2 AND n < CASE WHEN dir = 3 AND s >= 8 THEN 32 WHEN dir = 3 THEN 30 WHEN s >= 8 THEN 26 ELSE 24 END THEN 'short_data' END, CASE WHEN t = 1 AND (s IN (12, 13) AND n < 10 OR s IN (8, 9, 10, 11, 14, 15) AND n < 16) THEN 'short_control' END], lambda x: x IS NOT NULL)) AS rule FROM ({LENGTHS}) AS l) AS v GROUP BY rule")
def _(spark, d):
    named = run_sql(spark, d, LENGTHS.replace("//", "div")).drop("length", "ftype", "fsubtype").withColumnsRenamed({"n": "length", "v": "version", "t": "ftype", "s": "fsubtype"})
    _, bad = filters.validate_frames(named, filters.FRAME_RULES)
    return bad.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("frames"))


_HEX = lambda x, n: f"lpad(hex({x}), {n}, '0')"
_LE16 = lambda x: f"concat({_HEX(f'({x}) % 256', 2)}, {_HEX(f'({x}) div 256', 2)})"
#: Beacons and data frames written byte by byte from events; some lack rates, name them before the name, or have a malformed RSN element.
BYTES = f"""SELECT event_id AS frame_id, unix_micros(CAST(ts AS TIMESTAMP)) AS ts_us, 0 AS length, unhex(CASE WHEN event_id % 2 = 0 THEN
  concat('8000', '0000', 'FFFFFFFFFFFF', '0200000000', {_HEX("user_id % 256", 2)}, '0200000000', {_HEX("user_id % 256", 2)}, {_LE16("(event_id % 4096) * 16")}, '0000000000000000', {_LE16("100 + user_id % 3")}, {_LE16("1 + event_id % 4 + CASE WHEN user_id % 3 = 0 THEN 16 ELSE 0 END")},
    CASE WHEN event_id % 22 = 4 THEN '' WHEN event_id % 26 = 6 THEN concat('010182', '0003', hex(concat('n', lpad(user_id % 100, 2, '0')))) ELSE concat('0003', hex(concat('n', lpad(user_id % 100, 2, '0'))), '010182') END,
    '0301', {_HEX("1 + event_id % 11", 2)}, CASE WHEN user_id % 9 = 0 THEN CASE WHEN event_id % 5 = 0 THEN '30020200' ELSE '3014' || '0100000FAC020100000FAC040100000FAC020000' END WHEN user_id % 9 = 3 THEN 'DD16' || '0050F201' || '01000050F20201000050F20201000050F201' ELSE '' END)
  ELSE concat(CASE WHEN event_id % 3 = 0 THEN '88' ELSE '08' END, CASE WHEN event_id % 5 = 0 THEN '42' ELSE '02' END, '0000', '0200000000', {_HEX("user_id % 256", 2)}, '020000000001', '020000000002', {_LE16("(event_id % 4096) * 16")}, CASE WHEN event_id % 3 = 0 THEN concat('0', lower(hex(event_id % 8)), '00') ELSE '' END, 'AAAA03000000', CASE WHEN event_id % 7 = 0 THEN '86DD' ELSE '0800' END, '45') END) AS raw FROM events"""
EXPECTED = """SELECT event_id AS frame_id, CASE WHEN e THEN 0 ELSE 2 END AS ftype, CASE WHEN e THEN 8 WHEN q THEN 8 ELSE 0 END AS fsubtype, NOT e AND event_id % 5 = 0 AS protected, CAST(event_id % 4096 AS INT) AS seq,
  CASE WHEN e THEN concat('02:00:00:00:00:', printf('%02x', user_id % 256)) ELSE '02:00:00:00:00:01' END AS ta, CASE WHEN e THEN concat('02:00:00:00:00:', printf('%02x', user_id % 256)) ELSE '02:00:00:00:00:01' END AS bssid,
  CASE WHEN e AND NOT bare THEN concat('n', printf('%02d', user_id % 100)) END AS ssid, CASE WHEN e THEN 100 + CAST(user_id % 3 AS INT) END AS bcn_int, CASE WHEN e THEN CAST(1 + event_id % 11 AS INT) END AS adv_channel,
  CASE WHEN e THEN (1 + event_id % 4) & 2 > 0 END AS ibss, CASE WHEN e THEN CASE WHEN NOT private THEN 0 WHEN rsn THEN 2 WHEN wpa THEN 2 ELSE 1 END END AS group_cipher,
  CASE WHEN e THEN CASE WHEN NOT private THEN 0 WHEN rsn THEN 12 WHEN wpa THEN 18 ELSE 9 END END AS cipher_bits, CASE WHEN e THEN private AND broken END AS bad_ciphers,
  CASE WHEN NOT e AND q THEN CAST(event_id % 8 AS INT) END AS tid, CASE WHEN NOT e AND event_id % 5 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 34525 ELSE 2048 END END AS ethertype, bare, swapped
FROM (SELECT *, event_id % 2 = 0 AS e, event_id % 3 = 0 AS q, event_id % 22 = 4 AS bare, event_id % 22 <> 4 AND event_id % 26 = 6 AS swapped, user_id % 3 = 0 AS private,
        user_id % 9 = 0 AND event_id % 5 <> 0 AS rsn, user_id % 9 = 0 AND event_id % 5 = 0 AS broken, user_id % 9 = 3 AS wpa FROM events) AS x"""


def _decoded(spark, d) -> DataFrame:
    from aerolens.sources.frames import decode_frames

    return decode_frames(run_sql(spark, d, BYTES)).withColumn("length", F.octet_length("raw"))


@query("src_1_captures", f"SELECT frame_id % 4 AS part, count(*) AS packets, CAST(sum(ftype + 10 * fsubtype + seq) AS BIGINT) AS fields, count(ssid) AS names, min(ts_us) AS first_us FROM (SELECT x.*, US(ts) AS ts_us FROM ({EXPECTED}) AS x JOIN events ON event_id = frame_id) AS y GROUP BY 1")
def _(spark, d):
    """Capture files written from events, read back by splits much smaller than a file."""
    from aerolens.session import shared_dir
    from aerolens.sources.captures import read_large_captures, write_captures
    from aerolens.sources.frames import decode_frames

    folder = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    # the length on the air tells the part
    packets = run_sql(spark, d, BYTES).withColumn("length", (1000 + F.col(F_ID) % 4).cast("int")).repartition(4, "length").sortWithinPartitions("ts_us", F_ID)
    write_captures(packets, folder).collect()
    frames_ = decode_frames(read_large_captures(spark, folder, split_bytes=100_000))
    fields = F.sum(F.col("ftype") + 10 * F.col("fsubtype") + F.col("seq")).cast("long")
    return frames_.groupBy((F.col("length") - 1000).cast("long").alias("part")).agg(F.count("*").alias("packets"), fields.alias("fields"), F.count("ssid").alias("names"), F.min("ts_us").alias("first_us"))


@query("src_3_decode", f"SELECT * EXCLUDE (bare, swapped) FROM ({EXPECTED}) AS x")
def _(spark, d):
    return _decoded(spark, d).select(F_ID, "ftype", "fsubtype", "protected", "seq", "ta", "bssid", "ssid", "bcn_int", "adv_channel", "ibss", "group_cipher", "cipher_bits", "bad_ciphers", "tid", "ethertype")


@query("fil_5_elements", f"SELECT frame_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM (SELECT frame_id, unnest(list_filter([CASE WHEN bare OR swapped THEN 'no_name' END, CASE WHEN bare OR swapped THEN 'no_rates' END, CASE WHEN bad_ciphers THEN 'bad_ciphers' END], lambda x: x IS NOT NULL)) AS rule FROM ({EXPECTED}) AS x) AS y GROUP BY frame_id")
def _(spark, d):
    _, bad = filters.validate_frames(_decoded(spark, d), filters.FRAME_RULES | filters.ELEMENT_RULES)
    return bad.select(F_ID, F.array_join(F.sort_array("violations"), ",").alias("rules"))


@query("fil_6_route", "SELECT route, count(*) AS frames FROM (SELECT CASE WHEN dport < 1024 THEN 'system' WHEN sport < 1024 THEN 'reply' ELSE 'other' END AS route FROM fx_frames) AS r GROUP BY route")
def _(spark, d):
    routed = filters.route(view(spark, d, "fx_frames"), [("system", F.col("dport") < 1024), ("reply", F.col("sport") < 1024)], "other")
    return routed.groupBy("route").agg(F.count("*").alias("frames"))


@query("fil_7_drop_unrouted", "SELECT frame_id, CASE WHEN dport % 7 = 0 THEN 'a' ELSE 'b' END AS route FROM fx_frames WHERE dport % 7 = 0 OR sport % 11 = 0")
def _(spark, d):
    return filters.route(view(spark, d, "fx_frames"), [("a", F.col("dport") % 7 == 0), ("b", F.col("sport") % 11 == 0)]).select(F_ID, "route")


PAYLOAD = "CASE frame_id % 3 WHEN 0 THEN 'GET /x HTTP/1.1' WHEN 1 THEN 'HTTP/1.1 200 OK' END"


@query("fil_8_http", "SELECT frame_id FROM fx_frames WHERE frame_id % 3 = 0")
def _(spark, d):
    return filters.http_requests(view(spark, d, "fx_frames").withColumn("payload", F.expr(PAYLOAD)))[0].select(F_ID)


@query("fil_9_shared", "SELECT frame_id FROM fx_frames WHERE ftype = 0 OR dport < 2000")
def _(spark, d):
    return filters.shared_filter(view(spark, d, "fx_frames"), [F.col("ftype") == 0, F.col("dport") < 2000]).select(F_ID)


TAP = "CASE frame_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'merged' ELSE 'ip' END"


@query("fil_10_taps", "SELECT frame_id FROM fx_frames WHERE frame_id % 3 = 0 OR frame_id % 3 = 1 AND NOT retry")
def _(spark, d):
    return filters.select_taps(view(spark, d, "fx_frames").withColumns({"tap": F.expr(TAP), "is_dupe": F.col("retry")}), ["raw", "merged"]).select(F_ID)


@query("fil_11_rest", "SELECT frame_id FROM (SELECT frame_id, row_number() OVER (ORDER BY ts, frame_id) AS n FROM fx_frames) AS a WHERE n > 100")
def _(spark, d):
    return filters.split_first(view(spark, d, "fx_frames"), 100, ["ts", F_ID])[1].select(F_ID)


@query("fil_12_sample")
def _(spark, d):
    return filters.random_drop(view(spark, d, "fx_frames"), 0.9).select(F_ID)


@query("fil_14_follow", "SELECT f.frame_id FROM fx_frames AS f JOIN (SELECT bssid, min((ts, frame_id)) AS s FROM fx_frames WHERE ftype = 0 AND fsubtype = 8 AND bssid % 4 = 1 GROUP BY bssid) AS l ON f.bssid = l.bssid AND (f.ts, f.frame_id) >= l.s")
def _(spark, d):
    return filters.follow_learned(view(spark, d, "fx_frames"), (F.col("ftype") == 0) & (F.col("fsubtype") == 8) & (F.col("bssid") % 4 == 1))[0].select(F_ID)


RAW_SQL = "SELECT doc_id, hex(encode(text)) AS h FROM documents"


@query("prj_1_strip", f"SELECT doc_id, substr(h, 1, greatest(len(h) - 8, 0)) AS body FROM ({RAW_SQL}) AS r")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.hex(projections.strip_tail(F.encode("text", "UTF-8"))).alias("body"))


@query("prj_1_strip_bytes", f"SELECT doc_id, substr(h, 1, greatest(len(h) - 8, 0)) AS body, substr(h, 1, 48) AS header FROM ({RAW_SQL}) AS r")
def _(spark, d):
    raw = F.encode("text", "UTF-8")
    return table(spark, d, "documents").select("doc_id", F.hex(projections.strip_tail(raw)).alias("body"), F.hex(projections.strip_to_header(raw)).alias("header"))


#: Captures merged by the rules of the merger, one transmission of each content a step; m holds its members in order.
MERGED_SQL = """caps AS (SELECT payload_hash, list(struct_pack(f := frame_id, t := ts_us, s := sniffer_id, c := channel, r := rssi, z := noise, k := is_ctrl, e := err_us) ORDER BY ts_us, sniffer_id, frame_id) AS l FROM fx_captures GROUP BY payload_hash),
rec(payload_hash, l, m) AS (
  SELECT payload_hash, l, l[1:0] FROM caps
  UNION ALL
  SELECT payload_hash, list_filter(l, lambda x: NOT list_contains(list_transform(m, lambda y: y.f), x.f)), m FROM (
    SELECT payload_hash, l, list_filter(cand, lambda x, i: list_position(list_transform(cand, lambda y: y.s), x.s) = i) AS m FROM (
      SELECT payload_hash, l, list_filter(l, lambda x: x.t <= lim AND x.t - x.e <= high) AS cand FROM (
        SELECT payload_hash, l, high, least(high + 250000, coalesce(mid, high + 250000)) AS lim FROM (
          SELECT payload_hash, l, l[1].t + CASE WHEN l[1].k THEN least(l[1].e, 300) ELSE greatest(l[1].e, 250000) END AS high,
                 l[1].t + (list_filter(l, lambda x: x.s = l[1].s AND x.t <> l[1].t)[1].t - l[1].t) // 2 AS mid
          FROM rec WHERE len(l) > 0) AS a) AS b) AS c) AS d),
merged AS (
  SELECT payload_hash, m, m[1].f AS frame_id, m[len(m) // 2 + 1].t AS ts_us,
         list_reduce(list_prepend({'b': -999, 'c': 0}, list_transform(m, lambda x: {'b': x.r - x.z, 'c': x.c})), lambda a, x: CASE WHEN x.b > a.b + 5 THEN x WHEN x.b > a.b - 5 AND x.c <> a.c THEN {'b': a.b, 'c': 0} ELSE a END).c AS channel
  FROM rec WHERE len(m) > 0)"""


@query("prj_2_print", f"WITH RECURSIVE {MERGED_SQL} SELECT frame_id, format('{{}} sniffer={{}} dt={{}} chan={{}} rssi={{}} noise={{}}', frame_id, x.s, x.t - ts_us, x.c, x.r, x.z) AS line FROM (SELECT frame_id, ts_us, unnest(m) AS x FROM merged) AS u")
def _(spark, d):
    return projections.print_merged(state.merge_captures(view(spark, d, "fx_captures")), detailed=True)


@query("prj_3_shift", "SELECT frame_id, US(ts) + 1500000 AS us FROM fx_frames")
def _(spark, d):
    return projections.shift_time(view(spark, d, "fx_frames"), 1_500_000).select(F_ID, F.unix_micros("ts").alias("us"))


@query("src_7_roles", "SELECT flag_desc, count(DISTINCT mac) AS stations FROM fx_station_stats JOIN lu_station_flags ON (flags & flag) > 0 GROUP BY flag_desc")
def _(spark, d):
    roles = joins.bitmask_join(view(spark, d, "fx_station_stats"), "flags", view(spark, d, "lu_station_flags"), "flag")
    return roles.groupBy("flag_desc").agg(F.countDistinct("mac").alias("stations"))


@query("src_7_nodes", "SELECT hostname, coalesce(testbed, 'none') AS testbed, count(*) AS reports, CAST(sum(filt_capt_packets) AS BIGINT) AS packets FROM fx_pcap_stats JOIN lu_nodes USING (node_id) GROUP BY ALL")
def _(spark, d):
    named = view(spark, d, "fx_pcap_stats").join(view(spark, d, "lu_nodes"), "node_id")
    return named.groupBy("hostname", F.coalesce("testbed", F.lit("none")).alias("testbed")).agg(F.count("*").alias("reports"), F.sum("filt_capt_packets").cast("long").alias("packets"))


@query("jn_2_ciphers", "SELECT encryption_desc, count(DISTINCT bssid) AS networks FROM fx_bss_stats JOIN lu_encryptions ON (encryption_types & encryption_id) > 0 GROUP BY encryption_desc")
def _(spark, d):
    return joins.bitmask_join(view(spark, d, "fx_bss_stats"), "encryption_types", view(spark, d, "lu_encryptions"), "encryption_id").groupBy("encryption_desc").agg(F.countDistinct("bssid").alias("networks"))


CHANGES = "SELECT sniffer_id, ts, max(channel) AS channel FROM fx_frames GROUP BY sniffer_id, ts"


@query("jn_8_asof_channel", f"WITH c AS ({CHANGES}) SELECT frame_id, coalesce(c.channel, 0) AS channel FROM fx_frames AS f ASOF LEFT JOIN c ON c.sniffer_id = f.sniffer_id AND f.ts > c.ts")
def _(spark, d):
    out = joins.asof_join(view(spark, d, "fx_frames").select(F_ID, "sniffer_id", "ts"), run_sql(spark, d, CHANGES), ["sniffer_id"], "ts", "ts", ["channel"], strict=True, slice_length=86_400)
    return out.select(F_ID, F.coalesce("asof_channel", F.lit(0)).alias("channel"))


ALL_CHANGES = "SELECT sniffer_id, ts, channel FROM (SELECT *, lag(channel) OVER (PARTITION BY sniffer_id ORDER BY ts) AS previous FROM (SELECT sniffer_id, ts, max(channel) AS channel FROM fx_frames GROUP BY sniffer_id, ts) AS g) AS h WHERE previous IS DISTINCT FROM channel"


@query("jn_8_asof_channel_all", f"WITH c AS ({ALL_CHANGES}) SELECT frame_id, coalesce(c.channel, 0) AS channel FROM fx_frames AS f ASOF LEFT JOIN c ON c.sniffer_id = f.sniffer_id AND f.ts > c.ts")
def _(spark, d):
    out = joins.asof_join(view(spark, d, "fx_frames").select(F_ID, "sniffer_id", "ts"), run_sql(spark, d, ALL_CHANGES), ["sniffer_id"], "ts", "ts", ["channel"], strict=True, slice_length=86_400)
    return out.select(F_ID, F.coalesce("asof_channel", F.lit(0)).alias("channel"))


ADVERTISED = "SELECT bssid, US(ts) AS us, max(channel) AS adv FROM fx_frames WHERE ftype = 0 AND fsubtype = 8 GROUP BY bssid, ts"


@query("jn_9_guess_channel", f"WITH a AS ({ADVERTISED}) SELECT frame_id, coalesce((SELECT CASE WHEN US(f.ts) - max(a.us) < 3600000000 THEN max_by(a.adv, a.us) END FROM a WHERE a.bssid = f.bssid AND a.us <= US(f.ts)), channel) AS channel FROM fx_frames AS f")
def _(spark, d):
    frames = view(spark, d, "fx_frames").select(F_ID, "bssid", "channel", F.unix_micros("ts").alias("us"))
    out = joins.asof_join(frames, run_sql(spark, d, ADVERTISED), ["bssid"], "us", "us", ["adv"], tolerance=F.lit(3_600_000_000), slice_length=86_400_000_000)
    return out.select(F_ID, F.coalesce("asof_adv", "channel").alias("channel"))


ASSOC = "SELECT station_mac, US(ts) AS us, max(bssid) AS ap FROM fx_associations GROUP BY station_mac, ts"


@query("jn_10_infer_bssid", f"WITH s AS ({ASSOC}) SELECT frame_id, coalesce(CASE WHEN bssid < 5 THEN bssid END, (SELECT max_by(s.ap, s.us) FROM s WHERE s.station_mac = f.ta AND s.us <= US(f.ts)), (SELECT max_by(s.ap, s.us) FROM s WHERE s.station_mac = f.ta + 1 AND s.us <= US(f.ts))) AS bssid FROM fx_frames AS f")
def _(spark, d):
    known = run_sql(spark, d, ASSOC)
    frames = view(spark, d, "fx_frames").select(F_ID, F.expr("CASE WHEN bssid < 5 THEN bssid END AS own"), F.col("ta").alias("station_mac"), (F.col("ta") + 1).alias("peer"), F.unix_micros("ts").alias("us"))
    by_source = joins.asof_join(frames, known, ["station_mac"], "us", "us", ["ap"], slice_length=86_400_000_000).withColumnRenamed("asof_ap", "source_ap")
    both = joins.asof_join(by_source.drop("station_mac").withColumnRenamed("peer", "station_mac"), known, ["station_mac"], "us", "us", ["ap"], slice_length=86_400_000_000)
    return both.select(F_ID, F.coalesce("own", "source_ap", "asof_ap").alias("bssid"))


@query("jn_11_ports", f"SELECT low, high, sniffer_id, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM fx_frames JOIN {RANGES_SQL} ON sport BETWEEN low AND high OR dport BETWEEN low AND high GROUP BY low, high, sniffer_id")
def _(spark, d):
    return joins.range_count(view(spark, d, "fx_frames"), RANGES, ["sport", "dport"], ["sniffer_id"], {"packets": F.count("*"), "bytes": F.sum("length").cast("long")})


@query("jn_12_nodes", "SELECT c_custkey, n_nationkey AS node_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 20")
def _(spark, d):
    nodes = table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("hostname"), F.col("n_nationkey").alias("node_id"))
    return joins.node_lookup(table(spark, d, "customer").withColumn("host", F.col("c_nationkey").cast("string")), nodes)[0].select("c_custkey", "node_id")


@query("jn_13_alerts", "SELECT a.src_mac, US(a.ts) AS us, a.sig_id, (SELECT max_by(f.sniffer_id, (f.ts, f.frame_id)) FROM fx_frames AS f WHERE f.ftype <> 1 AND f.ta = a.src_mac AND f.ts <= a.ts AND US(a.ts) - US(f.ts) < 86400000000) AS sniffer_id FROM fx_alerts AS a")
def _(spark, d):
    alerts = view(spark, d, "fx_alerts").select("src_mac", F.unix_micros("ts").alias("us"), "sig_id")
    seen = view(spark, d, "fx_frames").filter("ftype <> 1").select(F.col("ta").alias("src_mac"), F.unix_micros("ts").alias("us"), F_ID, "sniffer_id")
    out = joins.asof_join(alerts, seen, ["src_mac"], "us", "us", ["frame_id", "sniffer_id"], tolerance=F.lit(86_400_000_000), slice_length=86_400_000_000)
    return out.select("src_mac", "us", "sig_id", F.col("asof_sniffer_id").alias("sniffer_id"))


PAIRS_SQL = "pairs AS (SELECT frame_id, ts_us, x.s AS src, y.s AS dst, y.t - x.t AS skew_us FROM (SELECT frame_id, ts_us, x, unnest(m) AS y FROM (SELECT frame_id, ts_us, m, unnest(m) AS x FROM merged) AS a) AS b WHERE x.s <> y.s)"


@query("jn_14_skew_pairs", f"WITH RECURSIVE {MERGED_SQL}, {PAIRS_SQL} SELECT frame_id, src, dst, skew_us FROM pairs")
def _(spark, d):
    return joins.skew_pairs(state.merge_captures(view(spark, d, "fx_captures")))


@query("jn_15_compare", "SELECT count(*) AS records, count(*) FILTER (WHERE y IS NULL) AS only_first, count(*) FILTER (WHERE x IS NULL) AS only_second, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL AND a.length <> b.length) AS differs_length, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL AND a.ch <> b.ch) AS differs_channel FROM (SELECT frame_id AS x, length, channel AS ch FROM fx_frames WHERE frame_id % 10 <> 0) AS a FULL JOIN (SELECT frame_id AS y, length - CAST(frame_id % 2 AS INT) AS length, channel AS ch FROM fx_frames WHERE frame_id % 7 <> 0) AS b ON x = y")
def _(spark, d):
    f = view(spark, d, "fx_frames")
    return joins.compare_records(f.filter("frame_id % 10 <> 0"), f.filter("frame_id % 7 <> 0").withColumn("length", F.expr("length - cast(frame_id % 2 as int)")), F_ID, ["length", "channel"])


@query("jn_16_routes", "SELECT verdict, count(*) AS frames FROM (SELECT CASE WHEN b IS NULL THEN 'no_bssid' WHEN b % 3 = 0 THEN 'no_owner' WHEN b % 7 <> sniffer_id THEN 'wrong_sender' ELSE 'ok' END AS verdict FROM (SELECT nullif(bssid, 4) AS b, sniffer_id FROM fx_frames) AS x) AS v GROUP BY verdict")
def _(spark, d):
    f = view(spark, d, "fx_frames").withColumn("bssid", F.nullif("bssid", F.lit(4)))
    owners = f.filter("bssid % 3 <> 0").select("bssid", (F.col("bssid") % 7).cast("int").alias("owner")).distinct()
    return joins.check_routes(f, owners).groupBy("verdict").agg(F.count("*").alias("frames"))


SUBTYPED = "SELECT * EXCLUDE (fsubtype), CASE WHEN ftype = 2 THEN CAST(frame_id % 16 AS INT) ELSE fsubtype END AS fsubtype FROM fx_frames"
_CLASS_SQL = ", ".join(f"count(*) FILTER (WHERE {t}) AS {n}_packets, CAST(coalesce(sum(length) FILTER (WHERE {t}), 0) AS BIGINT) AS {n}_bytes" for n, t in (("mgmt", "ftype = 0"), ("ctrl", "ftype = 1"), ("data", "ftype = 2"), ("null_data", "ftype = 2 AND fsubtype IN (4, 5, 6, 7, 12, 13, 14, 15)"), ("beacon", "ftype = 0 AND fsubtype = 8"), ("encrypted", "ftype = 2 AND protected")))


@query("agg_1_classes", f"SELECT sniffer_id, {_CLASS_SQL} FROM ({SUBTYPED}) AS f GROUP BY sniffer_id")
def _(spark, d):
    # every subtype of data frames
    f = view(spark, d, "fx_frames").withColumn("fsubtype", F.expr("CASE WHEN ftype = 2 THEN CAST(frame_id % 16 AS INT) ELSE fsubtype END"))
    return aggregates.class_counts(f, keys=["sniffer_id"])


@query("agg_2_field_sum", f"SELECT CAST(sum(v) AS BIGINT) AS total, count(v) AS n FROM (SELECT CAST('0x' || substr(h, 5, 2) || substr(h, 3, 2) AS BIGINT) AS v FROM ({RAW_SQL}) AS r WHERE len(h) >= 6) AS x")
def _(spark, d):
    rows = table(spark, d, "documents").withColumn("v", aggregates.bytes_as_integer(F.encode("text", "UTF-8"), 1, 2, little_endian=True))
    return rows.agg(F.sum("v").alias("total"), F.count("v").alias("n"))


@query("agg_2_field_sum_bytes", f"SELECT CAST(sum(v) AS BIGINT) AS total, count(v) AS n FROM (SELECT CAST('0x' || substr(h, 3, 4) AS BIGINT) AS v FROM ({RAW_SQL}) AS r WHERE len(h) >= 6) AS x")
def _(spark, d):
    rows = table(spark, d, "documents").withColumn("v", aggregates.bytes_as_integer(F.encode("text", "UTF-8"), 1, 2))
    return rows.agg(F.sum("v").alias("total"), F.count("v").alias("n"))


@query("agg_3_unique", "SELECT min(frame_id) AS frame_id, ta FROM fx_frames GROUP BY ta")
def _(spark, d):
    return filters.first_per_key(view(spark, d, "fx_frames"), ["ta"], [F_ID]).select(F_ID, "ta")


@query("agg_4_intervals", "SELECT US(ts) // 10000000 * 10000000 AS start_us, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM fx_frames GROUP BY 1")
def _(spark, d):
    out = aggregates.interval_counts(view(spark, d, "fx_frames"), interval="10 seconds", measures={"packets": F.count("*"), "bytes": F.sum("length").cast("long")})
    return out.select(F.unix_micros("start").alias("start_us"), "packets", "bytes")


@query("agg_5_traffic", "SELECT US(ts) // 3600000000 * 3600000000 AS start_us, sniffer_id, proto, count(*) AS packets, CAST(sum(length - 34) + max_by(34, -frame_id) AS BIGINT) AS bytes FROM (SELECT *, CAST(frame_id % 3 AS INT) AS proto FROM fx_frames) AS x GROUP BY 1, 2, 3")
def _(spark, d):
    f = view(spark, d, "fx_frames").withColumns({"proto": (F.col(F_ID) % 3).cast("int"), "ip_len": F.col("length") - 34})
    out = aggregates.ip_traffic(f, "1 hour", ["sniffer_id", "proto"], [F_ID], first_packet_quirk=True)
    return out.select(F.unix_micros("start").alias("start_us"), "sniffer_id", "proto", "packets", "bytes")


LAYERS = "SELECT frame_id, ts, sniffer_id, length, ftype, fsubtype, sport, dport, CASE frame_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 2054 ELSE 2048 END AS ethertype, CASE frame_id % 7 WHEN 2 THEN 1 WHEN 3 THEN 6 WHEN 4 THEN 6 WHEN 5 THEN 17 WHEN 6 THEN 47 END AS ip_proto, CASE WHEN frame_id % 7 > 1 THEN length - 24 END AS ip_len, CASE WHEN frame_id % 7 > 1 THEN 20 + 4 * CAST(frame_id % 2 AS INT) END AS ip_hl FROM fx_frames"
_PORTS = {"tcp": [(80, 80), (1, 65535), (6881, 6889)], "udp": [(53, 53), (1, 1023)]}
_PORTS_SQL = " UNION ALL ".join(f"SELECT ts, frame_id, sniffer_id, '{k}', {a}, {b}, ip_len - ip_hl FROM l WHERE ip_proto = {n} AND (sport BETWEEN {a} AND {b} OR dport BETWEEN {a} AND {b})" for k, n in (("tcp", 6), ("udp", 17)) for a, b in _PORTS[k])


@query("agg_5_layers", f"WITH l AS ({LAYERS}), c AS (SELECT ts, frame_id, sniffer_id, 'ether' AS kind, ethertype AS code, NULL::INT AS high, length AS size FROM l WHERE ethertype IS NOT NULL UNION ALL SELECT ts, frame_id, sniffer_id, 'wifi', ftype + 4 * fsubtype, NULL, length FROM l UNION ALL SELECT ts, frame_id, sniffer_id, 'ip', ip_proto, NULL, CASE WHEN row_number() OVER (PARTITION BY US(ts) // 3600000000, sniffer_id, ip_proto ORDER BY frame_id) = 1 THEN length ELSE ip_len END FROM l WHERE ip_proto IS NOT NULL UNION ALL {_PORTS_SQL}) SELECT US(ts) // 3600000000 * 3600000000 AS start_us, sniffer_id, kind, code, high, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes FROM c GROUP BY ALL")
def _(spark, d):
    out = aggregates.traffic_counts(run_sql(spark, d, LAYERS), "1 hour", _PORTS, ["sniffer_id"])
    return out.select(F.unix_micros("start").alias("start_us"), "sniffer_id", "kind", "code", "high", "packets", "bytes")


@query("agg_6_channels", "SELECT channel, count(*) AS packets, count(DISTINCT bssid) AS aps FROM fx_frames GROUP BY channel")
def _(spark, d):
    return view(spark, d, "fx_frames").groupBy("channel").agg(F.count("*").alias("packets"), F.countDistinct("bssid").alias("aps"))


@query("agg_7_median", "SELECT sniffer_id, quantile_disc(length, 0.5) AS median FROM fx_frames GROUP BY sniffer_id")
def _(spark, d):
    return view(spark, d, "fx_frames").groupBy("sniffer_id").agg(aggregates.lower_median("length").alias("median"))


@query("agg_13_cdf", "SELECT CAST(i AS INT) AS point, v[CAST(floor((i + 1) * (len(v) - 1) / 20) AS BIGINT) + 1] AS value FROM (SELECT list_sort(list(length)) AS v FROM fx_frames) AS a, range(20) AS r(i)")
def _(spark, d):
    return aggregates.cdf_points(view(spark, d, "fx_frames"), "length", 20)


@query("agg_14_home", "WITH c AS (SELECT bssid, sniffer_id, count(*) FILTER (WHERE ftype = 1 AND bssid > 9) AS a, count(*) AS b FROM fx_frames GROUP BY ALL), r AS (SELECT *, max(a) OVER (PARTITION BY bssid) AS ma, max(b) OVER (PARTITION BY bssid) AS mb FROM c) SELECT bssid, min(sniffer_id) AS sniffer_id FROM r WHERE ma > 0 AND a = ma OR ma = 0 AND b = mb GROUP BY bssid")
def _(spark, d):
    counts = view(spark, d, "fx_frames").groupBy("bssid", "sniffer_id").agg(F.count_if((F.col("ftype") == 1) & (F.col("bssid") > 9)).alias("a"), F.count("*").alias("b"))
    return aggregates.best_observer(counts, "bssid", "sniffer_id", ["a", "b"])


RATES = "SELECT bssid, sniffer_id, CAST(sum(length) AS DOUBLE) AS rate FROM fx_frames GROUP BY bssid, sniffer_id"


OWNERS = "SELECT bssid, sniffer_id, CAST(sum(length) AS DOUBLE) AS rate, CAST(count(*) * (bssid % 5) AS DOUBLE) AS seconds FROM fx_frames GROUP BY bssid, sniffer_id"
# every third network has no owner yet; owners may hear nothing, and one network is not heard at all
OWNED = "SELECT DISTINCT bssid, CAST(bssid % 9 AS INT) AS owner FROM fx_frames WHERE bssid % 3 > 0 UNION ALL SELECT 999, 4"
OWNER_SQL = f"WITH r AS ({OWNERS}), b AS (SELECT bssid, max((rate, sniffer_id)) AS m FROM r GROUP BY bssid HAVING max(seconds) >= 20), o AS ({OWNED}), j AS (SELECT coalesce(b.bssid, o.bssid) AS bssid, m, owner, coalesce((SELECT rate FROM r WHERE r.bssid = o.bssid AND r.sniffer_id = o.owner), 0) AS own FROM b FULL JOIN o ON b.bssid = o.bssid) SELECT bssid, CASE WHEN owner IS NULL {{moves}} THEN m[2] ELSE owner END AS owner FROM j"


def _owner(sticky: bool):
    def run(spark, d):
        return aggregates.owner_with_hysteresis(run_sql(spark, d, OWNERS), run_sql(spark, d, OWNED), duration="seconds", least_duration=20, ratio=1.05, margin=100.0, sticky=sticky)

    return run


query("agg_15_owner", OWNER_SQL.format(moves=""))(_owner(True))
query("agg_15_moving_owner", OWNER_SQL.format(moves="OR m IS NOT NULL AND m[1] >= own * 1.05 AND m[1] >= own + 100"))(_owner(False))


# hosts are nations: straight on inside a region, else to the next number; one region is wired, host 0 coordinates, some have no route
HOP = "SELECT CAST(a.n_nationkey AS BIGINT) AS src, CAST(b.n_nationkey AS BIGINT) AS dst, CAST(CASE WHEN a.n_regionkey = b.n_regionkey THEN b.n_nationkey WHEN b.n_nationkey > a.n_nationkey THEN a.n_nationkey + 1 ELSE a.n_nationkey - 1 END AS BIGINT) AS gateway FROM nation AS a, nation AS b WHERE a.n_nationkey <> b.n_nationkey AND (a.n_nationkey * 7 + b.n_nationkey) % 31 <> 3"
WIRED = "SELECT CAST(a.n_nationkey AS BIGINT) AS src, CAST(b.n_nationkey AS BIGINT) AS dst FROM nation AS a, nation AS b WHERE a.n_nationkey <> b.n_nationkey AND a.n_regionkey = 3 AND b.n_regionkey = 3"
PAIRS = "SELECT CAST(s_suppkey % 25 AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(sum(floor(s_acctbal) + 2000) AS DOUBLE) AS bytes FROM supplier WHERE s_suppkey % 25 <> s_nationkey GROUP BY 1, 2"
WALK_SQL = f"""hop AS (SELECT src, dst, gateway, FALSE AS wired FROM ({HOP}) AS h WHERE (src, dst) NOT IN ({WIRED}) UNION ALL SELECT src, dst, dst, TRUE FROM ({WIRED}) AS w),
traffic AS ({PAIRS}),
walk(src, dst, here, n, links, wired) AS (
  SELECT src, dst, src, 0, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]), TRUE FROM traffic
  UNION ALL
  SELECT w.src, w.dst, h.gateway, n + 1, CASE WHEN h.gateway = 0 THEN links ELSE list_append(links, {{'a': least(here, h.gateway), 'b': greatest(here, h.gateway)}}) END, w.wired AND h.wired
  FROM walk AS w JOIN hop AS h ON h.src = w.here AND h.dst = w.dst WHERE here <> w.dst AND n < 20 AND (h.gateway <> 0 OR w.dst = 0)),
paths AS (SELECT src, dst, CASE WHEN wired THEN links[1:0] ELSE links END AS links FROM walk WHERE here = dst)"""


def _walk(spark, d, traffic: DataFrame) -> DataFrame:
    return graph.walk_routes(traffic.select("src", "dst").distinct(), run_sql(spark, d, HOP), wired=run_sql(spark, d, WIRED), coordinator=0)[0]


@query("gra_2_walk", f"WITH RECURSIVE {WALK_SQL} SELECT src, dst, len(links) AS hops, list_aggregate(list_transform(links, lambda x: concat(x.a, '-', x.b)), 'string_agg', ' ') AS links FROM paths")
def _(spark, d):
    text = F.array_join(F.transform("links", lambda x: F.concat_ws("-", x["a"], x["b"])), " ")
    return _walk(spark, d, run_sql(spark, d, PAIRS)).select("src", "dst", F.size("links").cast("long").alias("hops"), F.when(F.size("links") > 0, text).alias("links"))


@query("gra_2_lost", f"WITH RECURSIVE {WALK_SQL} SELECT src, dst FROM traffic WHERE (src, dst) NOT IN (SELECT src, dst FROM paths)")
def _(spark, d):
    traffic = run_sql(spark, d, PAIRS).select("src", "dst")
    return graph.walk_routes(traffic, run_sql(spark, d, HOP), wired=run_sql(spark, d, WIRED), coordinator=0)[1]


@query("agg_16_links", f"WITH RECURSIVE {WALK_SQL} SELECT x.a AS a, x.b AS b, sum(bytes) AS bytes FROM (SELECT bytes, unnest(links) AS x FROM paths JOIN traffic USING (src, dst)) AS u GROUP BY 1, 2")
def _(spark, d):
    traffic = run_sql(spark, d, PAIRS)
    return aggregates.link_load(traffic, _walk(spark, d, traffic))


@query("agg_18_wire", "SELECT sniffer_id, (sum(length) + count(*) * 88) * 0.35e0 AS wire FROM fx_frames GROUP BY sniffer_id")
def _(spark, d):
    return view(spark, d, "fx_frames").groupBy("sniffer_id").agg(aggregates.bytes_on_wire(F.sum("length"), F.count("*")).alias("wire"))


@query("agg_19_status", "WITH m AS (SELECT ta AS host, ts, frame_id, length FROM fx_frames), n AS (SELECT *, US(ts) - lag(US(ts)) OVER (PARTITION BY host ORDER BY ts, frame_id) AS gap FROM m) SELECT host, max_by(length, (ts, frame_id)) AS cpu, CAST(sum(length) AS BIGINT) AS bytes, US(max(ts)) AS last_us, greatest(10.0::DOUBLE, coalesce(sum(gap) FILTER (WHERE gap < 7200000000), 0) / 1e6) AS uptime, US(max(ts)) > US(TIMESTAMP '2024-01-30 12:00:00') - 7200000000 AS online FROM n GROUP BY host")
def _(spark, d):
    m = view(spark, d, "fx_frames").select(F.col("ta").alias("host"), "ts", F_ID, F.col("length").alias("cpu"), F.col("length").cast("long").alias("bytes"))
    out = aggregates.host_status(m, F.lit("2024-01-30 12:00:00").cast("timestamp"), last=["cpu"], sums=["bytes"], gap=7200, order=[F_ID])
    return out.select("host", "cpu", "bytes", F.unix_micros("last_seen").alias("last_us"), "uptime", "online")


@query("agg_21_loss", "SELECT host, CAST(sum(CASE WHEN k < 2 THEN length ELSE -length END) AS BIGINT) AS unaccounted FROM (SELECT sniffer_id AS host, frame_id % 6 AS k, length FROM fx_frames) AS x GROUP BY host")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("captured", "in", "waitq_drops", "drops", "produced", "out"))), (F.col(F_ID) % 6 + 1).cast("int"))
    return aggregates.loss_accounting(view(spark, d, "fx_frames").select(F.col("sniffer_id").alias("host"), kind.alias("kind"), F.col("length").cast("long").alias("n")))


@query("win_1_inferred", "WITH l AS (SELECT ta, seq, retry, lag(seq) OVER (PARTITION BY ta ORDER BY ts, frame_id) AS p FROM fx_frames WHERE ftype <> 1), g AS (SELECT ta, CASE WHEN p IS NULL THEN CASE WHEN seq < 8 THEN seq ELSE 1 END WHEN p <= seq THEN seq - p WHEN p - seq < 3 AND retry THEN 0 ELSE seq + 4096 - p END AS gap FROM l), a AS (SELECT DISTINCT ta FROM fx_frames) SELECT a.ta, count(gap) AS captured, CAST(coalesce(sum(CASE WHEN gap = 0 THEN 1 ELSE gap END), 0) AS BIGINT) AS inferred FROM a LEFT JOIN g ON g.ta = a.ta GROUP BY a.ta")
def _(spark, d):
    return windows.inferred_packets(view(spark, d, "fx_frames"), slice_seconds=86_400)


PINGS = "SELECT ta AS source, ts, frame_id AS event_id, CASE WHEN frame_id % 10 = 9 THEN 0 ELSE frame_id % 400 END AS seq, length AS delay FROM fx_frames"


@query("win_2_pings", f"WITH p AS ({PINGS}), n AS (SELECT *, row_number() OVER w AS k, sum(CASE WHEN seq = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p WINDOW w AS (PARTITION BY source ORDER BY ts, event_id)), h AS (SELECT *, max(seq) OVER (PARTITION BY source, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM n), g AS (SELECT *, high IS NULL OR seq > high AS fresh FROM h) SELECT source, count(*) FILTER (WHERE fresh) AS received, CAST(sum(CASE WHEN k = 1 THEN seq WHEN seq = 0 OR NOT fresh THEN 0 ELSE seq - high - 1 END) AS BIGINT) AS dropped, count(*) FILTER (WHERE NOT fresh) AS duplicates, list_reduce(list(CAST(delay AS DOUBLE) ORDER BY k) FILTER (WHERE fresh), lambda m, x: m + (x - m) / 16) AS avg_delay FROM g GROUP BY source")
def _(spark, d):
    return windows.ping_loss(run_sql(spark, d, PINGS), delay="delay", slice_seconds=86_400)


@query("win_3_sessions", "WITH g AS (SELECT src_mac, http_host, ts, CASE WHEN US(ts) - lag(US(ts)) OVER w <= 86400000000 THEN 0 ELSE 1 END AS n FROM fx_web_requests WINDOW w AS (PARTITION BY src_mac, http_host ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY src_mac, http_host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT src_mac, http_host, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS requests FROM s GROUP BY src_mac, http_host, session")
def _(spark, d):
    return windows.session_summary(view(spark, d, "fx_web_requests"), ["src_mac", "http_host"], gap_seconds=86_400, slice_seconds=432_000)


@query("win_4_rolling", "WITH r AS (SELECT frame_id, list_sort(list(length) OVER (PARTITION BY ta ORDER BY ts, frame_id ROWS 10 PRECEDING)) AS v FROM fx_frames) SELECT frame_id, v[len(v) // 2 + 1] AS median, v[len(v)] - v[1] AS spread FROM r")
def _(spark, d):
    return windows.rolling_median(view(spark, d, "fx_frames"), ["ta"], ["ts", F_ID], "length").select(F_ID, "median", "spread")


@query("win_5_duration", "SELECT frame_id, coalesce(CAST(floor((US(ts) - lag(US(ts)) OVER (PARTITION BY sniffer_id ORDER BY ts, frame_id)) / 1000) AS BIGINT), 10000) AS duration_msec FROM fx_frames")
def _(spark, d):
    return windows.report_duration(view(spark, d, "fx_frames"), ["sniffer_id"], order=[F_ID], slice_seconds=86_400).select(F_ID, F.col("duration_msec").cast("long").alias("duration_msec"))


@query("win_6_averages", "SELECT frame_id, avg(length) OVER (PARTITION BY sniffer_id ORDER BY ts, frame_id ROWS 9 PRECEDING) AS avg_10, avg(length) OVER (PARTITION BY sniffer_id ORDER BY ts, frame_id ROWS 59 PRECEDING) AS avg_60 FROM fx_frames")
def _(spark, d):
    return windows.moving_averages(view(spark, d, "fx_frames"), ["sniffer_id"], ["ts", F_ID], "length", (10, 60), slice_seconds=86_400).select(F_ID, "avg_10", "avg_60")


@query("win_7_fidelity", "WITH s AS (SELECT bssid, sniffer_id, US(ts) // 86400000000 AS slot, least(1.0::DOUBLE, count(*) / 24.0::DOUBLE) AS share FROM fx_frames WHERE ftype = 0 GROUP BY ALL), f AS (SELECT bssid, sniffer_id, list_reduce(list(share ORDER BY slot), lambda m, x: m + (x - m) / 16) AS fidelity FROM s GROUP BY ALL) SELECT * FROM f WHERE fidelity >= 0.01")
def _(spark, d):
    return windows.fidelity(view(spark, d, "fx_frames").filter("ftype = 0"), bcn_int_us=3_600_000_000, interval_seconds=86_400, threshold=0.01)


@query("win_8_dwell", "WITH c AS (SELECT sniffer_id, channel, US(lead(ts) OVER (PARTITION BY sniffer_id ORDER BY ts, frame_id)) - US(ts) AS us FROM fx_frames) SELECT sniffer_id, channel, sum(us) / 1e6 AS dwell_sec FROM c WHERE us IS NOT NULL GROUP BY sniffer_id, channel")
def _(spark, d):
    return windows.channel_dwell(view(spark, d, "fx_frames").select("sniffer_id", "channel", "ts", F_ID), order=[F_ID], slice_seconds=86_400)


@query("win_9_shares", "WITH RECURSIVE c AS (SELECT sniffer_id, channel, US(lead(ts) OVER (PARTITION BY sniffer_id ORDER BY ts, frame_id)) - US(ts) AS us FROM fx_frames), w AS (SELECT sniffer_id, channel, sum(us) / 1e6 AS dwell FROM c WHERE us IS NOT NULL GROUP BY ALL), n AS (SELECT sniffer_id, channel, count(*) AS n FROM fx_frames GROUP BY ALL), r AS (SELECT sniffer_id, channel, CASE WHEN dwell > 0 THEN n / dwell ELSE 0 END AS rate FROM w JOIN n USING (sniffer_id, channel)), k AS (SELECT *, row_number() OVER (PARTITION BY sniffer_id ORDER BY rate, channel) AS i, sum(rate) OVER (PARTITION BY sniffer_id) AS total FROM r), t(sniffer_id, i, channel, leftover, rates, share) AS (SELECT DISTINCT sniffer_id, 0::BIGINT, 0, 1.0::DOUBLE, total::DOUBLE, 0.0::DOUBLE FROM k UNION ALL SELECT k.sniffer_id, k.i, k.channel, t.leftover - greatest(0.02, t.leftover * k.rate / t.rates), t.rates - k.rate, greatest(0.02, t.leftover * k.rate / t.rates) FROM t JOIN k ON k.sniffer_id = t.sniffer_id AND k.i = t.i + 1) SELECT sniffer_id, channel, round(share, 9) AS share FROM t WHERE i > 0")
def _(spark, d):
    f = view(spark, d, "fx_frames").select("sniffer_id", "channel", "ts", F_ID)
    dwell = windows.channel_dwell(f, order=[F_ID])
    counts = f.groupBy("sniffer_id", "channel").agg(F.count("*").alias("n"))
    rates = dwell.join(counts, ["sniffer_id", "channel"]).select("sniffer_id", "channel", F.when(F.col("dwell_sec") > 0, F.col("n") / F.col("dwell_sec")).otherwise(F.lit(0.0)).alias("rate"))
    return windows.channel_shares(rates).withColumn("share", F.round("share", 9))


@query("srt_1_late", "SELECT frame_id FROM fx_frames WHERE length % 10 >= 5")
def _(spark, d):
    f = view(spark, d, "fx_frames").withColumn("arrival_ts", F.timestamp_micros(F.unix_micros("ts") + F.expr("cast(length % 10 as long) * 1000000")))
    return windows.time_order(f, arrival_ts="arrival_ts")[1].select(F_ID)


@query("set_1_union", "SELECT sniffer_id, count(*) AS n FROM (SELECT sniffer_id FROM fx_frames UNION ALL SELECT sniffer_id FROM fx_captures) AS u GROUP BY sniffer_id")
def _(spark, d):
    return view(spark, d, "fx_frames").select("sniffer_id").unionByName(view(spark, d, "fx_captures").select("sniffer_id")).groupBy("sniffer_id").agg(F.count("*").alias("n"))


@query("fn_2_escape", "SELECT DISTINCT text AS raw, CASE WHEN regexp_matches(text, '[^\\x20-\\x21\\x23-\\x7E]') THEN hex(encode(text)) ELSE text END AS ssid FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("text").alias("raw")).distinct().select("raw", scalars.escape_ssid(F.col("raw")).alias("ssid"))


@query("fn_2_escape_all", "SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\x20-\\x21\\x23-\\x7E]') THEN hex(encode(text)) ELSE text END AS ssid FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.escape_ssid(F.col("text")).alias("ssid"))


@query("fn_4_addresses", "SELECT frame_id, CASE frame_id % 4 WHEN 0 THEN a2 WHEN 1 THEN a2 WHEN 2 THEN a3 ELSE a4 END AS sa, CASE frame_id % 4 WHEN 0 THEN a1 WHEN 1 THEN a3 WHEN 2 THEN a1 ELSE a3 END AS da, CASE frame_id % 4 WHEN 0 THEN a3 WHEN 1 THEN a1 WHEN 2 THEN a2 END AS bssid FROM (SELECT frame_id, concat('a', ta) AS a1, concat('b', bssid) AS a2, concat('c', sniffer_id) AS a3, concat('d', channel) AS a4 FROM fx_frames) AS x")
def _(spark, d):
    f = view(spark, d, "fx_frames").select(F_ID, *(F.concat(F.lit(p), F.col(c).cast("string")).alias(n) for p, c, n in (("a", "ta", "a1"), ("b", "bssid", "a2"), ("c", "sniffer_id", "a3"), ("d", "channel", "a4"))))
    got = scalars.addresses(F.col(F_ID) % 4, *(F.col(f"a{i}") for i in range(1, 5)))
    return f.select(F_ID, *(got[k].alias(k) for k in ("sa", "da", "bssid")))


def _cipher_codes(spark, d) -> DataFrame:
    """The bits of a number as codes, some of them twice; null or empty for some."""
    bits = F.filter(F.array(*map(F.lit, (1, 2, 4, 8, 16))), lambda b: F.col("n").bitwiseAND(b) != 0)
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 37 != 5, (F.col("event_id") * 31 + F.col("user_id")) % 32).cast("int").alias("n"))
    return rows.select("event_id", F.when(F.col("n").isNotNull(), F.when(F.col("event_id") % 3 == 0, F.concat(bits, bits)).otherwise(bits)).alias("codes"))


@query("fn_5_cipher_bits", "SELECT event_id, CASE WHEN event_id % 37 <> 5 THEN CAST((event_id * 31 + user_id) % 32 AS INT) END AS bits FROM events")
def _(spark, d):
    return _cipher_codes(spark, d).select("event_id", scalars.cipher_bits(F.col("codes")).alias("bits"))


@query("fn_5_cipher_sums", "SELECT event_id, CASE WHEN event_id % 37 <> 5 THEN CAST((event_id * 31 + user_id) % 32 * CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS INT) END AS bits FROM events")
def _(spark, d):
    return _cipher_codes(spark, d).select("event_id", scalars.cipher_bits(F.col("codes"), sum_repeats=True).alias("bits"))


@query("fn_6_cipher_names", "SELECT bssid, CASE WHEN encryption_types = 0 THEN 'none' ELSE coalesce((SELECT string_agg(encryption_desc, ',' ORDER BY encryption_id) FROM lu_encryptions WHERE (encryption_id & encryption_types) > 0), '') END AS names FROM fx_bss_stats")
def _(spark, d):
    return view(spark, d, "fx_bss_stats").select("bssid", scalars.cipher_names(F.col("encryption_types")).alias("names"))


HOSTS = "SELECT page_id, concat(CASE page_id % 9 WHEN 1 THEN 'WWW.' WHEN 2 THEN 'mail.google.' WHEN 3 THEN 'a.co.uk.' WHEN 4 THEN '10.0.' ELSE '' END, CASE WHEN page_id % 9 = 2 THEN 'com' WHEN page_id % 9 = 3 THEN 'x.co.nz' WHEN page_id % 9 = 4 THEN '0.7' WHEN page_id % 9 = 8 THEN 'localhost' ELSE regexp_extract(url, '://([^/?#]*)', 1) END, CASE page_id % 5 WHEN 1 THEN ':80' WHEN 2 THEN ':8080' WHEN 3 THEN ':22' ELSE '' END) AS h FROM pages"


@query("fn_7_site", f"SELECT page_id, CASE WHEN n = '' OR len(l) < 2 OR regexp_full_match(n, '[0-9.]+') THEN NULL WHEN len(l) >= 3 AND (regexp_matches(n, '\\.co\\.[a-z]{{2}}$') OR regexp_matches(n, '(^|\\.)(google|amazon|live)\\.[a-z.]+$')) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS site FROM (SELECT page_id, n, string_split(n, '.') AS l FROM (SELECT page_id, lower(regexp_extract(h, '^([^:]*)(?::0*(?:80|3128|8080|8088))?$', 1)) AS n FROM ({HOSTS}) AS a) AS b) AS c")
def _(spark, d):
    return run_sql(spark, d, HOSTS).select("page_id", scalars.site_of_host(F.col("h")).alias("site"))


@query("fn_7_visits", "WITH s AS (SELECT page_id, coalesce(CASE n % 4 WHEN 1 THEN concat('site', (n + 1) % 10, '.com') END, concat('site', n, '.com')) AS site FROM (SELECT page_id, page_id % 10 AS n FROM pages) AS p) SELECT page_id, site FROM s WHERE site NOT IN ('site4.com', 'site6.com')")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("site"), F.col("page_id") % 10, F.lit(".com")).alias("site"))
    remap = spark.createDataFrame([(f"site{n}.com", f"site{(n + 1) % 10}.com") for n in (1, 5, 9)], "site string, target string")
    return scalars.user_sites(pages, "site", remap, spark.createDataFrame([("site4.com",), ("site6.com",)], "site string"))


@query("fn_8_search", "SELECT page_id, nullif(regexp_extract(url, '[?&](ref=([^&#]{1,}))', 1), '') AS term FROM pages")
def _(spark, d):
    fake = F.regexp_replace("url", "([?&])ref=", "$1q=")
    return table(spark, d, "pages").select("page_id", F.regexp_replace(scalars.search_query(fake, F.lit("www.example.com")), "^q=", "ref=").alias("term"))


@query("fn_11_multicast", "SELECT event_id, CASE WHEN event_id % 31 <> 2 THEN (event_id * 7 + user_id) % 2 = 1 END AS multicast FROM events")
def _(spark, d):
    first = F.lpad(F.hex((F.col("event_id") * 7 + F.col("user_id")) % 256), 2, "0")
    mac = F.when(F.col("event_id") % 31 != 2, F.concat(F.when(F.col("event_id") % 2 == 0, F.lower(first)).otherwise(first), F.lit(":00:5e:00:00:01")))
    return table(spark, d, "events").select("event_id", scalars.is_multicast(mac).alias("multicast"))


RECORD_TEXTS = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '|' WHEN 3 THEN concat(' a=', CAST(event_id AS VARCHAR(12))) WHEN 4 THEN concat('a=', CAST(event_id AS VARCHAR(12)), ' || b=', CAST(user_id AS VARCHAR(12)), '|') ELSE concat('a=', CAST(event_id AS VARCHAR(12)), ' | b=', CAST(user_id AS VARCHAR(12)), '|c') END AS t FROM events"


@query("fn_13_records", f"SELECT event_id, trim(unnest(string_split(t, '|'))) AS record FROM ({RECORD_TEXTS}) AS r")
def _(spark, d):
    return run_sql(spark, d, RECORD_TEXTS).select("event_id", F.explode(scalars.split_records(F.col("t"))).alias("record"))


@query("fn_16_midpoint", "SELECT frame_id, least(ts_us, frame_id) + CAST(floor(abs(ts_us - frame_id) / 2) AS BIGINT) AS mid FROM fx_captures")
def _(spark, d):
    return view(spark, d, "fx_captures").select(F_ID, scalars.midpoint(F.col("ts_us"), F.col(F_ID)).alias("mid"))


@query("fn_19_geo", "WITH g AS (SELECT event_id, user_id AS bssid, CASE WHEN event_id % 10 = 0 THEN 0.0::DOUBLE ELSE value END AS lat, 0.0::DOUBLE AS lon, CASE event_id % 7 WHEN 0 THEN 'infra' WHEN 1 THEN 'adhoc' WHEN 2 THEN 'probe' ELSE 'other' END AS kind FROM events), p AS (SELECT *, max(CASE WHEN kind = 'infra' THEN 1 ELSE 0 END) OVER (PARTITION BY bssid) AS i FROM g WHERE lat <> 0 OR lon <> 0) SELECT event_id FROM p WHERE CASE WHEN i = 1 THEN kind = 'infra' ELSE kind NOT IN ('adhoc', 'probe') END")
def _(spark, d):
    g = table(spark, d, "events").selectExpr("event_id", "user_id as bssid", "case when event_id % 10 = 0 then 0d else value end as lat", "0d as lon", "case event_id % 7 when 0 then 'infra' when 1 then 'adhoc' when 2 then 'probe' else 'other' end as kind")
    return scalars.geo_candidates(g).select("event_id")


@query("str_1_merge", f"WITH RECURSIVE {MERGED_SQL} SELECT frame_id, payload_hash, ts_us, channel, len(m) AS n FROM merged")
def _(spark, d):
    merged = state.merge_captures(view(spark, d, "fx_captures"))
    return merged.select(F_ID, "payload_hash", "ts_us", "channel", F.size("members").cast("long").alias("n"))


SKEW_SLICE = 600_000_000
SLICES_SQL = f"""rolled AS (SELECT *, list_sort(list(skew_us) OVER (PARTITION BY src, dst ORDER BY ts_us, frame_id ROWS 10 PRECEDING)) AS v FROM pairs),
known AS (SELECT src, dst, ts_us // {SKEW_SLICE} + 1 AS slice, max_by(v, (ts_us, frame_id)) AS v FROM rolled GROUP BY ALL),
span AS (SELECT src, dst, slice, v, coalesce(lead(slice) OVER (PARTITION BY src, dst ORDER BY slice) - 1, (SELECT max(ts_us // {SKEW_SLICE}) FROM merged)) AS until FROM known),
edge AS (SELECT src, dst, v[len(v) // 2 + 1] AS skew_us, v[len(v)] - v[1] AS spread_us, unnest(range(slice, until + 1)) AS slice FROM span WHERE slice <= until),
base AS (SELECT sniffer_id AS b FROM fx_captures WHERE ts_us < (SELECT min(ts_us) FROM fx_captures) + 60000000 GROUP BY sniffer_id ORDER BY count(*) DESC, sniffer_id LIMIT 1),
path(slice, s, skew_us, spread_us, via) AS (
  SELECT DISTINCT slice, b, 0::BIGINT, 0::BIGINT, [b] FROM edge, base
  UNION ALL
  SELECT p.slice, e.dst, p.skew_us + e.skew_us, p.spread_us + e.spread_us, list_append(via, e.dst) FROM path AS p JOIN edge AS e ON e.slice = p.slice AND e.src = p.s WHERE NOT list_contains(via, e.dst)),
best AS (SELECT slice, s, min_by(skew_us, (len(via), via)) AS skew_us, min_by(spread_us, (len(via), via)) AS spread_us FROM path GROUP BY slice, s)"""


#: A third of the contents are no beacons; skews are learned from beacons only.
BEACON = "payload_hash % 36 <> 0"
BEACONS_SQL = MERGED_SQL.replace("FROM fx_captures", f"FROM (SELECT * FROM fx_captures WHERE {BEACON}) AS f")


@query("str_2_skew", f"WITH RECURSIVE {BEACONS_SQL}, {PAIRS_SQL}, {SLICES_SQL}, first AS (SELECT min(ts_us) + 60000000 AS warm FROM fx_captures) SELECT frame_id, CASE WHEN ts_us < warm THEN ts_us ELSE ts_us - coalesce(b.skew_us, 0) END AS ts_us, CASE WHEN ts_us < warm THEN 0 ELSE CAST(least(greatest(coalesce(b.spread_us, 100000), 50), 250000) AS INT) END AS err_us FROM first, fx_captures AS c LEFT JOIN best AS b ON b.s = c.sniffer_id AND b.slice = c.ts_us // {SKEW_SLICE}")
def _(spark, d):
    captures = view(spark, d, "fx_captures")
    base, warm = state.base_sniffer(captures)
    merged = staged(state.merge_captures(captures.filter(BEACON)), "merged")
    history = state.skew_history(merged, slice_us=SKEW_SLICE)
    adjusted = state.apply_skew(captures, graph.skew_paths(history, base), slice_us=SKEW_SLICE, warmup_end=warm)
    return adjusted.select(F_ID, "ts_us", "err_us")


@query("gra_1_paths", f"WITH RECURSIVE {MERGED_SQL}, {PAIRS_SQL}, rolled AS (SELECT *, list_sort(list(skew_us) OVER (PARTITION BY src, dst ORDER BY frame_id ROWS 10 PRECEDING)) AS v FROM pairs), edge AS (SELECT src, dst, max_by(v, frame_id) AS v FROM rolled GROUP BY ALL), path(s, skew_us, spread_us, via) AS (SELECT 0, 0::BIGINT, 0::BIGINT, [0] UNION ALL SELECT e.dst, p.skew_us + v[len(v) // 2 + 1], p.spread_us + v[len(v)] - v[1], list_append(via, e.dst) FROM path AS p JOIN edge AS e ON e.src = p.s WHERE NOT list_contains(via, e.dst)) SELECT s AS sniffer_id, CAST(min(len(via)) - 1 AS INT) AS hops, min_by(skew_us, (len(via), via)) AS skew_us, min_by(spread_us, (len(via), via)) AS spread_us FROM path GROUP BY s")
def _(spark, d):
    return graph.skew_paths(state.estimate_skew(staged(state.merge_captures(view(spark, d, "fx_captures")), "merged")), 0, ())


_DAY = 86_400_000_000
_LATEST = lambda value, by: f"last_value({value} IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY ts, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_STEP = lambda last: f"CASE WHEN {last} IS NULL THEN CASE WHEN seq < 8 THEN seq ELSE 1 END WHEN {last} <= seq THEN seq - {last} WHEN {last} - seq < 3 AND retry THEN 0 ELSE seq + 4096 - {last} END"
INFERRED_SQL = f"""slots AS (SELECT DISTINCT ta, US(ts) // {_DAY} AS slot FROM fx_numbered_frames),
lives AS (SELECT ta, slot, max(CASE WHEN before IS NULL OR slot - before > 1 THEN slot END) OVER (PARTITION BY ta ORDER BY slot) AS life FROM (SELECT *, lag(slot) OVER (PARTITION BY ta ORDER BY slot) AS before FROM slots) AS x),
f AS (SELECT n.*, slot, life, ftype = 2 AND fsubtype >= 8 AND ra NOT LIKE 'ff:%' AS qos, fsubtype >= 12 AS without FROM fx_numbered_frames AS n JOIN lives ON lives.ta = n.ta AND slot = US(ts) // {_DAY}),
p AS (SELECT *, {_LATEST("seq", "ta, life")} AS p_any, {_LATEST("CASE WHEN qos AND NOT without THEN seq END", "ta, life, ra, tid")} AS p_class, {_LATEST("CASE WHEN qos THEN seq END", "ta, life, ra, tid")} AS p_null, {_LATEST("CASE WHEN qos AND NOT without THEN tid END", "ta, life, ra")} AS p_tid FROM f),
g AS (SELECT *, {_STEP("p_any")} AS common, CASE WHEN p_class IS NULL THEN {_STEP("p_class")} ELSE least({_STEP("p_class")}, {_STEP("p_null")}) END AS own FROM p),
t AS (SELECT * EXCLUDE (own), CASE WHEN p_tid <> tid AND seq < 8 THEN least(own, seq + 1) ELSE own END AS own FROM g),
v AS (SELECT *, CASE WHEN qos AND NOT without AND own >= 8 AND common < 8 THEN 1 WHEN qos AND NOT without AND own < 8 AND common >= 8 THEN -1 END AS vote FROM t),
s AS (SELECT *, sum(vote) OVER (PARTITION BY ta, life ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS votes FROM v),
c AS (SELECT *, first_value(CASE WHEN votes <= -16 THEN 0 WHEN votes >= 256 THEN 1 END IGNORE NULLS) OVER (PARTITION BY ta, life ORDER BY ts, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS decided FROM s),
b AS (SELECT *, qos AND NOT without AND coalesce(decided = 1, coalesce(vote = 1, FALSE)) AS by_common FROM c),
l AS (SELECT *, {_LATEST("CASE WHEN NOT qos OR by_common THEN seq END", "ta, life")} AS p_base FROM b),
inferred AS (SELECT *, CASE WHEN ftype = 1 THEN 0 WHEN qos AND without THEN 1 ELSE greatest(1, CASE WHEN by_common THEN common WHEN qos THEN own ELSE {_STEP("p_base")} END) END AS n FROM l)"""


@query("str_3_inferred", f"WITH {INFERRED_SQL} SELECT frame_id, n AS inferred FROM inferred")
def _(spark, d):
    return stations.inferred_frames(view(spark, d, "fx_numbered_frames"), interval=86_400, slice_seconds=43_200).select(F_ID, "inferred")


@query("str_3_stations", f"""WITH {INFERRED_SQL}, x AS (SELECT *, ftype = 2 AND fsubtype NOT IN (4, 12) AS data, ftype = 0 AND fsubtype = 8 AS beacon, length - 30 - CASE WHEN dir = 3 THEN 6 ELSE 0 END - CASE WHEN fsubtype >= 8 THEN 2 ELSE 0 END AS packet FROM inferred)
SELECT slot * {_DAY} AS start_us, ta, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER (WHERE ftype <> 1) AS non_ctrl_packets, CAST(sum(n) AS BIGINT) AS inferred_packets,
       CAST(coalesce(sum(length) FILTER (WHERE data), 0) AS BIGINT) AS data_bytes, CAST(coalesce(sum(length) FILTER (WHERE data AND protected), 0) AS BIGINT) AS encrypt_data_bytes,
       CAST(coalesce(sum(packet) FILTER (WHERE data AND NOT protected AND ethertype IS NOT NULL AND packet > 0), 0) AS BIGINT) AS layer3_bytes, count(*) FILTER (WHERE beacon) AS beacons,
       CAST(CASE WHEN count(DISTINCT bcn_int) FILTER (WHERE beacon) = 1 THEN {_DAY} // (1024 * max(bcn_int)) ELSE 0 END AS BIGINT) AS inferred_beacons,
       CAST(coalesce(bit_or(CASE WHEN data AND dir = 1 THEN 1 WHEN data AND dir = 2 THEN 2 WHEN data AND dir = 0 THEN 4 WHEN beacon THEN CASE WHEN ibss THEN 6 ELSE 2 END END), 0) AS INT) AS flags
FROM x GROUP BY slot, ta""")
def _(spark, d):
    out = stations.station_stats(view(spark, d, "fx_numbered_frames"), 86_400, slice_seconds=43_200)
    return out.select(F.unix_micros("start").alias("start_us"), *out.columns[1:])


_MAC = lambda c: f"concat('00:00:00:00:0', CAST({c} % 10 AS VARCHAR(4)), ':', CAST(100 + {c} % 100 AS VARCHAR(4)))"
ADDRESSED = f"SELECT frame_id, ts, ftype, CAST(frame_id % 16 AS INT) AS fsubtype, sniffer_id, CAST(frame_id % 3 AS INT) AS dir, {_MAC('ta % 37')} AS ta, CASE frame_id % 13 WHEN 0 THEN 'ff:ff:ff:ff:ff:ff' WHEN 1 THEN '01:00:5e:00:00:01' ELSE {_MAC('(ta + frame_id) % 41')} END AS ra, CASE frame_id % 17 WHEN 0 THEN NULL WHEN 1 THEN 'ff:ff:ff:ff:ff:ff' ELSE {_MAC('(sniffer_id % 3)')} END AS bssid FROM fx_frames"
_ASSOC = {"timeout_us": 12 * 3_600_000_000, "refresh_us": 7_200_000_000, "ap_hold_us": 3_600_000_000, "tx_hold_us": 3_600_000_000}
ASSOC_SQL = f"""f AS ({ADDRESSED}), d AS (SELECT *, US(ts) AS us FROM f WHERE ftype = 2 AND fsubtype IN (0, 1, 2, 3, 8, 9, 10, 11) AND bssid <> 'ff:ff:ff:ff:ff:ff' AND ra NOT IN ('ff:ff:ff:ff:ff:ff', '01:00:5e:00:00:01')),
r AS (SELECT ta AS station, us, frame_id, sniffer_id, bssid, dir = 2 AS ap, dir = 0 AS ib, TRUE AS tx FROM d UNION ALL SELECT ra, us, frame_id, sniffer_id, bssid, dir = 1, dir = 0, FALSE FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY us, frame_id, tx DESC) AS k FROM r),
-- b, a, i: BSSID, role and whether it is an IBSS; e, u, x: times of the last event, update and sent frame
s AS (
  SELECT station, k, us, sniffer_id, bssid AS b, ap AS a, ib AS i, us AS e, us AS u, CASE WHEN tx THEN us END AS x, 'new' AS event FROM n WHERE k = 1
  UNION ALL
  SELECT station, k, us, sniffer_id,
         CASE WHEN event IN ('new', 'change') THEN bssid ELSE b END, CASE WHEN event IN ('new', 'change') THEN ap ELSE a END, CASE WHEN event IN ('new', 'change') THEN ib ELSE i END, CASE WHEN event IS NOT NULL AND event <> 'held' THEN us ELSE e END,
         CASE WHEN event = 'held' THEN u ELSE us END, CASE WHEN tx THEN us WHEN event = 'new' THEN NULL ELSE x END, event
  FROM (
    SELECT n.*, s.b, s.a, s.i, s.e, s.u, s.x,
           CASE WHEN n.us - s.u > {_ASSOC["timeout_us"]} THEN 'new'
                WHEN n.bssid <> s.b THEN CASE WHEN s.a AND n.us - s.u <= {_ASSOC["ap_hold_us"]} OR NOT n.tx AND s.x IS NOT NULL AND n.us - s.x < {_ASSOC["tx_hold_us"]} THEN 'held' ELSE 'change' END
                WHEN n.us - s.e >= {_ASSOC["refresh_us"]} THEN 'refresh' END AS event
    FROM s JOIN n ON n.station = s.station AND n.k = s.k + 1) AS j),
ev AS (SELECT station, us AS ts_us, b AS bssid, a AS is_ap, i AS is_ibss, sniffer_id, event, k FROM s WHERE event IN ('new', 'change', 'refresh'))"""
COUNTS_SQL = "count(*) FILTER (WHERE NOT is_ibss AND NOT is_ap) AS clients, count(*) FILTER (WHERE NOT is_ibss AND is_ap) AS aps, count(*) FILTER (WHERE is_ibss) AS ibss, count(*) AS stations, count(DISTINCT bssid) AS bss"


def _associations(spark, d) -> DataFrame:
    return state.associations(run_sql(spark, d, ADDRESSED), **_ASSOC)


def _latest(events: DataFrame, *keys: str) -> DataFrame:
    """What the last event of each station says."""
    fields = ("bssid", "is_ap", "is_ibss", "sniffer_id")
    # no two events of a station have one time, as the second would be its refresh or held back
    return events.groupBy("station", *keys).agg(F.max_by(F.struct(*fields), "ts_us").alias("v")).select("station", *keys, "v.*")


@query("str_4_associations", f"WITH RECURSIVE {ASSOC_SQL} SELECT * EXCLUDE (k) FROM ev")
def _(spark, d):
    return _associations(spark, d)


@query("agg_22_states", f"WITH RECURSIVE {ASSOC_SQL}, l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY station ORDER BY k DESC) = 1) SELECT sniffer_id, {COUNTS_SQL} FROM l GROUP BY sniffer_id")
def _(spark, d):
    return aggregates.association_counts(_latest(_associations(spark, d)), ["sniffer_id"])


@query("str_15_state_counts", f"WITH RECURSIVE {ASSOC_SQL}, l AS (SELECT *, ts_us // 86400000000 * 86400000000 AS start_us FROM ev QUALIFY row_number() OVER (PARTITION BY station, ts_us // 86400000000 ORDER BY k DESC) = 1) SELECT start_us, {COUNTS_SQL} FROM l GROUP BY start_us")
def _(spark, d):
    daily = _associations(spark, d).withColumn("start_us", F.expr("ts_us div 86400000000 * 86400000000"))
    return aggregates.association_counts(_latest(daily, "start_us"), ["start_us"])


BEACONS = """SELECT frame_id, ts, bssid, CASE WHEN frame_id % 4 = 0 THEN '' WHEN bssid % 4 = 1 AND frame_id % 3 = 0 THEN 'other' ELSE concat('net', CAST(bssid % 3 AS VARCHAR(8))) END AS ssid, CASE WHEN frame_id % 5 = 0 THEN 0 ELSE 1 + CAST(frame_id * frame_id % (1 + bssid) AS INT) END AS adv_channel,
  CASE WHEN bssid % 3 = 0 THEN 0 ELSE CAST(frame_id % 64 AS INT) END AS cipher_bits, CASE WHEN frame_id % 7 = 0 THEN 4 WHEN frame_id % 3 = 0 THEN 2 ELSE 0 END AS group_cipher, fsubtype = 8 AS is_beacon, CAST(100 + bssid % 2 * (frame_id % 11 // 10) AS INT) AS bcn_int,
  CASE WHEN frame_id % 3 = 1 THEN -1 ELSE bssid END AS ta, bssid % 5 = 3 AND frame_id % 6 > 0 AS ibss FROM fx_frames WHERE ftype = 0"""
#: A sequential model: one row of a network at a time, with all that is known of it.
NETWORK_SQL = f"""b AS ({BEACONS}), n AS (SELECT *, CASE WHEN adv_channel > 0 THEN 1 << (adv_channel - 1) ELSE 0 END AS mask, NOT is_beacon AND ta <> bssid AND NOT ibss AS suspicious, row_number() OVER (PARTITION BY bssid ORDER BY ts, frame_id) AS k FROM b),
s AS (
  SELECT bssid, ts, frame_id, k, ssid AS name, ssid = '' AS hidden, FALSE AS renamed, ibss AS role, ssid <> '' AND is_beacon AS shown, mask AS channels, bcn_int AS gap, cipher_bits AS bits, group_cipher AS grp,
         [{{'event': 'new', 'old': CAST(NULL AS VARCHAR), 'new': ssid, 'changed': TRUE, 'odd': FALSE}}] AS events
  FROM n WHERE k = 1
  UNION ALL
  SELECT n.bssid, n.ts, n.frame_id, n.k, CASE WHEN other THEN n.ssid ELSE name END, hidden, renamed OR other, CASE WHEN ok THEN n.ibss ELSE role END, shown OR ok AND n.ssid <> '' AND n.is_beacon,
         CASE WHEN told THEN channels | mask ELSE channels END, CASE WHEN told THEN bcn_int ELSE gap END, CASE WHEN told THEN bits | cipher_bits ELSE bits END, CASE WHEN told AND group_cipher > 0 THEN group_cipher ELSE grp END,
         list_filter([CASE WHEN other THEN {{'event': 'renamed', 'old': name, 'new': n.ssid, 'changed': TRUE, 'odd': NOT renamed}} END,
                      CASE WHEN ok AND n.ibss <> role THEN {{'event': 'ibss', 'old': CAST(role AS VARCHAR), 'new': CAST(n.ibss AS VARCHAR), 'changed': FALSE, 'odd': TRUE}} END,
                      CASE WHEN ok AND n.ssid <> '' AND n.is_beacon AND NOT shown THEN {{'event': 'named_in_beacon', 'old': NULL, 'new': n.ssid, 'changed': TRUE, 'odd': FALSE}} END,
                      CASE WHEN told AND mask & ~channels <> 0 THEN {{'event': 'channel', 'old': NULL, 'new': CAST(adv_channel AS VARCHAR), 'changed': TRUE, 'odd': FALSE}} END,
                      CASE WHEN told AND bcn_int <> gap THEN {{'event': 'interval', 'old': CAST(gap AS VARCHAR), 'new': CAST(bcn_int AS VARCHAR), 'changed': FALSE, 'odd': TRUE}} END,
                      CASE WHEN told AND cipher_bits & ~bits <> 0 THEN {{'event': 'ciphers', 'old': CAST(bits AS VARCHAR), 'new': CAST(bits | cipher_bits AS VARCHAR), 'changed': TRUE, 'odd': bits <> 0}} END,
                      CASE WHEN told AND group_cipher > 0 AND group_cipher <> grp THEN {{'event': 'group', 'old': CAST(nullif(grp, 0) AS VARCHAR), 'new': CAST(group_cipher AS VARCHAR), 'changed': TRUE, 'odd': grp <> 0}} END], lambda x: x IS NOT NULL)
  FROM (SELECT n.*, s.* EXCLUDE (bssid, ts, frame_id, k, events), NOT suspicious AS ok, NOT suspicious AND NOT ibss AS told, NOT suspicious AND n.ssid <> '' AND NOT hidden AND n.ssid <> name AS other FROM s JOIN n ON n.bssid = s.bssid AND n.k = s.k + 1) AS n)"""


@query("str_5_networks", f"WITH RECURSIVE {NETWORK_SQL} SELECT bssid, name AS ssid, renamed, shown AS ssid_in_beacons, channels, gap AS bcn_int, role AS ibss, bits AS ciphers, grp AS group_cipher FROM s QUALIFY row_number() OVER (PARTITION BY bssid ORDER BY k DESC) = 1")
def _(spark, d):
    return networks.network_state(run_sql(spark, d, BEACONS.replace("//", "div")), slice_seconds=86_400).drop("last_updated")


@query("str_5_events", f"WITH RECURSIVE {NETWORK_SQL} SELECT bssid, frame_id, e.event AS event, e.old AS old, e.new AS new, e.changed AS changed, e.odd AS odd FROM (SELECT bssid, frame_id, unnest(events) AS e FROM s) AS x")
def _(spark, d):
    return networks.network_events(run_sql(spark, d, BEACONS.replace("//", "div")), slice_seconds=86_400).drop("ts")


@query("str_6_channels", "WITH f AS (SELECT *, CASE WHEN frame_id % 6 > 0 THEN channel END AS c FROM fx_frames WHERE ftype = 0), c AS (SELECT bssid AS ap, ts, frame_id, c, lag(c) OVER w AS p, lag(frame_id) OVER w AS f FROM f WHERE c IS NOT NULL WINDOW w AS (PARTITION BY bssid ORDER BY ts, frame_id)), m AS (SELECT *, row_number() OVER (PARTITION BY ap, CAST(ts AS DATE) ORDER BY ts, frame_id) AS n FROM c WHERE p <> c) SELECT ap, ts, p AS prev_chan, c AS new_chan, n <= 3 AS logged, n <= 2 AS pushed, f AS prev_frame, frame_id AS new_frame FROM m")
def _(spark, d):
    f = view(spark, d, "fx_frames").filter("ftype = 0").select(F.col("bssid").alias("ap"), "ts", F_ID, F.expr("case when frame_id % 6 > 0 then channel end").alias("channel"))
    return windows.channel_changes(f, order=[F_ID], log_per_day=3, push_per_day=2, frame=F_ID)


@query("str_7_probes", "WITH RECURSIVE p AS (SELECT src_mac, bssid, ssid, US(ts) AS us FROM fx_probe_requests WHERE ssid <> ''), a AS (SELECT src_mac, bssid, ssid, min(us) AS us FROM p GROUP BY ALL UNION ALL SELECT a.src_mac, a.bssid, a.ssid, (SELECT min(p.us) FROM p WHERE p.src_mac = a.src_mac AND p.bssid = a.bssid AND p.ssid = a.ssid AND p.us > a.us + 864000000000) AS us FROM a WHERE a.us IS NOT NULL) SELECT src_mac, bssid, ssid, us FROM a WHERE us IS NOT NULL")
def _(spark, d):
    probes = view(spark, d, "fx_probe_requests").filter("ssid <> ''")
    out = state.suppress_repeats(probes, ["src_mac", "bssid", "ssid"], window_seconds=864_000)
    return out.select("src_mac", "bssid", "ssid", F.unix_micros("ts").alias("us"))


@query("str_8_flows", """WITH p AS (SELECT *, NOT up AS resp, CASE WHEN up THEN src ELSE dst END AS client, CASE WHEN up THEN sport ELSE dport END AS client_port, CASE WHEN up THEN dst ELSE src END AS server FROM fx_web_packets WHERE CASE WHEN up THEN dport ELSE sport END = 80),
g AS (SELECT *, CASE WHEN US(ts) - lag(US(ts)) OVER (PARTITION BY client, client_port, server ORDER BY ts, event_id) <= 86400000000 THEN 0 ELSE 1 END AS fresh FROM p),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY client, client_port, server ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
a AS (SELECT client, client_port, server, session, min(ts) AS first_ts, max(ts) AS last_ts, min_by(sniffer_id, (ts, event_id)) FILTER (WHERE NOT resp) AS sniffer_id,
        split_part(min_by(host, (ts, event_id)) FILTER (WHERE NOT resp AND host IS NOT NULL), ':', 1) AS host, max_by(cookie, (length(cookie), -US(ts), -event_id)) FILTER (WHERE resp AND cookie IS NOT NULL) AS cookie,
        min_by(seq, (ts, event_id)) FILTER (WHERE syn AND NOT resp) AS syn_seq, list(seq) FILTER (WHERE NOT resp AND payload_len > 0) AS segments, count(*) FILTER (WHERE NOT resp) AS reqs, count(*) FILTER (WHERE resp) AS resps FROM s GROUP BY ALL),
t AS (SELECT client, client_port, server, session, term, min((ts, event_id)) AS seen FROM s WHERE NOT resp AND term IS NOT NULL GROUP BY ALL),
j AS (SELECT client, client_port, server, session, string_agg(term, '&' ORDER BY seen) AS terms FROM t GROUP BY ALL)
SELECT client, client_port, server, 80 AS server_port, CAST(session AS BIGINT) AS session, first_ts, last_ts, sniffer_id, host, cookie, coalesce(terms, '') AS terms,
       CASE WHEN reqs > 0 THEN 1 ELSE 0 END + CASE WHEN resps > 0 THEN 2 ELSE 0 END + CASE WHEN syn_seq IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN coalesce(list_contains(segments, syn_seq + 1), FALSE) THEN 8 ELSE 0 END + CASE WHEN host IS NOT NULL THEN 16 ELSE 0 END + CASE WHEN cookie IS NOT NULL THEN 32 ELSE 0 END AS flags
FROM a LEFT JOIN j USING (client, client_port, server, session)""")
def _(spark, d):
    packets = state.client_side(view(spark, d, "fx_web_packets").drop("up"))
    return state.web_flows(packets, idle_seconds=86_400)


@query("str_9_alerts", "WITH RECURSIVE p AS (SELECT src_mac, US(ts) AS us FROM fx_alerts), a AS (SELECT src_mac, min(us) AS us FROM p GROUP BY ALL UNION ALL SELECT a.src_mac, (SELECT min(p.us) FROM p WHERE p.src_mac = a.src_mac AND p.us > a.us + 864000000000) AS us FROM a WHERE a.us IS NOT NULL) SELECT src_mac, us FROM a WHERE us IS NOT NULL")
def _(spark, d):
    return state.suppress_repeats(view(spark, d, "fx_alerts").select("src_mac", "ts"), ["src_mac"], window_seconds=864_000).select("src_mac", F.unix_micros("ts").alias("us"))


SEGMENTS = "SELECT ta AS flow, frame_id * 100 AS start, CAST(length AS BIGINT) AS length FROM fx_frames"


@query("str_14_ranges", f"WITH s AS ({SEGMENTS}), h AS (SELECT *, max(start + length) OVER (PARTITION BY flow ORDER BY start, start + length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM s), i AS (SELECT *, sum(CASE WHEN high IS NULL OR start > high THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY start, start + length ROWS UNBOUNDED PRECEDING) AS k FROM h), r AS (SELECT flow, min(start) AS lo, max(start + length) AS hi FROM i GROUP BY flow, k) SELECT flow, count(*) AS ranges, CAST(sum(hi - lo) AS BIGINT) AS covered, max(hi) - min(lo) AS span FROM r GROUP BY flow")
def _(spark, d):
    return windows.coverage_ranges(run_sql(spark, d, SEGMENTS))[1].select("flow", "ranges", "covered", "span")


@query("udf_2_ewma", "SELECT ta, CAST(ts AS DATE) AS day, list_reduce(list(CAST(length AS DOUBLE) ORDER BY ts, frame_id), lambda m, x: m + (x - m) / 16) AS ewma FROM fx_frames GROUP BY ALL")
def _(spark, d):
    values = F.transform(F.sort_array(F.collect_list(F.struct("ts", F_ID, "length"))), lambda x: x["length"])
    return view(spark, d, "fx_frames").groupBy("ta", F.to_date("ts").alias("day")).agg(values.alias("v")).select("ta", "day", windows.ewma(F.col("v")).alias("ewma"))


@query("udf_2_ewma_stream", "SELECT ta, list_reduce(list(CAST(length AS DOUBLE) ORDER BY ts, frame_id), lambda m, x: m + (x - m) / 16) AS ewma FROM fx_frames GROUP BY ta")
def _(spark, d):
    return state.keyed_ewma(view(spark, d, "fx_frames"), ["ta"], ["ts", F_ID], "length")




@query("agg_17_usage", f"WITH RECURSIVE {WALK_SQL}, u AS (SELECT (['overlay', 'merged', 'raw'])[src % 3 + 1] AS class, dst AS sec, bytes, unnest(links) AS x FROM paths JOIN traffic USING (src, dst)), e AS (SELECT class, sec, bytes, unnest([x.a, x.b]) AS host FROM u) SELECT host, class, sum(bytes) * 8 / 1024 / CASE WHEN max(sec) = min(sec) THEN 0.001::DOUBLE ELSE (max(sec) - min(sec))::DOUBLE END AS kbits FROM e GROUP BY host, class")
def _(spark, d):
    traffic = run_sql(spark, d, PAIRS).select("src", "dst", "bytes", F.element_at(F.array(F.lit("overlay"), F.lit("merged"), F.lit("raw")), (F.col("src") % 3 + 1).cast("int")).alias("class"), F.timestamp_seconds(F.col("dst")).alias("ts"))
    return aggregates.usage_by_class(traffic, _walk(spark, d, traffic))


@query("agg_20_query_status", "SELECT sniffer_id AS host, channel AS query_id, max_by(length, (ts, frame_id)) AS last_length, CAST(sum(length) AS BIGINT) AS bytes, US(max(ts)) AS last_us FROM fx_frames GROUP BY sniffer_id, channel")
def _(spark, d):
    m = view(spark, d, "fx_frames").select(F.col("sniffer_id").alias("host"), F.col("channel").alias("query_id"), "ts", F_ID, "length")
    out = m.groupBy("host", "query_id").agg(F.max_by("length", F.struct("ts", F_ID)).alias("last_length"), F.sum("length").cast("long").alias("bytes"), F.max("ts").alias("last_seen"))
    return out.select("host", "query_id", "last_length", "bytes", F.unix_micros("last_seen").alias("last_us"))


@query("fn_1_frame_hash", "SELECT min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def _(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").withColumn("raw", F.encode("text", "UTF-8"))
    # equal hashes are compared by bytes as well
    return docs.groupBy(scalars.frame_hash(F.col("raw")).alias("h"), "raw").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).filter("copies > 1").select("first_doc", "copies")


NAMES = "SELECT event_id, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(0) WHEN 3 THEN concat(chr(0), chr(0), chr(0)) WHEN 4 THEN concat('net', CAST(user_id AS VARCHAR(8)), chr(0)) WHEN 5 THEN ' ' ELSE concat('net', CAST(user_id AS VARCHAR(8))) END AS name FROM events"


@query("fn_3_hidden", f"SELECT event_id, CASE WHEN replace(name, chr(0), '') = '' THEN '' ELSE name END AS ssid FROM ({NAMES}) AS n")
def _(spark, d):
    return run_sql(spark, d, NAMES).select("event_id", scalars.visible_ssid(F.col("name")).alias("ssid"))


HEADERS = """SELECT event_id, CASE WHEN event_id % 29 = 4 THEN NULL ELSE concat('HTTP/1.1 200 OK', chr(13), chr(10),
  CASE event_id % 6 WHEN 0 THEN 'Set-Cookie: a=1; path=/' WHEN 1 THEN concat('Set-Cookie: a=1; Domain=.s', CAST(user_id AS VARCHAR(8)), '.com; path=/') WHEN 2 THEN concat('Set-Cookie: a=1; path=/; domain=s', CAST(user_id AS VARCHAR(8)), '.com')
    WHEN 3 THEN concat('Set-Cookie: DOMAIN=x; DOMAIN=s', CAST(user_id AS VARCHAR(8)), '.com, b') WHEN 4 THEN concat('Cookie: x; domain=s', CAST(user_id AS VARCHAR(8)), '.com') ELSE 'X: 1' END, chr(13), chr(10),
  CASE WHEN event_id % 4 = 1 THEN concat('Set-Cookie: c=2; Domain=www.t', CAST(event_id % 1000 AS VARCHAR(8)), '.com', chr(13), chr(10)) ELSE '' END) END AS head FROM events"""


@query("fn_9_cookies", f"SELECT event_id, list_sort(list_transform(list_filter(regexp_extract_all(head, '(?m)^Set-Cookie:[^\\r\\n]*?[;\\s](?:domain|Domain|DOMAIN)=\\.?([^\\s;,]+)', 1), lambda x: x <> ''), lambda x: {{'n': -length(x), 'd': x}}))[1].d AS domain FROM ({HEADERS}) AS h")
def _(spark, d):
    return run_sql(spark, d, HEADERS).select("event_id", scalars.cookie_domain(F.col("head")).alias("domain"))


RANGE_TEXTS = "SELECT event_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'http' WHEN 3 THEN concat(CAST(user_id AS VARCHAR(8)), '-') WHEN 4 THEN concat(' ', CAST(event_id % 60000 AS VARCHAR(8)), ' ') WHEN 5 THEN concat(CAST(user_id AS VARCHAR(8)), ' - ', CAST(user_id + 5 AS VARCHAR(8))) WHEN 6 THEN '1-2-3' ELSE concat(CAST(user_id AS VARCHAR(8)), '-', CAST(user_id + event_id % 100 AS VARCHAR(8))) END AS t FROM events"


@query("fn_10_ranges", "SELECT event_id, CASE event_id % 9 WHEN 4 THEN CAST(event_id % 60000 AS INT) WHEN 5 THEN CAST(user_id AS INT) WHEN 7 THEN CAST(user_id AS INT) WHEN 8 THEN CAST(user_id AS INT) END AS low, CASE event_id % 9 WHEN 4 THEN CAST(event_id % 60000 AS INT) WHEN 5 THEN CAST(user_id + 5 AS INT) WHEN 7 THEN CAST(user_id + event_id % 100 AS INT) WHEN 8 THEN CAST(user_id + event_id % 100 AS INT) END AS high FROM events")
def _(spark, d):
    return run_sql(spark, d, RANGE_TEXTS).select("event_id", scalars.port_range(F.col("t")).alias("r")).select("event_id", "r.low", "r.high")


@query("fn_15_epoch", "SELECT event_id, US(ts) // 1000000 AS s FROM events")
def _(spark, d):
    whole = F.timestamp_seconds(F.floor(F.unix_micros("ts") / 1_000_000).cast("long"))
    return table(spark, d, "events").select("event_id", F.unix_seconds(whole).alias("s"))


ALERT_TEXTS = "SELECT event_id, CASE WHEN event_id % 23 = 6 THEN NULL ELSE concat('Priority Count: ', CAST(user_id % 9 AS VARCHAR(8)), chr(10), CASE WHEN event_id % 3 = 0 THEN concat('IP Count: ', CAST(event_id % 50 AS VARCHAR(8)), chr(10)) WHEN event_id % 3 = 1 THEN concat('IP Count: many', chr(10)) ELSE '' END, CASE WHEN event_id % 2 = 0 THEN concat('Port/Proto Range: ', CAST(user_id AS VARCHAR(8)), ':99', chr(10)) ELSE '' END, CASE WHEN event_id % 5 = 0 THEN concat('Port/Proto Count: ', CAST(user_id AS VARCHAR(8))) ELSE 'end' END) END AS t FROM events"


@query("fn_17_alerts", "SELECT event_id, CASE WHEN event_id % 23 = 6 THEN -1 ELSE CAST(user_id % 9 AS INT) END AS priority_count, CASE WHEN event_id % 23 <> 6 AND event_id % 3 = 0 THEN CAST(event_id % 50 AS INT) ELSE -1 END AS ip_count, CASE WHEN event_id % 23 <> 6 AND event_id % 2 = 0 THEN concat(user_id, ':99') END AS port_range, CASE WHEN event_id % 23 <> 6 AND event_id % 5 = 0 THEN CAST(user_id AS INT) ELSE -1 END AS port_count FROM events")
def _(spark, d):
    got = scalars.alert_fields(F.col("t"))
    return run_sql(spark, d, ALERT_TEXTS).select("event_id", *(got[k].alias(k) for k in ("priority_count", "ip_count", "port_range", "port_count")))


@query("fn_18_bytes", "SELECT mac, CASE WHEN n >= 1099511627776 THEN concat(format('{:,.2f}', n / 1099511627776), ' TiB') WHEN n >= 1073741824 THEN concat(format('{:,.2f}', n / 1073741824), ' GiB') WHEN n >= 1048576 THEN concat(format('{:,.2f}', n / 1048576), ' MiB') WHEN n >= 1024 THEN concat(format('{:,.2f}', n / 1024), ' KiB') ELSE concat(n, ' B') END AS bytes FROM (SELECT mac, CAST(sum(bytes) AS BIGINT) AS n FROM fx_station_stats GROUP BY mac) AS b")
def _(spark, d):
    return view(spark, d, "fx_station_stats").groupBy("mac").agg(scalars.human_bytes(F.sum("bytes")).alias("bytes"))


@query("fn_20_links", "SELECT least(ta, bssid) AS a, greatest(ta, bssid) AS b, count(*) AS frames FROM fx_frames GROUP BY 1, 2")
def _(spark, d):
    return view(spark, d, "fx_frames").groupBy(scalars.link(F.col("ta"), F.col("bssid")).alias("l")).agg(F.count("*").alias("frames")).select("l.a", "l.b", "frames")


