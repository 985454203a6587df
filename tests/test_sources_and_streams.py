"""Capture files, sinks and streams."""

import struct

from pyspark.sql import functions as F

from aerolens.operators.state import association_step, last_accepted, run_keyed
from aerolens.sources import frames
from aerolens.streaming import queries as streams


def beacon(ssid: bytes, channel: int) -> bytes:
    mac = bytes([2, 0, 0, 0, 0, 9])
    head = bytes([0x80, 0, 0, 0]) + b"\xff" * 6 + mac + mac + struct.pack("<H", 5 << 4)
    return head + b"\0" * 8 + struct.pack("<HH", 100, 1) + bytes([0, len(ssid)]) + ssid + bytes([3, 1, channel])


def capture(records) -> bytes:
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 105)
    for us, raw in records:
        out += struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(raw), len(raw)) + raw
    return out


def test_read_and_decode(spark, tmp_path):
    (tmp_path / "node3.pcap").write_bytes(capture([(1_500_000, beacon(b"net", 6)), (2_000_000, b"\xd4\x00\x00\x00" + b"\x01" * 6)]) + b"cut")
    (tmp_path / "node4.pcap").write_bytes(b"")
    df = frames.set_sniffer(frames.decode_frames(frames.read_captures(spark, str(tmp_path))))
    got = {r["frame_id"]: r for r in df.collect()}
    assert (got[0]["ftype"], got[0]["fsubtype"], got[0]["ssid"], got[0]["adv_channel"], got[0]["bcn_int"], got[0]["seq"]) == (0, 8, "net", 6, 100, 5)
    assert got[0]["bssid"] == "02:00:00:00:00:09" and got[0]["ts_us"] == 1_500_000 and got[0]["sniffer_id"] == 3
    assert got[1]["ftype"] == 1 and got[1]["ta"] is None and got[1]["ra"] == "01:01:01:01:01:01"
    assert frames.read_captures(spark, str(tmp_path), limit=1).count() == 1


def test_ciphers_elements_and_ethertype(spark, tmp_path):
    from aerolens.operators import filters

    mac = bytes([2, 0, 0, 0, 0, 9])
    head = bytes([0x80, 0, 0, 0]) + b"\xff" * 6 + mac + mac + b"\0\0" + b"\0" * 8
    element = lambda tag, body: bytes([tag, len(body)]) + body
    plain = element(0, b"net") + element(1, b"\x82")
    suite = lambda oui, group, pair, key: b"\x01\0" + oui + bytes([group]) + b"\x01\0" + oui + bytes([pair]) + b"\x01\0" + oui + bytes([key])
    rsn, wpa = suite(frames.RSN, 2, 4, 2), frames.WPA + b"\x01" + suite(frames.WPA, 1, 0, 1)
    bodies = [
        (struct.pack("<HH", 100, 1), plain),  # open
        (struct.pack("<HH", 100, 17), plain),  # WEP
        (struct.pack("<HH", 100, 17), plain + element(48, rsn)),
        (struct.pack("<HH", 100, 17), plain + element(221, wpa)),
        (struct.pack("<HH", 100, 17), plain + element(48, b"\x02\0")),  # malformed
        (struct.pack("<HH", 100, 1), element(0, b"net")),
        (struct.pack("<HH", 100, 1), plain[:-1]),
    ]
    llc = b"\xaa\xaa\x03\0\0\0\x08\0"
    data = [bytes([0x08, 2, 0, 0]) + mac * 3 + b"\0\0" + llc, bytes([0x88, 2, 0, 0]) + mac * 3 + b"\0\0\0\0" + llc, bytes([0x08, 0x42, 0, 0]) + mac * 3 + b"\0\0" + llc]
    (tmp_path / "node1.pcap").write_bytes(capture([(i, head + fixed + rest) for i, (fixed, rest) in enumerate(bodies)] + [(10 + i, raw) for i, raw in enumerate(data)]))
    (tmp_path / "node2.pcap").write_bytes(b"something else altogether")
    df = frames.decode_frames(frames.read_captures(spark, str(tmp_path)))
    got = {r["ts_us"]: r for r in df.collect()}
    # the group cipher is a field of its own
    assert [(got[i]["group_cipher"], got[i]["cipher_bits"]) for i in range(7)] == [(0, 0), (1, 1 | 8), (2, 4 | 8), (1, 1 | 16), (1, 1 | 8), (0, 0), (0, 0)]
    assert [got[i]["tid"] for i in (10, 11, 12)] == [None, 0, None] and got[0]["ibss"] is False and got[0]["version"] == 0
    assert [got[i]["ethertype"] for i in (10, 11, 12)] == [0x800, 0x800, None]
    _, bad = filters.validate_frames(df, filters.FRAME_RULES | filters.ELEMENT_RULES)
    assert {r["ts_us"]: r["violations"] for r in bad.collect()} == {4: ["bad_ciphers"], 5: ["no_rates"]}


def test_daily_and_hourly_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 1), (90_000, 2)], "s int, level_rank int").withColumn("ts", F.timestamp_seconds("s")).withColumns({"source": F.lit("pcap"), "level": F.lit("INFO"), "data": F.lit("x")})
    frames.write_daily(df.select("s", "ts"), f"{tmp_path}/daily")
    assert [r["s"] for r in frames.prune_daily(spark, f"{tmp_path}/daily", "1970-01-02").collect()] == [90_000]
    frames.write_hourly_logs(df, f"{tmp_path}/logs")
    assert [(str(r["date"]), r["hour"]) for r in spark.read.text(f"{tmp_path}/logs").collect()] == [("1970-01-02", 1)]


def test_routes_have_folders(spark, tmp_path):
    from aerolens.operators import filters

    routed = filters.route(spark.range(10), [("low", F.col("id") < 3)], "other")
    frames.write_routed(routed, f"{tmp_path}/routed")
    assert spark.read.parquet(f"{tmp_path}/routed/route=low").count() == 3 and spark.read.parquet(f"{tmp_path}/routed").filter("route = 'other'").count() == 7


def test_database_tables_grow(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for _ in range(2):
        frames.write_jdbc(df, url, "stations", driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = spark.read.jdbc(url, "stations", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    assert sorted(map(str, back.collect())) == sorted(2 * list(map(str, df.collect())))


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, t int")
    assert sorted((r["k"], r["v"]) for r in frames.upsert(old, new, "k", "t").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def frame_rows(spark):
    data = [(i, i * 7, i % 3, "merged" if i % 2 else "raw", i % 5 == 0, 100 + i) for i in range(200)]
    return spark.createDataFrame(data, "frame_id int, s int, ta int, tap string, is_dupe boolean, length int").withColumn("ts", F.timestamp_seconds("s"))


def test_stream_equals_batch(spark, tmp_path):
    frame_rows(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    wanted = [
        streams.StreamQuery("raw_short", lambda df: df.select("frame_id", "ta"), ["raw"], F.col("length") < 200),
        streams.StreamQuery("merged_all", lambda df: df.select("frame_id"), ["merged"], F.col("length") >= 150),
    ]
    for q in streams.start(stream, wanted, f"{tmp_path}/out", f"{tmp_path}/ck"):
        q.awaitTermination(120)
    for name, plan in streams.plans(frame_rows(spark), wanted).items():
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/{name}").collect()))
        assert got == sorted(map(tuple, plan.collect())) and got


def test_interval_stream(spark, tmp_path):
    frame_rows(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = streams.interval_stream(stream, ["ta"]).writeStream.format("memory").queryName("intervals").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["ta"]): r["packets"] for r in spark.table("intervals").collect()}
    batch = {(r["start"], r["ta"]): r["packets"] for r in streams.interval_stream(frame_rows(spark), ["ta"]).collect()}
    # windows that the watermark has passed are out, with the batch's counts
    assert got and all(batch[k] == n for k, n in got.items())


def test_steps_can_stop_and_go_on():
    rows = [{"t": t} for t in (0, 5, 9, 12, 30)]
    step = last_accepted("t", 6, ["t"])
    whole = step(None, rows)
    for cut in range(6):
        state, a = step(None, rows[:cut])
        end, b = step(state, rows[cut:])
        assert (end, a + b) == whole
    at = [{"station": "s", "ts_us": t * 10**7, "bssid": "xy"[t % 2], "is_ap": t == 3} for t in range(12)]
    whole = association_step()(None, at)
    state, a = association_step()(None, at[:5])
    assert association_step()(state, at[5:])[0] == whole[0] and a + association_step()(state, at[5:])[1] == whole[1]


def test_run_keyed_orders_rows(spark):
    df = spark.createDataFrame([("a", 9), ("a", 0), ("a", 5), ("b", 1)], "k string, t long")
    out = run_keyed(df, ["k"], ["t"], last_accepted("t", 6, ["k", "t"]), "k string, t long")
    assert sorted(map(tuple, out.collect())) == [("a", 0), ("a", 9), ("b", 1)]


def test_keyed_stream_starts_warm_and_is_flushed(spark, tmp_path):
    """The stream goes on from an earlier state, matches the batch form, and its states can be read while it is at rest."""
    from aerolens.operators.state import merge_rest, merge_step
    from aerolens.streaming.stateful import flush, run_keyed_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        spark.createDataFrame([("a", 3), ("a", 9), ("a", 12), ("b", 1)], "k string, t long").coalesce(1).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, t long").parquet(f"{tmp_path}/in")
        known = spark.createDataFrame([("a", 0)], "k string, last long")
        out = run_keyed_stream(stream, ["k"], ["t"], last_accepted("t", 6, ["k", "t"]), "k string, t long", initial=known, warm=lambda row: int(row["last"]))
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [("a", 9), ("b", 1)]
        assert sorted(r["t"] for r in flush(spark, f"{tmp_path}/ck", lambda last: [{"t": last}], "t long").collect()) == [1, 9]

        capture_rows = [(1, 7, 0, 0, 0, 1, 6, -50, -95, False), (2, 7, 2_000_000, 2_000_000, 0, 1, 6, -50, -95, False)]
        schema = "frame_id long, payload_hash long, ts_us long, local_us long, err_us int, sniffer_id int, channel int, rssi int, noise int, is_ctrl boolean"
        spark.createDataFrame(capture_rows, schema).coalesce(1).write.parquet(f"{tmp_path}/captures")
        ids = lambda rows: [{"frame_id": r["frame_id"]} for r in rows]
        step = merge_step()
        merged = run_keyed_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/captures"), ["payload_hash"], ["ts_us"], lambda s, r: (lambda left, done: (left, ids(done)))(*step(s, r)), "frame_id long")
        merged.writeStream.format("parquet").option("path", f"{tmp_path}/merged").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start().awaitTermination(120)
        assert [r["frame_id"] for r in spark.read.parquet(f"{tmp_path}/merged").collect()] == [1]
        assert [r["frame_id"] for r in flush(spark, f"{tmp_path}/ck2", lambda left: ids(merge_rest(left)), "frame_id long").collect()] == [2]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_unique_and_session_streams(spark, tmp_path):
    data = [("a", 0), ("a", 5), ("b", 10), ("a", 4000), ("b", 20), ("b", 9000)]
    spark.createDataFrame(data, "k string, s int").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, s int, ts timestamp").parquet(f"{tmp_path}/in")
    run = lambda df, name: df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    run(streams.unique_stream(stream, ["k"]), "firsts")
    assert sorted(r["k"] for r in spark.table("firsts").collect()) == ["a", "b"]
    run(streams.session_stream(stream, ["k"]), "sessions")
    # the sessions that the watermark has passed: all but the last
    assert sorted((r["k"], r["requests"]) for r in spark.table("sessions").collect()) == [("a", 1), ("a", 2), ("b", 2)]


def test_upsert_stream_keeps_the_latest(spark, tmp_path):
    schema = "k int, v string, t int"
    for n, part in enumerate(([(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/table", "k", "t", f"{tmp_path}/ck").awaitTermination(120)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/table/v=1").collect()) == [(1, "a"), (2, "c"), (3, "d")]


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _files(spark, folder, batches, schema):
    """One file a micro-batch, in order."""
    import os
    import time

    for n, rows in enumerate(batches):
        time.sleep(0.01)
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.startswith("part-") and not os.path.exists(f"{folder}/.{name}.seen"):
                at = time.time() - 1000 + 10 * n
                os.utime(f"{folder}/{name}", (at, at))
                open(f"{folder}/.{name}.seen", "w").close()
    return spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def test_associations_end_by_event_time(spark, tmp_path):
    """A station without rows for 300 s of event time ends and is put out, one heard in time goes on."""
    from aerolens.streaming.stateful import run_keyed_stream

    spark.conf.set(*ROCKS)
    try:
        schema = "station string, s int, bssid string, is_ap boolean"
        stream = _files(spark, f"{tmp_path}/in", [[("a", 9000, "x", False), ("b", 9005, "x", False)], [("a", 9200, "x", False)], [("c", 9400, "y", False)], [("a", 9450, "y", False)], [("c", 10_000, "y", False)]], schema)
        step = association_step()
        rows = lambda r: r | {"ts_us": int(r["s"]) * 1_000_000}
        keep = ("station", "bssid", "event")
        run = lambda state, batch: (lambda s, out: (None if s is None else (*s, batch[0]["station"]), [{k: r[k] for k in keep} for r in out]))(*step(state and state[:6], [rows(r) for r in batch]))
        ended = lambda state: [{"station": state[6], "bssid": state[0], "event": "ended"}]
        out = run_keyed_stream(stream, ["station"], ["s"], run, "station string, bssid string, event string", expire_seconds=300, finish=ended)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(180)
        got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        # b ends when c is heard at 9400; a changes at 9450 and ends when c is heard at 10,000; c begins anew then
        assert got == sorted([("a", "x", "new"), ("a", "x", "refresh"), ("b", "x", "new"), ("b", "x", "ended"), ("c", "y", "new"), ("a", "y", "change"), ("a", "y", "ended"), ("c", "y", "new")])
    finally:
        spark.conf.unset(ROCKS[0])


def test_late_rows_are_counted(spark, tmp_path):
    """Rows that come after later ones of their key are counted; they pass, or are dropped if asked."""
    from aerolens.streaming.stateful import late_counts, run_keyed_stream

    spark.conf.set(*ROCKS)
    try:
        schema = "k string, s int"
        batches = [[("a", 10), ("a", 30), ("b", 5)], [("a", 24), ("a", 26), ("b", 4)], [("a", 9), ("a", 40)]]
        for drop in (False, True):
            where = f"{tmp_path}/{drop}"
            stream = _files(spark, f"{where}/in", batches, schema)
            step = lambda state, rows: (state, [{"k": r["k"], "s": int(r["s"])} for r in rows])
            out = run_keyed_stream(stream, ["k"], ["s"], step, "k string, s int", late_seconds=5, drop_late=drop)
            out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/ck").trigger(availableNow=True).start().awaitTermination(180)
            got = sorted(tuple(r) for r in spark.read.parquet(f"{where}/out").collect())
            assert got == sorted(r for batch in batches for r in batch if not drop or r not in (("a", 24), ("a", 9)))
            assert [(r["key"]["k"], r["late"]) for r in late_counts(spark, f"{where}/ck").collect()] == [("a", 2)]
    finally:
        spark.conf.unset(ROCKS[0])


def test_one_read_serves_all_queries(spark, tmp_path):
    """Each query gets its rows from one read of the stream; a batch that is tried again replaces its files."""
    frame_rows(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    wanted = [
        streams.StreamQuery("raw_short", lambda df: df.select("frame_id", "ta"), ["raw"], F.col("length") < 200),
        streams.StreamQuery("merged_all", lambda df: df.select("frame_id"), ["merged"], F.col("length") >= 150),
        streams.StreamQuery("both", lambda df: df.select("frame_id", "length"), ["raw", "merged"], dupes=True),
    ]
    start = lambda: streams.fan_out(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), wanted, f"{tmp_path}/out", f"{tmp_path}/ck")
    q = start()
    q.awaitTermination(120)
    assert sum(p["numInputRows"] for p in q.recentProgress) == 200
    results = lambda: {n: sorted(tuple(r)[: len(plan.columns)] for r in spark.read.parquet(f"{tmp_path}/out/{n}").select(plan.columns).collect()) for n, plan in streams.plans(frame_rows(spark), wanted).items()}
    want = {n: sorted(map(tuple, plan.collect())) for n, plan in streams.plans(frame_rows(spark), wanted).items()}
    assert results() == want
    # the last batch is not known to have ended: it runs again and leaves the same rows
    (tmp_path / "ck" / "commits" / "0").unlink()
    (tmp_path / "ck" / "commits" / ".0.crc").unlink(missing_ok=True)
    start().awaitTermination(120)
    assert results() == want


def test_old_days_expire(spark, tmp_path):
    from datetime import date

    import pytest

    rows = [(i, f"2024-03-{d:02d} 12:00:00") for i, d in enumerate((1, 2, 2, 9, 10, 11))]
    frames.write_daily(spark.createDataFrame(rows, "id int, t string").selectExpr("id", "cast(t as timestamp) ts"), f"{tmp_path}/days")
    (tmp_path / "days" / "notes").mkdir()
    today = date(2024, 3, 10)
    assert frames.expire_daily(f"{tmp_path}/days", 8, today) == ["2024-03-01", "2024-03-02"]
    assert spark.read.parquet(f"{tmp_path}/days").count() == 6  # that was a dry run
    assert frames.expire_daily(f"{tmp_path}/days", 8, today, dry_run=False) == ["2024-03-01", "2024-03-02"]
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/days").collect()) == [3, 4, 5]
    # the current day and later ones stay whatever is asked
    assert frames.expire_daily(f"{tmp_path}/days", 1, today, dry_run=False) == ["2024-03-09"]
    assert (tmp_path / "days" / "date=2024-03-10").exists() and (tmp_path / "days" / "notes").exists()
    with pytest.raises(ValueError, match="today"):
        frames.expire_daily(f"{tmp_path}/days", 0, today)
