"""Operators on hand-made rows, K operators against slow models."""

import math
import random
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.functions import metrics, scalars
from aerolens.operators import aggregates, filters, graph, joins, networks, projections, state, stations, windows
from aerolens.operators.scan import Scan, scan
from aerolens.plans import analyst, frames, logs  # noqa: F401  logs adds its queries to those of frames
from aerolens.plans.fixtures import view
from aerolens.registry import queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_exclude_value_lets_missing_pass(spark):
    df = spark.createDataFrame([(1, "A"), (2, None), (3, "b")], "id int, ssid string")
    assert rows(filters.exclude_value(df, "ssid", "a", ignore_case=True).select("id")) == [(2,), (3,)]
    assert rows(filters.exclude_value(df, "ssid", "a").select("id")) == [(1,), (2,), (3,)]


def test_route_first_rule_wins_and_none_drops(spark):
    df = spark.range(4)
    rules = [("even", F.col("id") % 2 == 0), ("small", F.col("id") < 2)]
    assert rows(filters.route(df, rules)) == [(0, "even"), (1, "small"), (2, "even")]
    assert rows(filters.route(df, rules, "rest"))[-1] == (3, "rest")


def test_shared_filter_without_filter_keeps_all(spark):
    df = spark.range(3)
    assert filters.shared_filter(df, [F.col("id") == 1, None]).count() == 3
    assert filters.shared_filter(df, [F.col("id") == 1, F.col("id") == 2]).count() == 2


def test_split_first(spark):
    first, rest = filters.split_first(spark.range(5), 2, ["id"])
    assert rows(first) == [(0,), (1,)] and rows(rest) == [(2,), (3,), (4,)]


def test_asof_strict_and_tolerance(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 10, 1), ("a", 15, 2), ("b", 6, 3)], "k string, u int, v int")
    run = lambda **o: rows(joins.asof_join(left, right, ["k"], "t", "u", ["v"], **o))
    assert run() == [("a", 10, 1), ("a", 20, 2), ("b", 5, None)]
    assert run(strict=True) == [("a", 10, None), ("a", 20, 2), ("b", 5, None)]
    assert run(tolerance=F.lit(5))[1] == ("a", 20, None)


def test_asof_in_slices_is_the_same(spark):
    rng = random.Random(9)
    left = spark.createDataFrame([(rng.choice("ab"), rng.randrange(1000)) for _ in range(200)], "k string, t int")
    right = spark.createDataFrame([(rng.choice("ab"), rng.randrange(1000), i) for i in range(60)], "k string, u int, v int")
    for options in ({}, {"strict": True}, {"tolerance": F.lit(40)}):
        plain, sliced = (rows(joins.asof_join(left, right, ["k"], "t", "u", ["v"], slice_length=n, **options)) for n in (None, 37))
        assert plain == sliced and any(r[2] is not None for r in plain)
    times = left.withColumn("t", F.timestamp_seconds("t")), right.withColumn("u", F.timestamp_seconds("u"))
    assert [r[2] for r in rows(joins.asof_join(*times, ["k"], "t", "u", ["v"], slice_length=37))] == [r[2] for r in rows(joins.asof_join(left, right, ["k"], "t", "u", ["v"]))]


def test_ranges_without_a_join(spark):
    df = spark.createDataFrame([(1, 80, 5), (2, 5, 5), (3, None, 90), (4, None, None)], "id int, a int, b int")
    assert rows(joins.range_join(df, [(80, 80), (1, 100), (5, 5)], ["a", "b"]).select("id", "low", "high")) == [(1, 1, 100), (1, 5, 5), (1, 80, 80), (2, 1, 100), (2, 5, 5), (3, 1, 100)]


def test_slices_of_time_change_nothing(spark):
    rng = random.Random(12)
    data = [(rng.choice(["a", "b", None]), t, i, rng.randrange(5)) for i, t in enumerate(rng.sample(range(3000), 300))]
    df = spark.createDataFrame(data, "k string, s int, id int, channel int").withColumn("ts", F.timestamp_seconds("s"))
    for cut in (7, 100, 2000):
        for f in (lambda c: windows.report_duration(df, ["k"], order=["id"], slice_seconds=c), lambda c: windows.channel_dwell(df, "k", order=["id"], slice_seconds=c), lambda c: windows.moving_averages(df.filter("k is not null"), ["k"], ["ts", "id"], "channel", (1, 4, 25), slice_seconds=c)):
            assert sorted(map(str, f(cut).collect())) == sorted(map(str, f(None).collect()))


def test_lower_median_and_cdf(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "x int")
    assert df.agg(aggregates.lower_median("x")).first()[0] == 2
    data = [5, 1, 9, 9, 2, 7, 3]
    got = rows(aggregates.cdf_points(spark.createDataFrame([(x,) for x in data], "x int"), "x", 4))
    ordered = sorted(data)
    assert got == [(i, ordered[(i + 1) * 6 // 4]) for i in range(4)]
    falling = rows(aggregates.cdf_points(spark.createDataFrame([(x,) for x in data], "x int"), "x", 4, ascending=False))
    assert falling == [(i, ordered[::-1][(i + 1) * 6 // 4]) for i in range(4)]


def test_bytes_as_integer(spark):
    df = spark.createDataFrame([(bytearray([1, 2, 3]),), (bytearray([1]),)], "raw binary")
    big, little = aggregates.bytes_as_integer(F.col("raw"), 1, 2), aggregates.bytes_as_integer(F.col("raw"), 1, 2, True)
    assert [tuple(r) for r in df.select(big, little).collect()] == [(0x0203, 0x0302), (None, None)]


def test_owner_keeps_without_clear_gain(spark):
    counts = spark.createDataFrame([(1, 1, 100_000.0, 9.0), (1, 2, 120_000.0, 9.0), (2, 1, 100_000.0, 9.0), (2, 2, 200_000.0, 9.0), (3, 5, 1.0, 9.0), (5, 1, 1000.0, 9.0), (5, 2, 90_000.0, 9.0), (6, 1, 5.0, 2.0), (7, 1, 5.0, 2.0), (7, 2, 90_000.0, 3.0), (8, 1, 3.0, 9.0), (8, 2, 3.0, 1.0)], "bssid int, sniffer_id int, rate double, seconds double")
    previous = spark.createDataFrame([(1, 1), (2, 1), (4, 9), (5, 1), (7, 1)], "bssid int, owner int")
    # a sticky owner stays whatever the gain
    assert rows(aggregates.owner_with_hysteresis(counts, previous)) == [(1, 1), (2, 1), (3, 5), (4, 9), (5, 1), (6, 1), (7, 1), (8, 2)]
    assert rows(aggregates.owner_with_hysteresis(counts, previous, sticky=False)) == [(1, 1), (2, 2), (3, 5), (4, 9), (5, 2), (6, 1), (7, 2), (8, 2)]
    # too short a watch decides nothing; the longest of any observer counts
    short = aggregates.owner_with_hysteresis(counts, previous, duration="seconds", least_duration=5, sticky=False)
    assert rows(short) == [(1, 1), (2, 2), (3, 5), (4, 9), (5, 2), (7, 1), (8, 2)]


@pytest.mark.parametrize(("seqs", "retries", "gaps"), [([4095, 0, 1], [0, 0, 0], [1, 1, 1]), ([5, 4, 4], [0, 1, 1], [5, 0, 0]), ([7, 4], [0, 1], [7, 4093]), ([8, 10], [0, 0], [1, 2])])
def test_sequence_gaps(spark, seqs, retries, gaps):
    df = spark.createDataFrame([("a", i, i, s, bool(r)) for i, (s, r) in enumerate(zip(seqs, retries, strict=True))], "ta string, ts int, frame_id int, seq int, retry boolean")
    assert [r["gap"] for r in windows.sequence_gaps(df).orderBy("ts").collect()] == gaps


def test_ping_loss_restart_and_duplicates(spark):
    seqs = [2, 3, 5, 5, 4, 0, 1, 3]
    df = spark.createDataFrame([("h", i, i, s) for i, s in enumerate(seqs)], "source string, ts int, event_id int, seq int")
    assert rows(windows.ping_loss(df)) == [("h", 6, 2 + 1 + 1, 2)]


def test_sessions_at_the_boundary(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 1200, 2401)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["session"] for r in windows.gap_sessions(df, ["k"]).orderBy("s").collect()] == [1, 1, 2]
    assert [r["session"] for r in windows.gap_sessions(df, ["k"], inclusive=False).orderBy("s").collect()] == [1, 2, 3]


def test_channel_shares_sum_and_floor(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 6, 30.0), (1, 11, 70.0), (2, 1, 0.0), (2, 6, 0.0)], "sniffer_id int, channel int, rate double")
    got = {(r[0], r[1]): r[2] for r in windows.channel_shares(df, minimum=0.1).collect()}
    assert got[(1, 1)] == pytest.approx(0.1) and got[(1, 6)] == pytest.approx(0.27) and got[(1, 11)] == pytest.approx(0.63)
    assert got[(2, 1)] == got[(2, 6)] == 0.5


def test_coverage_ranges_merge_touching(spark):
    df = spark.createDataFrame([("f", 0, 10), ("f", 10, 5), ("f", 20, 5), ("f", 2, 3), ("f", 40, 0)], "flow string, start int, length int")
    ranges, summary = windows.coverage_ranges(df)
    assert rows(ranges) == [("f", 0, 15), ("f", 20, 25)]
    assert rows(summary) == [("f", 2, 20, 25, 0.8)]


def test_suppress_repeats_against_a_model(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.randrange(200)) for _ in range(120)]
    df = spark.createDataFrame(data, "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    want = []
    for key in "ab":
        last = None
        for s in sorted(s for k, s in data if k == key):
            if last is None or s - last > 6:
                last = s
                want.append((key, s))
    assert rows(state.suppress_repeats(df, ["k"], window_seconds=6).select("k", "s")) == sorted(want)
    chain = spark.createDataFrame([("x", 0), ("x", 5), ("x", 9)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(state.suppress_repeats(chain, ["k"], window_seconds=6).select("s")) == [(0,), (9,)]


CAPTURE = "frame_id long, payload_hash long, ts_us long, sniffer_id int, channel int, rssi int, noise int, is_ctrl boolean"


def merged(spark, data):
    return sorted((r["ts_us"], r["channel"], len(r["members"])) for r in state.merge_captures(spark.createDataFrame(data, CAPTURE)).collect())


def test_merge_two_sniffers(spark):
    assert merged(spark, [(1, 7, 0, 1, 6, -50, -95, False), (2, 7, 40, 2, 6, -60, -95, False)]) == [(40, 6, 2)]


def test_merge_splits_the_same_sniffer(spark):
    data = [(1, 7, 0, 1, 6, -50, -95, False), (2, 7, 100, 2, 6, -50, -95, False), (3, 7, 300_000, 1, 6, -50, -95, False), (4, 7, 300_100, 2, 6, -50, -95, False)]
    assert merged(spark, data) == [(100, 6, 2), (300_100, 6, 2)]


def test_merge_control_frames_apart(spark):
    assert len(merged(spark, [(1, 7, 0, 1, 6, -50, -95, True), (2, 7, 200_000, 2, 6, -50, -95, True)])) == 2


def test_merge_near_equal_strength_on_other_channel(spark):
    assert merged(spark, [(1, 7, 0, 1, 6, -50, -95, False), (2, 7, 40, 2, 11, -52, -95, False)]) == [(40, 0, 2)]


def test_merge_keeps_every_capture(spark):
    rng = random.Random(2)
    data = [(i, rng.randrange(4), rng.randrange(3_000_000), rng.randrange(4), 6, -50, -95, False) for i in range(150)]
    out = state.merge_captures(spark.createDataFrame(data, CAPTURE)).collect()
    assert sum(len(r["members"]) for r in out) == 150
    assert all(len({m["sniffer_id"] for m in r["members"]}) == len(r["members"]) for r in out)


def test_merge_closes_at_the_base_sniffer_only(spark):
    """Sniffer 2 comes twice, but only a second capture of the base's own sniffer narrows the window."""
    data = [(1, 7, 0, 1, 6, -50, -95, False), (2, 7, 10, 2, 6, -50, -95, False), (3, 7, 30, 2, 6, -50, -95, False), (4, 7, 200_000, 3, 6, -50, -95, False)]
    out = state.merge_captures(spark.createDataFrame(data, CAPTURE)).collect()
    assert sorted([m["sniffer_id"] for m in r["members"]] for r in out) == [[1, 2, 3], [2]]


def test_merge_strength_is_above_the_noise(spark):
    # 5 below the best is no conflict; the second is stronger above its noise
    assert merged(spark, [(1, 7, 0, 1, 6, -50, -95, False), (2, 7, 40, 2, 11, -55, -95, False)]) == [(40, 6, 2)]
    assert merged(spark, [(1, 7, 0, 1, 6, -50, -80, False), (2, 7, 40, 2, 11, -55, -95, False)]) == [(40, 11, 2)]


def test_merge_streams_a_hot_content(spark):
    """One content every 100 ms is one island; the state holds half a second of it."""
    rows_ = [{"frame_id": i, "payload_hash": 7, "ts_us": i * 100_000, "local_us": i * 100_000, "err_us": 0, "sniffer_id": i % 3, "channel": 6, "rssi": -50, "noise": -95, "is_ctrl": False} for i in range(3000)]
    step, left, out, most = state.merge_step(), None, [], 0
    for r in rows_:
        left, more = step(left, [r])
        out += more
        most = max(most, len(left))
    out += state.merge_rest(left)
    assert most <= 6 and sum(len(o["members"]) for o in out) == 3000 and out == state.merge_rest(rows_)


def test_late_captures_are_duplicates(spark):
    late = f"{CAPTURE}, arrival_us long"
    data = [(1, 7, 0, 1, 6, -50, -95, False, 0), (2, 7, 40, 2, 6, -60, -95, False, 100), (3, 7, 60, 3, 6, -60, -95, False, 10_000_001), (4, 7, 50, 4, 6, -60, -95, False, 130_000_001), (5, 8, 0, 1, 6, -50, -95, False, 0)]
    out = state.merge_captures(spark.createDataFrame(data, late)).collect()
    assert sorted((r["frame_id"], r["is_dupe"], len(r["members"])) for r in out) == [(1, False, 2), (3, True, 1), (4, False, 1), (5, False, 1)]


def test_receivers_change_only_in_silence(spark):
    at = lambda s, b, tx: {"station": "s", "ts_us": s * 1_000_000, "bssid": b, "is_ap": False, "as_tx": tx}
    seen = [at(0, "x", True), at(30, "y", False), at(50, "x", True), at(90, "y", False), at(110, "y", False)]
    assert [(e["ts_us"] // 1_000_000, e["bssid"]) for e in state.association_step()(None, seen)[1]] == [(0, "x"), (110, "y")]
    assert [(e["ts_us"] // 1_000_000, e["bssid"]) for e in state.association_step(rx_guard="code")(None, seen)[1]] == [(0, "x"), (30, "y"), (50, "x"), (90, "y")]
    frames_ = [(1, 2, 0, "00:00:00:00:00:02"), (2, 2, 4, "00:00:00:00:00:02"), (3, 2, 0, "01:00:5e:00:00:01"), (4, 0, 0, "00:00:00:00:00:02"), (5, 2, 8, None)]
    df = spark.createDataFrame([(i, t, s, "00:00:00:00:00:01", r, "00:00:00:00:00:09", 1) for i, t, s, r in frames_], "frame_id int, ftype int, fsubtype int, ta string, ra string, bssid string, dir int").withColumn("ts", F.timestamp_seconds("frame_id"))
    assert rows(state.association_rows(df).select("frame_id", "station", "is_ap", "as_tx")) == [(1, "00:00:00:00:00:01", False, True), (1, "00:00:00:00:00:02", True, False)]


def test_associations(spark):
    step = state.association_step()
    at = lambda s, b, ap=False: {"station": "s", "ts_us": s * 1_000_000, "bssid": b, "is_ap": ap}
    events = [e["event"] for e in step(None, [at(0, "x"), at(59, "x"), at(60, "x"), at(61, "y"), at(500, "y")])[1]]
    assert events == ["new", "refresh", "change", "new"]
    held = [e["bssid"] for e in step(None, [at(0, "x", True), at(30, "y"), at(100, "y")])[1]]
    assert held == ["x", "y"]


NETWORK = "frame_id int, s int, bssid string, ta string, ssid string, is_beacon boolean, ibss boolean, bcn_int int, adv_channel int, cipher_bits int, group_cipher int"
X, Y = "02:00:00:00:00:0a", "02:00:00:00:00:0b"
#: Rows after (bssid, ta, ssid, is_beacon, ibss, bcn_int, adv_channel, cipher_bits, group_cipher), and the events of each.
NETWORK_CASES = {
    "hidden names never show": ([(X, X, "", True, False, 100, 1, 0, 0), (X, X, "net", False, False, 100, 1, 0, 0)], [(0, "new")]),
    "a name of NULs is hidden": ([(X, X, "\0\0", True, False, 100, 1, 0, 0)], [(0, "new")]),
    "renamed, odd the first time": ([(X, X, n, False, False, 100, 1, 0, 0) for n in ("a", "b", "", "b", "c")], [(0, "new"), (1, "renamed!"), (4, "renamed")]),
    "named in a beacon": ([(X, X, "a", False, False, 100, 1, 0, 0), (X, X, "", True, False, 100, 1, 0, 0), (X, X, "a", True, False, 100, 1, 0, 0), (X, X, "a", True, False, 100, 1, 0, 0)], [(0, "new"), (2, "named_in_beacon")]),
    "suspicious rows may only create": ([(X, Y, "a", False, False, 100, 1, 0, 0), (X, Y, "b", False, False, 200, 6, 4, 4), (X, X, "b", False, False, 100, 1, 0, 0)], [(0, "new"), (2, "renamed!")]),
    "channels": ([(X, X, "a", False, False, 100, c, 0, 0) for c in (1, 6, 1, 40, 0, None, 6, 31)], [(0, "new"), (1, "channel"), (7, "channel")]),
    "ciphers and group": ([(X, X, "a", False, False, 100, 1, c, g) for c, g in ((0, 0), (4, 0), (4, 2), (12, 2), (8, 4), (None, None))], [(0, "new"), (1, "ciphers"), (2, "group"), (3, "ciphers!"), (4, "group!")]),
    "interval": ([(X, X, "a", False, False, i, 1, 0, 0) for i in (100, 200, 200, 100)], [(0, "new"), (1, "interval!"), (3, "interval!")]),
    "an IBSS changes little": ([(X, Y, "a", False, True, 100, 1, 0, 0), (X, Y, "b", True, True, 200, 6, 4, 4), (X, X, "b", True, False, 100, 6, 0, 0)], [(0, "new"), (1, "renamed!"), (1, "named_in_beacon"), (2, "ibss!"), (2, "channel")]),
    "rejected rows": ([(None, X, "a", True, False, 100, 1, 0, 0), ("ff:ff:ff:ff:ff:ff", X, "a", True, False, 100, 1, 0, 0), (X, X, None, True, False, 100, 1, 0, 0), (X, X, "a", True, False, None, 1, 0, 0)], []),
}


def _networks(spark, cases):
    return spark.createDataFrame([(i, i, *r) for i, r in enumerate(cases)], NETWORK).withColumn("ts", F.timestamp_seconds("s"))


def _stream_networks(df, reveal=False, states=None):
    step, out, states = networks.network_step(reveal), [], states if states is not None else {}
    for r in networks.descriptions(df)[0].orderBy("frame_id").collect():
        states[r["bssid"]], more = step(states.get(r["bssid"]), [r.asDict()])
        out += more
    return out


@pytest.mark.parametrize("case", NETWORK_CASES)
def test_network_events(spark, case):
    """Whole, sliced and streamed forms give the same events of each rule."""
    given, want = NETWORK_CASES[case]
    df = _networks(spark, given)
    streamed = _stream_networks(df)
    assert [(e["frame_id"], e["event"] + "!" * e["odd"]) for e in streamed] == want
    columns = ["bssid", "frame_id", "event", "old", "new", "changed", "odd"]
    for seconds in (None, 2):
        assert rows(networks.network_events(df, slice_seconds=seconds).select(columns)) == sorted(tuple(e[c] for c in columns) for e in streamed)
    assert networks.descriptions(df)[1].count() == (len(given) if case == "rejected rows" else 0)


def test_networks_after_all_rows(spark):
    """The state of the batch is that of the stream, and a stream goes on from it."""
    rng = random.Random(6)
    given = [(rng.choice([X, Y]), rng.choice([X, Y]), rng.choice(["", "a", "b", "a"]), rng.random() < 0.5, rng.random() < 0.2, rng.choice([100, 100, 200]), rng.choice([0, 1, 6, 11, None]), rng.choice([0, 4, 8, 12]), rng.choice([0, 2, 4])) for _ in range(120)]
    for reveal in (False, True):
        df, states = _networks(spark, given), {}
        streamed = _stream_networks(df, reveal, states)
        latest = {r["bssid"]: networks.known_network(r.asDict(), reveal) for r in networks.network_state(df, reveal=reveal, slice_seconds=9).collect()}
        assert latest == states
        assert rows(networks.network_events(df, reveal=reveal, slice_seconds=9).select("frame_id", "event", "odd")) == sorted((e["frame_id"], e["event"], e["odd"]) for e in streamed)
        first = df.filter("s < 60")
        warm = {r["bssid"]: networks.known_network(r.asDict(), reveal) for r in networks.network_state(first, reveal=reveal).collect()}
        assert _stream_networks(df.filter("s >= 60"), reveal, warm) == [e for e in streamed if e["frame_id"] >= 60]


def test_channel_changes_keep_all_rows(spark):
    df = spark.createDataFrame([(1, 0, 1, 1), (2, 1, 1, None), (3, 2, 1, 6), (4, 3, 1, 1), (5, 4, 1, 6), (6, 90_000, 1, 1)], "frame_id int, s int, ap int, channel int").withColumn("ts", F.timestamp_seconds("s"))
    out = windows.channel_changes(df, order=["frame_id"], log_per_day=2, push_per_day=1, frame="frame_id").orderBy("ts")
    assert [(r["prev_chan"], r["new_chan"], r["logged"], r["pushed"], r["prev_frame"], r["new_frame"]) for r in out.collect()] == [(1, 6, True, True, 1, 3), (6, 1, True, False, 3, 4), (1, 6, False, False, 4, 5), (6, 1, True, True, 5, 6)]


def test_skew_paths(spark):
    edges = spark.createDataFrame([(0, 1, 10, 1), (1, 2, 5, 2), (0, 3, 7, 1), (3, 2, 100, 1), (1, 0, -10, 1)], "src int, dst int, skew_us long, spread_us long")
    assert rows(graph.skew_paths(edges, 0, ())) == [(0, 0, 0, 0), (1, 1, 10, 1), (2, 2, 15, 3), (3, 1, 7, 1)]
    captures = spark.createDataFrame([(2, 100), (9, 100)], "sniffer_id int, ts_us long")
    skews = graph.skew_paths(edges, 0, ()).select("sniffer_id", "skew_us", "spread_us")
    assert rows(state.apply_skew(captures, skews).select("sniffer_id", "ts_us", "err_us")) == [(2, 85, 50), (9, 100, 100_000)]


def test_routes_over_wires_and_to_the_coordinator(spark):
    table = spark.createDataFrame([(i, 30, i + 1) for i in range(1, 30)] + [(40, 99, 41), (42, 99, 40), (50, 60, 99), (99, 60, 60)], "src long, dst long, gateway long")
    wired = spark.createDataFrame([(41, 99), (1, 2), (1, 30)], "src long, dst long")
    pairs = spark.createDataFrame([(10, 30), (9, 30), (42, 99), (41, 99), (1, 2), (1, 30), (50, 60)], "src long, dst long")
    done, lost = graph.walk_routes(pairs, table, 20, wired, 99)
    got = {(r["src"], r["dst"]): [(x["a"], x["b"]) for x in r["links"]] for r in done.collect()}
    # 20 hops arrive and 21 do not; wires alone have no links; the hop to the coordinator adds none
    assert got == {(10, 30): [(i, i + 1) for i in range(10, 30)], (42, 99): [(40, 42), (40, 41)], (41, 99): [], (1, 2): [], (1, 30): []}
    assert rows(lost) == [(9, 30), (50, 60)]


def test_skews_follow_the_time(spark):
    merge = "frame_id long, ts_us long, members array<struct<sniffer_id:int,ts_us:long>>"
    at = lambda i, t, skew: (i, t, [(0, t), (1, t + skew)])
    history = state.skew_history(spark.createDataFrame([at(1, 0, 5), at(2, 10, 7), at(3, 150, 9), at(4, 420, 9)], merge), slice_us=100)
    forth = sorted((r["slice"], r["skew_us"], r["spread_us"]) for r in history.collect() if r["src"] == 0)
    assert forth == [(1, 7, 2), (2, 7, 4), (3, 7, 4), (4, 7, 4)]
    paths = graph.skew_paths(history, 0)
    assert sorted((r["slice"], r["sniffer_id"], r["skew_us"]) for r in paths.collect()) == [(s, n, 7 * n) for s in (1, 2, 3, 4) for n in (0, 1)]
    captures = spark.createDataFrame([(1, 50), (1, 150), (2, 150), (0, 10), (0, 20)], "sniffer_id int, ts_us long")
    assert state.base_sniffer(captures, 100) == (0, 110) and state.base_sniffer(captures, 0) == (0, 10)
    moved = state.apply_skew(captures, paths, slice_us=100, warmup_end=40)
    assert rows(moved.select("sniffer_id", "local_us", "ts_us", "err_us")) == [(0, 10, 10, 0), (0, 20, 20, 0), (1, 50, 50, 100_000), (1, 150, 143, 50), (2, 150, 150, 100_000)]


def test_walk_routes_and_loops(spark):
    table = spark.createDataFrame([(1, 4, 2), (2, 4, 3), (3, 4, 4), (5, 6, 7), (7, 6, 5)], "src long, dst long, gateway long")
    pairs = spark.createDataFrame([(1, 4), (5, 6), (1, 9)], "src long, dst long")
    done, lost = graph.walk_routes(pairs, table, 5)
    assert [(r["src"], [(x["a"], x["b"]) for x in r["links"]]) for r in done.collect()] == [(1, [(1, 2), (2, 3), (3, 4)])]
    assert rows(lost) == [(1, 9), (5, 6)]


def test_recent_majority_gateway(spark):
    data = [(1, 2, 7, 0), (1, 2, 8, 9000), (1, 2, 9, 9001), (1, 2, 9, 9002)]
    df = spark.createDataFrame(data, "src int, dst int, gateway int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(graph.routes(df)) == [(1, 2, 9)]


@pytest.mark.parametrize(
    ("text", "want"),
    [("a=1 b=2", {"a": "1", "b": "2"}), ('host=x q="a b" flag', {"host": "x", "q": "a b", "flag": None}), ("", {}), ("a=1 a=2", {"a": "2"}), ('a="', None), ("=1", None), ("kern_recv=5", {"kern-recv": "5"})],
)
def test_kv_map(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(scalars.kv_map(F.col("t"), dashes=True)).first()[0]
    assert got == want


def test_log_lines_and_tables(spark):
    rest = "kern-drop=1 mem-drop=0 pre-capt-pkts=5 pre_capt_bytes=500 post-capt-pkts=4 post-capt-bytes=400"
    lines = spark.createDataFrame([(f"Mar 03 10:00:00.250 pcap INFO STATS host=a kern-recv=5 {rest}",), (f"Dec 30 10:00:00.000 pcap INFO STATS host=a kern-recv=x {rest}",), ("rubbish",)], "value string")
    entries, bad = metrics.parse_log(lines, F.lit("2024-06-01").cast("timestamp"))
    assert sorted(str(r["ts"])[:10] for r in entries.collect()) == ["2023-12-30", "2024-03-03"]
    assert rows(bad) == [("rubbish",)]
    good, rejected = metrics.typed_table(entries, metrics.TABLES["pcap_stats"])
    assert [(r["host"], r["kernel_recv"]) for r in good.collect()] == [("a", 5)] and rejected.count() == 1
    assert len(metrics.METRICS) == 34 and len(metrics.TABLES) == 9


def test_reports_keep_time_and_metrics_their_hosts(spark):
    lines = [("2024-01-01 00:00:00", "pcap", "STATS host=a kern-recv=5"), ("2024-01-01 00:00:30", "wifi_ol", "created 3 new routes; updated 0 routes"), ("2024-01-01 00:01:00", "pcap", "STATS host=s kern-recv=7"), ("2024-01-01 00:01:10", "script", 'STATS note="kern-recv=9 x" host=a kern_recv=6')]
    entries = spark.createDataFrame(lines, "ts string, source string, data string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r["metric"], r["host"], round(r["value"], 6)) for r in metrics.metric_values(entries, metrics.METRICS, "s").collect()}
    assert got == {("kern-recv", "a", 0.5), ("kern-recv", "a", 0.6), ("route-additions", "s", 3.0), ("route-changes", "s", 0.0)}
    assert [(r["event"], r["n"]) for r in metrics.route_events(entries, "s").orderBy("event").collect()] == [("addition", 3), ("change", 0)]
    spec = metrics.TableSpec("pcap", "STATS", {"host": ("host", "string"), "n": ("n", "long")})
    rows_ = [("2024-01-01 00:00:00", "STATS host=a n=1"), ("2024-01-01 00:00:10", "STATS host=a n=bad"), ("2024-01-01 00:00:15", "STATS host=a n=2")]
    e = spark.createDataFrame([(t, "pcap", d) for t, d in rows_], "ts string, source string, data string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r["n"], r["duration_msec"]) for r in metrics.typed_table(e, spec)[0].orderBy("n").collect()] == [(1, 10_000), (2, 5_000)]


def test_log_reader_holds_lines_back(spark):
    """Against the reader itself: a heap that is emptied up to a window before the latest time."""
    import heapq
    import random

    rng = random.Random(1)
    lines = [(n, rng.randrange(0, 400) + n * 2) for n in range(300)]
    heap, top, want = [], 0, []
    for n, t in lines:
        while heap and top - heap[0][0] >= 60:
            want.append(heapq.heappop(heap)[1])
        heapq.heappush(heap, (t, n))
        top = max(top, t)
    while heap:
        want.append(heapq.heappop(heap)[1])
    df = spark.createDataFrame(lines, "line int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["line"] for r in metrics.log_order(df).orderBy("place").collect()] == want


def test_split_first_loses_no_row(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (None, "b"), (2, None), (2, "c"), (1, "b")], "k int, v string")
    every = sorted(map(str, df.collect()))
    for n in range(9):
        first, rest = filters.split_first(df, n, ["k"])
        assert first.count() == min(n, 7) and sorted(map(str, first.collect() + rest.collect())) == every
    one = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [rows(x) for x in filters.split_first(one, 1, ["k"])] == [[(1,)], [(1,), (2,)]]


def test_rows_without_arrival_are_in_order(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 30)], "s int, a int").select("s", F.timestamp_seconds("s").alias("ts"), F.timestamp_seconds("a").alias("arrival_ts"))
    on_time, late = windows.time_order(df, arrival_ts="arrival_ts")
    assert rows(on_time.select("s")) == [(1,), (2,)] and rows(late.select("s")) == [(3,)]


def test_uptime_counts_all_runs(spark):
    df = spark.createDataFrame([("h", s, 1.0, 1) for s in (0, 30, 90, 100, 400)], "host string, s int, cpu double, recv int").withColumn("ts", F.timestamp_seconds("s"))
    out = aggregates.host_status(df, F.timestamp_seconds(F.lit(459)), last=["cpu"], sums=["recv"]).first()
    # 30 s, a pause of exactly 60 s, 10 s, a pause
    assert (out["uptime"], out["recv"], out["online"]) == (40.0, 5, True)


def test_traffic_of_every_layer(spark):
    data = [(1, 0, 100, 0x800, 2, 8, 6, 80, 20, 1234, 80), (2, 0, 100, 0x800, 2, 8, 6, 60, 24, 80, 22), (3, 0, 50, 0x806, 2, 0, None, None, None, None, None), (4, 0, 70, 0x800, 2, 0, 17, 60, 20, 53, 53)]
    df = spark.createDataFrame(data, "frame_id int, s int, length int, ethertype int, ftype int, fsubtype int, ip_proto int, ip_len int, ip_hl int, sport int, dport int").withColumn("ts", F.timestamp_seconds("s"))
    out = aggregates.traffic_counts(df, "10 seconds", {"tcp": [(80, 80), (20, 30)], "udp": [(53, 53)]})
    assert sorted((r["kind"], r["code"], r["packets"], r["bytes"]) for r in out.collect()) == [("ether", 0x800, 3, 270), ("ether", 0x806, 1, 50), ("ip", 6, 2, 160), ("ip", 17, 1, 70), ("tcp", 20, 1, 36), ("tcp", 80, 2, 96), ("udp", 53, 1, 40), ("wifi", 2, 2, 120), ("wifi", 34, 2, 200)]


def test_web_flows_by_client(spark):
    packet = "event_id int, s int, src string, sport int, dst string, dport int, sniffer_id int, syn boolean, seq long, payload_len int, host string, cookie string, term string"
    data = [
        (1, 0, "c", 5000, "w", 80, 3, True, 100, 0, None, None, None),
        (2, 1, "c", 5000, "w", 80, 4, False, 101, 9, "h.com:80", None, "q=b"),
        (3, 2, "w", 80, "c", 5000, 5, False, 7, 9, None, "x.com", None),
        (4, 3, "w", 80, "c", 5000, 5, False, 8, 9, None, "y.com", None),
        (5, 4, "c", 5000, "w", 80, 6, False, 110, 9, "other", None, "q=a"),
        (6, 5, "c", 5000, "w", 80, 6, False, 119, 9, None, None, "q=b"),
        (7, 500, "c", 5000, "w", 80, 6, False, 200, 9, None, None, None),
        (8, 501, "c", 5000, "w", 80, 6, False, 209, 9, None, None, None),
        (9, 0, "c", 5000, "w", 443, 6, False, 1, 9, None, None, None),
    ]
    df = spark.createDataFrame(data, packet).withColumn("ts", F.timestamp_seconds("s"))
    flows = lambda **o: [(r["client"], r["server"], r["session"], r["sniffer_id"], r["host"], r["cookie"], r["terms"], r["flags"]) for r in state.web_flows(state.client_side(df), **o).orderBy("session").collect()]
    assert flows() == [("c", "w", 1, 3, "h.com", "x.com", "q=b&q=a", 63), ("c", "w", 2, 6, None, None, "", 1)]
    assert [f[-1] for f in flows(compat=True)] == [63, 3]


def test_scalar_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(scalars.escape_ssid(F.lit('a"b'))) == "612262" and value(scalars.escape_ssid(F.lit("ab c"))) == "ab c"
    assert value(scalars.visible_ssid(F.lit("\x00\x00"))) == ""
    assert value(scalars.site_of_host(F.lit("WWW.a.b.com:80"))) == "b.com"
    assert value(scalars.site_of_host(F.lit("mail.google.com"))) == "mail.google.com"
    assert value(scalars.site_of_host(F.lit("www.x.co.uk"))) == "x.co.uk"
    assert value(scalars.site_of_host(F.lit("10.0.0.1"))) is None
    assert value(scalars.search_query(F.lit("/s?x=1&q=spark+sql&z"), F.lit("h"))) == "q=spark+sql"
    assert value(scalars.search_query(F.lit("/s?q=ab"), F.lit("h"))) == "q=ab"
    assert value(scalars.search_query(F.lit("/s?q=&p=x"), F.lit("h"))) is None
    assert value(scalars.cookie_domain(F.lit("Set-Cookie: a=b; domain=.x.com; path=/\r\nSet-Cookie: c=d; Domain=www.x.com"))) == "www.x.com"
    assert tuple(value(scalars.port_range(F.lit("20-21")))) == (20, 21) and tuple(value(scalars.port_range(F.lit("80")))) == (80, 80)
    assert value(scalars.is_multicast(F.lit("01:00:5e:00:00:01"))) and not value(scalars.is_multicast(F.lit("00:00:5e:00:00:01")))
    assert value(scalars.cipher_bits(F.array(F.lit(4), F.lit(4)), sum_repeats=True)) == 8 and value(scalars.cipher_names(F.lit(6))) == "TKIP,CCMP"
    assert value(scalars.alert_fields(F.lit("IP Count: 7\n"))["ip_count"]) == 7 and value(scalars.alert_fields(F.lit(""))["ip_count"]) == -1
    assert value(scalars.human_bytes(F.lit(1536))) == "1.50 KiB"


def test_print_and_shift(spark):
    out = state.merge_captures(spark.createDataFrame([(1, 7, 0, 1, 6, -50, -95, False), (2, 7, 40, 2, 6, -60, -95, False)], CAPTURE))
    assert [r["line"] for r in projections.print_merged(out).collect()] == ["1 ts=40 chan=6 n=2"]
    assert projections.print_merged(out, detailed=True).count() == 2
    times = spark.createDataFrame([(5,), (7,)], "s int").withColumn("ts", F.timestamp_seconds("s"))
    moved = projections.shift_time(times, 0, now=F.timestamp_seconds(F.lit(100))).select(F.unix_seconds("ts"))
    assert rows(moved) == [(100,), (102,)]


def test_bytes_of_all_documents(spark, tmp_path):
    texts = ["plain text of more than 24 bytes", "\u00e4\u20ac\U0001f600 caf\u00e9", "\u00fc", "a", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    raw = [t if t is None else t.encode() for t in texts]
    got = {r["doc_id"]: (r["body"], r["header"]) for r in frames.QUERIES["prj_1_strip_bytes"](spark, str(tmp_path)).collect()}
    assert got == {i: (None, None) if b is None else (b[: max(len(b) - 4, 0)].hex().upper(), b[:24].hex().upper()) for i, b in enumerate(raw)}
    fields = [int.from_bytes(b[1:3], "big") for b in raw if b is not None and len(b) >= 3]
    assert rows(frames.QUERIES["agg_2_field_sum_bytes"](spark, str(tmp_path))) == [(sum(fields), len(fields))]


SMALL = "/root/testdata/sf0.001"


def test_channel_history_of_all_frames(spark):
    got = dict(rows(frames.QUERIES["jn_8_asof_channel_all"](spark, SMALL)))
    by_time = {}
    for f in view(spark, SMALL, "fx_frames").collect():
        by_time.setdefault(f["sniffer_id"], {}).setdefault(f["ts"], []).append(f)
    want = {}
    for times in by_time.values():
        channel = 0
        for ts in sorted(times):
            want |= {f["frame_id"]: channel for f in times[ts]}
            channel = max(f["channel"] for f in times[ts])
    assert got == want


def test_log_merge_and_escape_of_all_rows(spark):
    merged = [(r["ts"], r["event_id"], r["data"]) for r in frames.QUERIES["srt_5_log_merge_all"](spark, SMALL).collect()]
    assert merged == sorted((r["ts"], r["event_id"], r["data"]) for r in view(spark, SMALL, "fx_loglines").collect()) and len(merged) > 50
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    plain = lambda t: all(" " <= c <= "~" and c != '"' for c in t)
    assert dict(rows(frames.QUERIES["fn_2_escape_all"](spark, SMALL))) == {i: t if t is None or plain(t) else t.encode().hex().upper() for i, t in texts.items()}


def test_skew_paths_of_many_hops(spark):
    edges = spark.createDataFrame([(i, i + 1, 10, 1) for i in range(9)] + [(i + 1, i, -10, 1) for i in range(9)], "src int, dst int, skew_us long, spread_us long")
    assert rows(graph.skew_paths(edges, 0, ())) == [(i, i, 10 * i, i) for i in range(10)]


def test_keyed_rows_are_streamed(spark):
    """One key over many Arrow batches: the state goes on, and no list of the key's rows is built."""
    df = spark.range(25_000).select(F.lit("a").alias("k"), (F.col("id") * 4_000_000).alias("us"))
    out = state.run_keyed(df, ["k"], ["us"], state.last_accepted("us", 6_000_000, ["k", "us"]), "k string, us long")
    assert [r["us"] for r in out.orderBy("us").collect()] == [i * 8_000_000 for i in range(12_500)]
    assert "collect_list" not in out._jdf.queryExecution().toString()


def _numbered(rows):
    """ta, ra, tid, ftype, fsubtype, retry, seq[, seconds] as frames."""
    return [(n, datetime(2024, 1, 1) + timedelta(seconds=r[7] if len(r) > 7 else n), *r[:7]) for n, r in enumerate(rows)]


NUMBERED = "frame_id long, ts timestamp, ta string, ra string, tid int, ftype int, fsubtype int, retry boolean, seq int"
A, B, ALL = "02:00:00:00:00:01", "02:00:00:00:00:02", "ff:ff:ff:ff:ff:ff"
#: One case a branch: rows (ra, tid, ftype, fsubtype, retry, seq) of one station, and what each infers.
INFERENCES = {
    "control frames have no number": ([(B, None, 2, 0, False, 100), (B, None, 1, 13, False, 0), (B, None, 2, 0, False, 105)], [1, 0, 5]),
    "first small number": ([(B, None, 2, 0, False, 5)], [5]),
    "retry steps back": ([(B, None, 2, 0, False, 100), (B, None, 2, 0, True, 98), (B, None, 2, 0, False, 97)], [1, 1, 4095]),
    "a counter for each receiver and class": ([(B, 0, 2, 8, False, 100), (A, 0, 2, 8, False, 7), (B, 0, 2, 8, False, 103), (A, 0, 2, 8, False, 9), (B, 5, 2, 8, False, 900)], [1, 7, 3, 2, 1]),
    "other frames pass QoS frames over": ([(B, None, 2, 0, False, 10), (B, 0, 2, 8, False, 2000), (B, None, 0, 4, False, 12)], [1, 1, 2]),
    "group addresses use the common counter": ([(B, None, 2, 0, False, 10), (ALL, 0, 2, 8, False, 11)], [1, 1]),
    "null frames count one": ([(B, 0, 2, 8, False, 100), (B, 0, 2, 12, False, 3000), (B, 0, 2, 8, False, 102)], [1, 1, 2]),
    "null frames may take numbers": ([(B, 0, 2, 8, False, 100), (B, 0, 2, 12, False, 104), (B, 0, 2, 8, False, 105)], [1, 1, 1]),
    "a change of class restarts": ([(B, 0, 2, 8, False, 100), (B, 5, 2, 8, False, 200), (B, 0, 2, 8, False, 2)], [1, 1, 3]),
    "one counter for all: vote": ([(B, None, 2, 0, False, 100), (B, 0, 2, 8, False, 101), (A, 0, 2, 8, False, 102), (B, None, 2, 0, False, 500), (B, 0, 2, 8, False, 501), (B, None, 2, 0, False, 502)], [1, 1, 1, 400, 1, 1]),
    "both steps large: QoS counter": ([(B, 0, 2, 8, False, 100), (B, None, 2, 0, False, 3000), (B, 0, 2, 8, False, 150)], [1, 1, 50]),
}


@pytest.mark.parametrize("case", INFERENCES)
def test_frames_inferred(spark, case):
    rows, want = INFERENCES[case]
    df = spark.createDataFrame(_numbered([(A, *r) for r in rows]), NUMBERED)
    for seconds in (None, 2):
        got = stations.inferred_frames(df, slice_seconds=seconds).orderBy("frame_id").collect()
        assert [r["inferred"] for r in got] == want
    _, out = stations.inference_step()(None, [r.asDict() | {"ts_us": int(r["ts"].timestamp() * 1e6)} for r in df.collect()])
    assert [r["inferred"] for r in out] == want


def _votes(kind, n):
    """A station that n votes find with QoS counters (-1) or with one counter only (+1), and then a frame that tells."""
    rows = []
    for i in range(n):
        if kind < 0:  # steps of the QoS counter are small, those of all frames large
            rows += [(A, B, None, 2, 0, False, 1000 + i), (A, B, 0, 2, 8, False, 2000 + i)]
        else:  # every class counts on from the common number
            rows += [(A, B, 0, 2, 8, False, (100 + 20 * i) % 4096), (A, B, None, 2, 0, False, (118 + 20 * i) % 4096), (A, B, 0, 2, 8, False, (119 + 20 * i) % 4096)]
    return rows


@pytest.mark.parametrize(("kind", "n", "votes"), [(-1, 40, -16), (1, 20, 20), (1, 300, 256)])
def test_stations_are_decided_by_votes(spark, kind, n, votes):
    """Sliced, whole and streamed forms agree before and after a decision, and when a station is forgotten."""
    rows = [(*r, i // 4) for i, r in enumerate([*_votes(kind, n), (A, B, 0, 2, 8, False, 3000), (A, B, None, 2, 0, False, 1400)])]
    rows += [(A, B, 0, 2, 8, False, 6, 5000), (B, A, 0, 2, 8, False, 9, 5001)]
    df = spark.createDataFrame(_numbered(rows), NUMBERED)
    forms = [[r["inferred"] for r in stations.inferred_frames(df, slice_seconds=s).orderBy("frame_id").collect()] for s in (None, 7)]
    states, streamed = {}, []
    step = stations.inference_step()
    for r in df.orderBy("frame_id").collect():
        states[r["ta"]], out = step(states.get(r["ta"]), [r.asDict() | {"ts_us": int(r["ts"].timestamp() * 1e6)}])
        streamed.append(out[0]["inferred"])
        if r["frame_id"] == len(rows) - 4:
            assert states[A]["votes"] == votes
    assert forms[0] == forms[1] == streamed
    assert streamed[-2] == 6  # begun anew: a first small number


def test_station_report(spark):
    """Bytes by kind, beacons as their interval says, roles; columns that captures lack add nothing."""
    at = datetime(2024, 1, 1)
    schema = NUMBERED + ", length int, protected boolean, dir int, ethertype int, ibss boolean, bcn_int int"
    rows = [
        (1, at, A, B, None, 2, 0, False, 10, 134, False, 1, 2048, None, None),
        (2, at, A, B, None, 2, 0, False, 11, 200, True, 2, 2048, None, None),
        (3, at, A, B, 0, 2, 8, False, 12, 140, False, 3, 2048, None, None),
        (4, at, A, B, None, 2, 4, False, 12, 24, False, 0, None, None, None),
        (5, at, B, ALL, None, 0, 8, False, 1, 90, False, 0, None, True, 100),
        (6, at + timedelta(seconds=1), B, ALL, None, 0, 8, False, 2, 90, False, 0, None, True, 100),
        (7, at + timedelta(seconds=300), B, ALL, None, 0, 8, False, 3, 90, False, 0, None, False, 100),
        (8, at + timedelta(seconds=301), B, ALL, None, 0, 8, False, 4, 90, False, 0, None, False, 200),
        (9, at, None, ALL, None, 0, 8, False, 4, 90, False, 0, None, False, 200),
    ]
    out = {(r["ta"], r["start"]): r for r in stations.station_stats(spark.createDataFrame(rows, schema)).collect()}
    a, b, c = out[A, at], out[B, at], out[B, at + timedelta(seconds=300)]
    assert len(out) == 3
    assert (a["packets"], a["bytes"], a["data_bytes"], a["encrypt_data_bytes"], a["layer3_bytes"], a["flags"]) == (4, 498, 474, 200, 104 + 102, 3)
    assert (b["beacons"], b["inferred_beacons"], b["flags"]) == (2, 300_000_000 // 102_400, 6)
    assert (c["beacons"], c["inferred_beacons"], c["flags"]) == (2, 0, 2)
    bare = stations.station_stats(spark.createDataFrame(rows, schema).drop("protected", "dir", "ethertype", "ibss", "bcn_int", "ra", "tid"))
    assert {r["ta"]: r["data_bytes"] for r in bare.filter("start = '2024-01-01'").collect()} == {A: 474, B: 0}


@pytest.mark.parametrize("kind", ["last", "first", "max", "min", "sum"])
@pytest.mark.parametrize("inclusive", [False, True])
def test_segmented_scans_equal_whole_windows(spark, kind, inclusive):
    """Any slice length gives the plain window's values, with null keys and values and parts of a key."""
    rng = np.random.default_rng(4)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=int(rng.integers(0, 4000))), None if i % 11 == 0 else int(i % 3 > 0), int(rng.integers(0, 2)), None if i % 5 == 0 else int(rng.integers(-50, 50))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k int, part int, x int")
    columns = {"a": Scan(kind, F.col("x"), (), inclusive), "b": Scan(kind, F.col("x"), ("part",), inclusive)}
    forms = [sorted(tuple(r) for r in scan(df, ["k"], ["ts", "id"], columns, F.unix_micros("ts"), s).select("id", "a", "b").collect()) for s in (None, 10, 700)]
    assert forms[0] == forms[1] == forms[2]


def test_chain_ends_against_a_walk():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        times = np.unique(rng.integers(0, 3000, n))
        ends = state.chain_ends(times, 20)
        for i, t in enumerate(times):
            last = t
            for u in times[i:]:
                if u - last > 20:
                    last = u
            assert ends[i] == last


@pytest.mark.parametrize("slice_seconds", [6, 30, 1000])
def test_a_hot_key_is_suppressed_in_slices(spark, slice_seconds):
    """Slices give the rows of the sequential walk, for keys of every kind: hot and not, null, with ties and long pauses."""
    rng = random.Random(9)
    rows, n = [], 0
    for key, size, span in ((1, 600, 900), (2, 5, 900), (None, 150, 4000), (3, 200, 50), (4, 1, 1)):
        for _ in range(size):
            rows.append((n, key, datetime(2024, 1, 1) + timedelta(milliseconds=rng.randrange(span * 1000) // 250 * 250)))
            n += 1
    df = spark.createDataFrame(rows, "id long, k int, ts timestamp")
    want, last = [], {}
    for i, k, t in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        if k not in last or (t - last[k]).total_seconds() > 6:
            last[k] = t
            want.append(i)
    for hot in (None, 100, 1):
        got = state.suppress_repeats(df, ["k"], window_seconds=6, order=["id"], hot_rows=hot, slice_seconds=slice_seconds)
        assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_one_key_is_many_tasks(spark):
    """A key with all rows is dealt over the tasks; none gets much more than its share."""
    n = 4000
    df = spark.range(n).select(F.col("id"), F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 30).alias("ts"))
    whole = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(whole, "false")  # small tasks would be joined
    try:
        tasks = state._suppress_in_slices(df.withColumn("_us", F.unix_micros("ts")), ["k"], 6_000_000, ["id"], 3_600_000_000)
        sizes = [r["n"] for r in tasks.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset(whole)
    assert sum(sizes) == n and len(sizes) > 1 and max(sizes) < 0.6 * n


def test_islands_of_hot_contents_and_stations(spark, tmp_path):
    """Captures merged and stations followed in slices equal the plain form."""
    rng = random.Random(3)
    captures = [(i, rng.choice([1, 1, 1, 2]), rng.randrange(0, 60_000_000, 50_000), rng.randrange(4), 1 + rng.randrange(3), -40 - rng.randrange(40), -95, rng.random() < 0.2, rng.randrange(50, 400)) for i in range(500)]
    df = spark.createDataFrame(captures, "frame_id long, payload_hash long, ts_us long, sniffer_id int, channel int, rssi int, noise int, is_ctrl boolean, err_us int")
    plain, sliced = (rows(state.merge_captures(df, hot_rows=hot, slice_seconds=2)) for hot in (None, 10))
    assert plain == sliced and len(plain) < 500
    frames_ = [(i, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(20_000)), 2, 0, rng.randrange(3), A, rng.choice([B, "02:00:00:00:00:03"]), rng.choice([B, "02:00:00:00:00:03"])) for i in range(300)]
    df = spark.createDataFrame(frames_, "frame_id long, ts timestamp, ftype int, fsubtype int, dir int, ta string, ra string, bssid string")
    plain, sliced = (rows(state.associations(df, hot_rows=hot, slice_seconds=700)) for hot in (None, 10))
    assert plain == sliced and plain


def test_windows_in_slices_equal_whole_windows(spark):
    """Sessions, pings, rolling medians and covered ranges give the same in slices of any length, with null keys, pauses and sparse slices."""
    rng = random.Random(21)
    data = [(i, None if i % 13 == 0 else i % 3, datetime(2024, 1, 1) + timedelta(seconds=rng.choice([rng.randrange(300), rng.randrange(40_000)])), rng.choice([0, *range(30)]), rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, k int, ts timestamp, seq int, x int")
    order = ["ts", "id"]
    forms = {
        "sessions": lambda s: windows.gap_sessions(df, ["k"], gap_seconds=60, order=["id"], slice_seconds=s).select("id", "session"),
        "pings": lambda s: windows.ping_loss(df, "k", order, slice_seconds=s),
        "medians": lambda s: windows.rolling_median(df.filter("k is not null"), ["k"], order, "x", 5, slice_seconds=s).select("id", "median", "spread"),
        "ranges": lambda s: windows.coverage_ranges(df.filter("k is not null"), "k", "seq", "x", slice_length=s)[0],
    }
    for name, form in forms.items():
        whole = sorted(map(str, map(tuple, form(None).collect())))
        for seconds in (7, 900):
            assert sorted(map(str, map(tuple, form(seconds).collect()))) == whole, name


#: Lines that report a metric, and the value each gives.
REPORTS = {
    "cpu": ("system", "SYSINFO host=node1 cpu-10=3", 3.0),
    "kern-recv": ("pcap", "STATS host=node1 kern-recv=25", 2.5),
    "merge-rate": ("wifi_merge", "STATS host=node1 avg_merge=1.5 out_merges=2", 1.5),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_series_take_the_exact_mean_time(spark, name):
    """Sums of microseconds pass 2**53 after a few reports of a window; the time is the double nearest the mean, rounded down."""
    source, data, value = REPORTS[name]
    rng, times = random.Random(5), []
    for hour in range(200):
        start = datetime(1960 if hour % 50 == 0 else 2024, 1, 1) + timedelta(hours=hour)
        times += [start + timedelta(microseconds=rng.randrange(3_600_000_000)) for _ in range(20 + hour)]
    rng.shuffle(times)
    entries = spark.createDataFrame([(t, source, data) for t in times], "ts timestamp, source string, data string").repartition(7)
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    held = {}
    for t in times:
        held.setdefault(us(t) // 3_600_000_000, []).append(us(t))
    one = (lambda n: value * n) if name == "kern-recv" else (lambda n: value)
    want = sorted((math.floor(float(Fraction(sum(x), len(x)))), round(one(len(x)), 6)) for x in held.values())
    got = metrics.metric_series(entries, name, "server", window=3600).select(F.unix_micros("ts"), F.round("value", 6))
    assert rows(got) == want


@pytest.mark.parametrize("nameless", [(), (2,), (4,)])
def test_spark_forms_give_the_rows_of_their_sql(spark, nameless):
    """Stations with and without rows on either list, without flags or address; nameless: flags of rows without address."""
    rng = random.Random(7)
    maybe = lambda *values: rng.choice([None, *values])
    data = [(rng.randrange(60), datetime(2024, 1, 1, 0, rng.randrange(60)), maybe(0, 0, 0, 1), maybe(0, 1, 2), maybe(1, 5), maybe(1, 2, 2, 2, 3, 6 if rng.random() < 0.4 else 2)) for _ in range(200)]
    data += [(None, datetime(2024, 1, 1), 0, 1, 1, flags) for flags in nameless]
    spark.createDataFrame(data, "mac long, ts timestamp, beacons long, inferred_beacons long, packets long, flags int").createOrReplaceTempView("fx_station_stats")
    try:
        for name, form in analyst.SPARK_FORMS.items():
            want = rows(spark.sql(analyst.QUERIES[name]))
            assert rows(spark.sql(form)) == want and bool(want) == (4 not in nameless), name
    finally:
        spark.catalog.dropTempView("fx_station_stats")


def test_no_list_of_stations_is_broadcast(spark):
    """Half the rows of lineitem are on the NOT IN list."""
    plan = queries()["q40"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "BroadcastExchange" not in plan


def test_pairs_are_found_once(spark):
    """One parse of a line gives every field what a search for that field gives."""
    texts = ["HEAD a=1 b=2", "a=1 a=2", 'q="x y" z=3', "x_y=4 x-y=5", "x-y=5 x_y=6", "a= b=", 'a=1"x b=2', "=5 a=1", "a==1", "", None, "  lead=1", "a=1  b=2\tc=3\nd=4", 'a="" b="z"', "a b c", 'a="open b=2', "n=1/2|m=2", "a=1 b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in ("a", "b", "x-y", "x_y", "q", "z", "lead", "d", "n"):
        got = df.select("t", scalars.kv_field(F.col("t"), key).alias("one"), scalars.pair_value(scalars.line_pairs(F.col("t")), key).alias("all")).collect()
        assert [(r["t"], r["one"]) for r in got] == [(r["t"], r["all"]) for r in got], key


def test_staged_tables_can_be_cleared(spark):
    from aerolens.session import clear_staged, staged

    clear_staged(spark)
    rows_ = staged(spark.range(10), "rows")
    assert rows_.count() == 10 and clear_staged(spark) == 1 and clear_staged(spark) == 0
