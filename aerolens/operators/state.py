"""Keyed state: one step function per operator serves batch (grouped rows in Arrow batches) and streams (transformWithStateInPandas).

A step takes the state of a key and the key's rows in order and returns the new
state and the output rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .scan import Scan, by_heat, scan

Step = Callable[[Any, list[dict]], tuple[Any, list[dict]]]


def run_keyed(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str, finish: Callable[[Any], list[dict]] = lambda state: []) -> DataFrame:
    """Batch form of a step: the rows of each key in order, from an empty state; finish gives what a state still holds.

    Rows are sorted by Spark and streamed, with the state carried from batch to
    batch, so a key of any size is never held as a whole.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    rest = [c for c in df.columns if c not in order and c not in keys]
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order, *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out, same = [], []
            for row in batch.to_pylist():
                k = tuple(row[c] for c in keys)
                if k != key:
                    if same:
                        state, more = step(state, same)
                        out += more
                    out += finish(state)
                    key, state, same = k, None, []
                same.append(row)
            if same:
                state, more = step(state, same)
                out += more
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if left := finish(state):
            yield pa.RecordBatch.from_pylist(left, schema=arrow)

    return rows.mapInArrow(run, schema)


def keyed_ewma(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, shift: int = 4) -> DataFrame:
    """keys, ewma: the exponentially weighted mean of each key's values in order, streamed; each step moves 1 / 2^shift of the way."""

    def step(state: dict | None, rows: list[dict]) -> tuple[dict | None, list[dict]]:
        for row in rows:
            if row[value] is not None:
                mean = float(row[value]) if state is None else state["ewma"] + (row[value] - state["ewma"]) / (1 << shift)
                state = {k: row[k] for k in keys} | {"ewma": mean}
        return state, []

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", ewma double"
    return run_keyed(df.select(*keys, *(c for c in order if c not in keys), *([value] if value not in keys and value not in order else [])), keys, order, step, schema, lambda state: [state] if state else [])


def last_accepted(ts_us: str, window_us: int, keep: Sequence[str]) -> Step:
    """Accept a row unless it is at most the window after the last accepted one of its key, or before it."""

    def step(last: int | None, rows: list[dict]) -> tuple[int | None, list[dict]]:
        out = []
        for row in rows:
            t = row[ts_us]
            if last is None or t - last > window_us:
                last = t
                out.append({k: row[k] for k in keep})
        return last, out

    return step


def chain_ends(times: np.ndarray, window_us: int) -> np.ndarray:
    """For each of a slice's ascending times the last accepted one of the chain that starts there.

    Each time points to the first that is more than the window later; pointers
    double until they leave the slice, so a chain of n takes log n rounds.
    """
    n = len(times)
    to = np.searchsorted(times, times + window_us, side="right")
    last = np.arange(n)
    while (inside := to < n).any():
        # where the pointer stays inside, take over what the place pointed to knows
        at = to[inside]
        last[inside], to[inside] = last[at], to[at]
    return times[last]


def accepted_in_slice(times: np.ndarray, last: int | None, window_us: int) -> tuple[np.ndarray, int | None]:
    """(which of the ascending times are accepted after the last accepted one, the last accepted one then)."""
    keep = np.zeros(len(times), dtype=bool)
    at = 0 if last is None else int(np.searchsorted(times, last + window_us, side="right"))
    while at < len(times):
        keep[at], last = True, int(times[at])
        at = int(np.searchsorted(times, last + window_us, side="right"))
    return keep, last


def _runs(batches: Iterator[pa.RecordBatch], run: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(batch, edges of its runs of equal values of a column)."""
    for batch in batches:
        if batch.num_rows:
            values = batch.column(run).to_numpy(zero_copy_only=False)
            yield batch, np.concatenate([[0], 1 + np.flatnonzero(values[1:] != values[:-1]), [batch.num_rows]])


def _suppress_in_slices(df: DataFrame, keys: Sequence[str], limit: int, order: Sequence[str], slice_us: int) -> DataFrame:
    """Rows of hot keys that are no repeats, each slice of time in a task of its own; slices are at least as long as the window.

    What a slice does depends only on the last accepted time before it, and only
    through the place where its chain starts. So each slice first says, for every
    start within a window of its own begin, where the chain ends; a walk over
    these summaries, a row a slice, gives each slice its start; then every slice
    picks its rows. A slice's times are held as an array.
    """
    names = df.columns
    # runs have numbers, as keys may be of any types
    rows = df.withColumn("_slice", F.floor(F.col("_us") / slice_us)).withColumn("_run", F.xxhash64(*keys, "_slice"))
    run = [*keys, "_slice"]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    times = rows.select(*run, "_us").distinct().repartition(*run).sortWithinPartitions(*run, "_us").withColumn("_run", F.xxhash64(*run))
    arrow = to_arrow_schema(times.select(*run).schema)
    tail = pa.schema([*arrow, pa.field("_starts", pa.list_(pa.int64())), pa.field("_ends", pa.list_(pa.int64()))])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        head = None

        def done() -> pa.RecordBatch:
            t = np.concatenate(held)
            # later starts than this begin no chain that came from outside
            some = t[: int(np.searchsorted(t, t[0] // slice_us * slice_us + limit, side="right")) + 1]
            ends = chain_ends(t, limit)[: len(some)]
            # of starts with one end the last is enough: a chain that enters at or before it has that end
            keep = np.append(ends[1:] != ends[:-1], True)
            columns = [head.column(c) for c in run]
            return pa.RecordBatch.from_arrays([*columns, pa.array([some[keep].tolist()], pa.list_(pa.int64())), pa.array([ends[keep].tolist()], pa.list_(pa.int64()))], schema=tail)

        number = None
        for batch, edges in _runs(batches, "_run"):
            us, runs = batch.column("_us").to_numpy(), batch.column("_run").to_numpy()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if number != runs[a] and held:
                    yield done()
                    held = []
                if not held:
                    head, number = batch.slice(a, 1), runs[a]
                held.append(us[a:b])
        if held:
            yield done()

    schema = ", ".join(f"`{c}` {fields[c]}" for c in run)
    chains = times.mapInArrow(summarise, f"{schema}, _starts array<bigint>, _ends array<bigint>")

    def walk(last: int | None, parts: list[dict]) -> tuple[int | None, list[dict]]:
        out = []
        for part in parts:
            out.append({c: part[c] for c in run} | {"_last": last})
            at = 0 if last is None else bisect_right(part["_starts"], last + limit)
            if at < len(part["_starts"]):
                last = part["_ends"][at]
        return last, out

    starts = run_keyed(chains, keys, ["_slice"], walk, f"{schema}, _last bigint")
    joined = rows.withColumn("_at", F.struct(*run)).join(starts.select(F.struct(*run).alias("_at"), "_last"), "_at").drop("_at")
    dealt = joined.repartition(*run).sortWithinPartitions(*run, "_us", *order)
    out_schema = to_arrow_schema(df.schema)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = None, None
        for batch, edges in _runs(batches, "_run"):
            us, runs, entry = batch.column("_us").to_numpy(), batch.column("_run").to_numpy(), batch.column("_last").to_pylist()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if number != runs[a]:
                    number, last = runs[a], entry[a]
                keep[a:b], last = accepted_in_slice(us[a:b], last, limit)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).select(names).columns, schema=out_schema)

    return dealt.mapInArrow(pick, df.schema)


def suppress_repeats(df: DataFrame, keys: Sequence[str], ts: str = "ts", window_seconds: float = 6, order: Sequence[str] = (), hot_rows: int | None = 5_000_000, slice_seconds: float | None = None) -> DataFrame:
    """Rows that are not repeats of the last accepted row of their key within the window.

    A window of 0 only drops rows of equal time and is a window expression. Else
    rows further apart than the window start a new chain whatever came before,
    so a key is first cut into such islands; only islands of several rows need
    the chain. A key with more than hot_rows is cut into slices of time instead
    (slice_seconds, an hour or ten windows), see _suppress_in_slices, so it is
    many tasks. Rows without time are dropped.
    """
    us = F.unix_micros(ts)
    limit = int(window_seconds * 1_000_000)
    if limit == 0:
        w = Window.partitionBy(*keys).orderBy(ts, *order)
        return df.filter(F.col(ts).isNotNull()).withColumn("_new", F.coalesce(us - F.lag(us).over(w) > 0, F.lit(True))).filter("_new").drop("_new")
    slice_us = max(limit, int(1_000_000 * (slice_seconds or max(3600, 10 * window_seconds))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(rows: DataFrame, sliced: bool) -> DataFrame:
        if sliced:
            return _suppress_in_slices(rows, keys, limit, order, slice_us).select(*df.columns)
        w = Window.partitionBy(*keys).orderBy(ts, *order)
        marked = rows.withColumn("_new", F.coalesce((F.col("_us") - F.lag("_us").over(w) > limit).cast("int"), F.lit(1)))
        islands = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_island")))
        alone = islands.filter("_n = 1").select(*df.columns)
        chains = run_keyed(islands.filter("_n > 1"), [*keys, "_island"], ["_us", *order], last_accepted("_us", limit, df.columns), schema)
        return alone.unionByName(chains)

    return by_heat(df.filter(F.col(ts).isNotNull()).withColumn("_us", us), keys, hot_rows, run)


ASSOCIATION = "station string, ts_us long, bssid string, is_ap boolean, is_ibss boolean, sniffer_id int, event string"


def association_step(timeout_us: int = 300_000_000, refresh_us: int = 60_000_000, ap_hold_us: int = 60_000_000, tx_hold_us: int = 60_000_000, rx_guard: str = "documented") -> Step:
    """New station, changed BSSID, or a refresh when the last event is old; an access point holds its BSSID for a while.

    A frame that a station receives (as_tx false) may change its BSSID only when
    it has sent none for tx_hold_us. With rx_guard "code" every change is refused
    that long after the BSSID was last set by a sent frame, as the older system
    does. The state of a key is its BSSID, role, last event, last update, last
    sent frame and whether the BSSID is an IBSS; it ends after the timeout. An
    event names the sniffer of its frame, if rows have one.
    """
    documented = rx_guard == "documented"

    def step(state: tuple | None, rows: list[dict]) -> tuple[tuple | None, list[dict]]:
        out = []
        for row in rows:
            t, bssid, is_ap, as_tx = int(row["ts_us"]), row["bssid"], bool(row["is_ap"]), bool(row.get("as_tx", True))
            is_ibss = bool(row.get("is_ibss"))
            if state is not None and t - state[3] > timeout_us:
                state = None
            sent = t if as_tx else None
            if state is None:
                event = "new"
            elif bssid != state[0]:
                quiet = state[4] is None or t - state[4] >= tx_hold_us
                refused = not as_tx and not quiet if documented else quiet
                if (state[1] and t - state[3] <= ap_hold_us) or refused:
                    if documented and as_tx:
                        state = (*state[:4], t, state[5])
                    continue
                event, sent = "change", t if as_tx else state[4]
            else:
                last_tx = t if documented and as_tx else state[4]
                if t - state[2] < refresh_us:
                    state = (bssid, state[1], state[2], t, last_tx, state[5])
                    continue
                event, is_ap, is_ibss, sent = "refresh", state[1], state[5], last_tx
            state = (bssid, is_ap, t, t, sent, is_ibss)
            sniffer = row.get("sniffer_id")
            out.append({"station": row["station"], "ts_us": t, "bssid": bssid, "is_ap": is_ap, "is_ibss": is_ibss, "sniffer_id": None if sniffer is None else int(sniffer), "event": event})
        return state, out

    return step


def association_rows(df: DataFrame) -> DataFrame:
    """Two rows a data frame, for its transmitter and its receiver.

    Frames without data, to or from multicast addresses, and without a BSSID or
    with the broadcast one tell nothing. A frame of neither direction is one of
    an IBSS. Addresses are texts; sniffer_id may be missing.
    """
    from aerolens.functions.scalars import is_multicast

    us = F.unix_micros("ts")
    side = lambda address, role, sent: F.struct(F.col(address).alias("station"), (F.col("dir") == role).alias("is_ap"), F.lit(sent).alias("as_tx"))
    data = df.filter((F.col("ftype") == 2) & (F.col("fsubtype").bitwiseAND(F.lit(4)) == 0) & ~is_multicast(F.col("ra")) & ~is_multicast(F.col("ta")) & (F.col("bssid") != "ff:ff:ff:ff:ff:ff"))
    sniffer = F.col("sniffer_id") if "sniffer_id" in df.columns else F.lit(None)
    rows = data.select("frame_id", us.alias("ts_us"), "bssid", (F.col("dir") == 0).alias("is_ibss"), sniffer.cast("int").alias("sniffer_id"), F.explode(F.array(side("ta", 2, True), side("ra", 1, False))).alias("s"))
    return rows.select("frame_id", "ts_us", "bssid", "is_ibss", "sniffer_id", "s.station", "s.is_ap", "s.as_tx")


def associations(df: DataFrame, hot_rows: int | None = 5_000_000, slice_seconds: float = 3600, **options) -> DataFrame:
    """Association events of every station. A state ends after the timeout, so a station is cut at longer gaps.

    Of the two rows of one frame the sent one comes first. The gaps of a station
    with more than hot_rows are found slice by slice of time, so that only an
    island without such gaps is one task, and that is streamed.
    """
    timeout = options.get("timeout_us", 300_000_000)
    rows = association_rows(df).withColumn("_rx", ~F.col("as_tx"))

    def islands(rows: DataFrame, sliced: bool) -> DataFrame:
        order, length = ["ts_us", "frame_id", "_rx"], slice_seconds if sliced else None
        before = scan(rows, ["station"], order, {"_before": Scan("last", F.col("ts_us"))}, "ts_us", length)
        new = F.coalesce((F.col("ts_us") - F.col("_before") > timeout).cast("int"), F.lit(1))
        return scan(before.withColumn("_new", new), ["station"], order, {"_island": Scan("sum", F.col("_new"), inclusive=True)}, "ts_us", length).drop("_before", "_new")

    return run_keyed(by_heat(rows, ["station"], hot_rows, islands), ["station", "_island"], ["ts_us", "frame_id", "_rx"], association_step(**options), ASSOCIATION)


MERGED = "frame_id long, payload_hash long, ts_us long, channel int, is_dupe boolean, members array<struct<sniffer_id:int,ts_us:long,channel:int,rssi:int,noise:int>>"


def _bound(row: dict, max_err: int, ctrl_err: int) -> int:
    return min(row["err_us"], ctrl_err) if row["is_ctrl"] else max(row["err_us"], max_err)


def _member(row: dict) -> dict:
    return {"sniffer_id": int(row["sniffer_id"]), "ts_us": int(row["local_us"]), "channel": int(row["channel"]), "rssi": int(row["rssi"]), "noise": int(row["noise"])}


def merge_first(left: list[dict], *, max_err: int = 250_000, ctrl_err: int = 300, rssi_thresh: int = 5) -> tuple[dict, list[dict], int]:
    """(transmission of the earliest capture, the captures left, the time up to which captures belong to it or are duplicates).

    The earliest capture is the base. Its error bound opens a window; a later
    capture of the base's own sniffer closes it half way. One capture a sniffer
    inside the window belongs to the transmission. The channel is that of the
    strongest capture above the noise, unknown (0) if one nearly as strong
    disagrees. The time is that of the middle member on its own clock.
    """
    base = left[0]
    high = base["ts_us"] + _bound(base, max_err, ctrl_err)
    limit = high + max_err
    again = next((r["ts_us"] for r in left if r["sniffer_id"] == base["sniffer_id"] and r["ts_us"] != base["ts_us"]), None)
    if again is not None:
        limit = min(limit, base["ts_us"] + (again - base["ts_us"]) // 2)
    members, rest, taken = [], [], set()
    best, channel = -999, 0
    for r in left:
        if r["ts_us"] > limit or r["ts_us"] - r["err_us"] > high or r["sniffer_id"] in taken:
            rest.append(r)
            continue
        members.append(r)
        taken.add(r["sniffer_id"])
        strength = r["rssi"] - r["noise"]
        if strength > best + rssi_thresh:
            best, channel = strength, r["channel"]
        elif strength > best - rssi_thresh and r["channel"] != channel:
            channel = 0
    at = members[len(members) // 2]["local_us"] if len(members) > 1 else base["ts_us"]
    out = {"frame_id": base["frame_id"], "payload_hash": base["payload_hash"], "ts_us": int(at), "channel": int(channel), "is_dupe": False, "members": [_member(r) for r in members]}
    return out, rest, limit


def merge_step(**options) -> Step:
    """Captures of one content in time order: a transmission is put out when no later capture can belong to it.

    The state holds the captures within half a second of the earliest one left.
    """
    max_err, ctrl_err = options.get("max_err", 250_000), options.get("ctrl_err", 300)

    def step(left: list[dict] | None, rows: list[dict]) -> tuple[list[dict], list[dict]]:
        left, out = left or [], []
        for row in rows:
            while left and row["ts_us"] > left[0]["ts_us"] + _bound(left[0], max_err, ctrl_err) + max_err:
                done, left, _ = merge_first(left, **options)
                out.append(done)
            left.append(row)
        return left, out

    return step


def merge_rest(left: list[dict] | None, **options) -> list[dict]:
    """The transmissions of all captures left."""
    out = []
    while left:
        done, left, _ = merge_first(left, **options)
        out.append(done)
    return out


def arrival_step(timeout_us: int = 10_000_000, expiry_us: int = 120_000_000, **options) -> Step:
    """Captures of one content in the order of their arrival (arrival_us), as a merger that runs meets them.

    A transmission is put out the timeout after its earliest capture arrived. A
    capture that comes later with a time up to the limit of the last transmission
    is a duplicate, put out alone; the limit is forgotten the expiry after that
    transmission, if nothing is left by then. The state is (captures left in time
    order, limit, time of the last output).
    """

    def step(state: tuple | None, rows: list[dict]) -> tuple[tuple, list[dict]]:
        left, limit, last = state or ([], None, None)
        out = []
        for row in rows:
            now = row["arrival_us"]
            while left and left[0]["arrival_us"] + timeout_us <= now:
                last = left[0]["arrival_us"] + timeout_us
                done, left, limit = merge_first(left, **options)
                out.append(done)
            if not left and limit is not None and now >= last + expiry_us:
                limit = None
            if limit is not None and row["ts_us"] <= limit:
                out.append({"frame_id": row["frame_id"], "payload_hash": row["payload_hash"], "ts_us": int(row["ts_us"]), "channel": int(row["channel"]), "is_dupe": True, "members": [_member(row)]})
                continue
            at = next((i for i, r in enumerate(left) if row["ts_us"] <= r["ts_us"]), len(left))
            left.insert(at, row)
        return (left, limit, last), out

    return step


def merge_captures(df: DataFrame, hot_rows: int | None = 5_000_000, slice_seconds: float = 3600, **options) -> DataFrame:
    """Transmissions from captures (frame_id, payload_hash, ts_us, sniffer_id, channel, rssi, noise, is_ctrl).

    err_us (0) is the error bound of a time, local_us (ts_us) the time on the
    sniffer's own clock. With arrival_us captures are merged in the order of
    their arrival and late ones become duplicates; else all are at hand, in the
    order of time, sniffer and frame, and there are none.

    A content is cut where no capture before can meet one after, so hot contents
    such as equal acknowledgements are many small groups; the rows of a group are
    streamed, and only half a second of them is held. The cuts of a content with
    more than hot_rows captures are found slice by slice of time, so such a
    content is many tasks. Groups of one capture never reach Python.
    """
    for column, default in (("err_us", F.lit(0)), ("local_us", F.col("ts_us"))):
        if column not in df.columns:
            df = df.withColumn(column, default)
    if "arrival_us" in df.columns:
        return run_keyed(df, ["payload_hash"], ["arrival_us", "frame_id"], arrival_step(**options), MERGED, lambda state: merge_rest(state[0] if state else None, **{k: v for k, v in options.items() if k not in ("timeout_us", "expiry_us")}))
    bound = F.when(F.col("is_ctrl"), F.least("err_us", F.lit(options.get("ctrl_err", 300)))).otherwise(F.greatest("err_us", F.lit(options.get("max_err", 250_000))))
    key, order = ["payload_hash"], ["ts_us", "sniffer_id", "frame_id"]

    def islands(rows: DataFrame, sliced: bool) -> DataFrame:
        length = slice_seconds if sliced else None
        reached = scan(rows, key, order, {"_reached": Scan("max", F.col("ts_us") + bound)}, "ts_us", length)
        lowest = scan(reached, key, order, {"_lowest": Scan("min", F.col("ts_us") - F.col("err_us"), inclusive=True)}, "ts_us", length, reverse=True)
        marked = lowest.withColumn("_new", F.coalesce((F.col("_lowest") > F.col("_reached")).cast("int"), F.lit(1)))
        return scan(marked, key, order, {"_island": Scan("sum", F.col("_new"), inclusive=True)}, "ts_us", length).drop("_reached", "_lowest", "_new")

    found = by_heat(df, key, hot_rows, islands).withColumn("_n", F.count("*").over(Window.partitionBy("payload_hash", "_island")))
    own = F.array(F.struct("sniffer_id", F.col("local_us").alias("ts_us"), "channel", "rssi", "noise"))
    alone = found.filter("_n = 1").select("frame_id", "payload_hash", "ts_us", "channel", F.lit(False).alias("is_dupe"), own.alias("members"))
    many = run_keyed(found.filter("_n > 1").drop("_n"), ["payload_hash", "_island"], order, merge_step(**options), MERGED, lambda left: merge_rest(left, **options))
    return alone.unionByName(many)


def estimate_skew(merged: DataFrame, window: int = 11) -> DataFrame:
    """src, dst, skew_us, spread_us: rolling median of the last skews of each pair of sniffers."""
    from .joins import skew_pairs
    from .windows import rolling_median

    pairs = skew_pairs(merged)
    rolled = rolling_median(pairs, ["src", "dst"], ["frame_id"], "skew_us", window)
    last = rolled.groupBy("src", "dst").agg(F.max_by(F.struct("median", "spread"), "frame_id").alias("v"))
    return last.select("src", "dst", F.col("v.median").alias("skew_us"), F.col("v.spread").alias("spread_us"))


def skew_history(merged: DataFrame, slice_us: int = 60_000_000, window: int = 11) -> DataFrame:
    """slice, src, dst, skew_us, spread_us: what is known of each pair at the start of each time slice.

    A slice knows the rolling median of the last skews before it, so it holds
    until the pair's next sample and one row stands for each slice up to the last
    one of all. merged should be beacons only, as in the older system.
    """
    from .joins import skew_pairs
    from .windows import rolling_median

    slot = F.floor(F.col("ts_us") / slice_us)
    pairs = skew_pairs(merged).join(merged.select("frame_id", "ts_us"), "frame_id")
    rolled = rolling_median(pairs, ["src", "dst"], ["ts_us", "frame_id"], "skew_us", window)
    known = rolled.groupBy("src", "dst", (slot + 1).alias("slice")).agg(F.max_by(F.struct("median", "spread"), F.struct("ts_us", "frame_id")).alias("v"))
    last = merged.agg(F.max(slot)).scalar()
    until = F.coalesce(F.lead("slice").over(Window.partitionBy("src", "dst").orderBy("slice")) - 1, last)
    spans = known.withColumn("until", until).filter("slice <= until")
    return spans.select(F.explode(F.sequence("slice", "until")).alias("slice"), "src", "dst", F.col("v.median").cast("long").alias("skew_us"), F.col("v.spread").cast("long").alias("spread_us"))


def base_sniffer(captures: DataFrame, warmup_us: int = 60_000_000) -> tuple[int | None, int]:
    """(the sniffer with most captures during the warm-up, the end of the warm-up); ties keep the lowest, without warm-up it is the first one's."""
    first = captures.agg(F.min(F.struct("ts_us", "sniffer_id")).alias("m")).first()["m"]
    if first is None:
        return None, 0
    end = first["ts_us"] + warmup_us
    most = captures.filter(F.col("ts_us") < end).groupBy("sniffer_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sniffer_id").first()
    return (most["sniffer_id"] if most else first["sniffer_id"]), end


def apply_skew(captures: DataFrame, skews: DataFrame, default_err: int = 100_000, clamp: tuple[int, int] = (50, 250_000), slice_us: int | None = None, warmup_end: int = 0) -> DataFrame:
    """Captures on the base sniffer's clock: skews hold sniffer_id, skew_us, spread_us, one row a sniffer.

    A sniffer without a path keeps its time and gets the default error. local_us
    is the time on the sniffer's own clock. With slice_us skews have a slice and
    a capture takes those of the slice that it lies in. Captures before the end
    of the warm-up stay as they are, without error.
    """
    keys = ["sniffer_id"] if slice_us is None else ["sniffer_id", "slice"]
    rows = captures.withColumn("local_us", F.col("ts_us"))
    if slice_us is not None:
        rows = rows.withColumn("slice", F.floor(F.col("ts_us") / slice_us))
    joined = rows.join(skews.select(*keys, "skew_us", "spread_us"), keys, "left")
    cold = F.col("ts_us") < warmup_end
    err = F.least(F.greatest(F.coalesce("spread_us", F.lit(default_err)), F.lit(clamp[0])), F.lit(clamp[1]))
    moved = joined.withColumn("err_us", F.when(cold, F.lit(0)).otherwise(err).cast("int")).withColumn("ts_us", F.when(cold, F.col("ts_us")).otherwise(F.col("ts_us") - F.coalesce("skew_us", F.lit(0))))
    return moved.drop("skew_us", "spread_us", "slice")


#: What was captured of a flow: fixed values.
WEB_FLAGS = {"request": 1, "response": 2, "syn": 4, "head": 8, "host": 16, "cookie": 32}


def client_side(packets: DataFrame, web_ports: Sequence[int] = (80,)) -> DataFrame:
    """Packets to or from a web port with the flow seen from its client: client, client_port, server, server_port, is_response."""
    up = F.col("dport").isin(*web_ports)
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    rows = packets.filter(up | F.col("sport").isin(*web_ports))
    return rows.withColumns({"client": pick("src", "dst"), "client_port": pick("sport", "dport"), "server": pick("dst", "src"), "server_port": pick("dport", "sport"), "is_response": ~up})


FLOW = ("client", "client_port", "server", "server_port")


def web_flows(packets: DataFrame, idle_seconds: int = 180, keys: Sequence[str] = FLOW, order: str = "event_id", compat: bool = False) -> DataFrame:
    """One row per flow and idle period: times, sniffer of the first request, first host, longest cookie domain, search terms, flags.

    packets: keys, ts, order, is_response, sniffer_id, host, cookie, term, and
    syn, seq, payload_len of the requests. The head flag says that the segment
    after the SYN was captured. Hosts lose their port; terms are distinct, joined
    in the order in which they came; of equally long cookie domains the first
    stays. compat: a second request sets the response flag, as in the older
    system.
    """
    from .windows import gap_sessions

    s = gap_sessions(packets, list(keys), gap_seconds=idle_seconds, inclusive=True, order=[order])
    period = [*keys, "session"]
    at = F.struct("ts", order)
    request = ~F.col("is_response")
    data = request & (F.col("payload_len") > 0)
    syn_seq = F.min_by(F.when(request & F.col("syn"), F.col("seq")), F.when(request & F.col("syn"), at))
    out = s.groupBy(*period).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("sniffer_id", F.when(request, at)).alias("sniffer_id"),
        F.min_by(F.regexp_extract("host", r"^([^:]*)", 1), F.when(request & F.col("host").isNotNull(), at)).alias("host"),
        F.max_by("cookie", F.when(F.col("is_response") & F.col("cookie").isNotNull(), F.struct(F.length("cookie"), -F.unix_micros("ts"), -F.col(order)))).alias("cookie"),
        F.count_if(request).alias("_requests"), F.count_if(F.col("is_response")).alias("_responses"), syn_seq.alias("_syn"),
    )
    # the data segments that may follow the SYN
    heads = s.filter(data).select(*period, F.col("seq").alias("_next")).distinct()
    heads = out.filter("_syn is not null").select(*period, (F.col("_syn") + 1).alias("_next")).join(heads, [*period, "_next"], "left_semi").select(*period, F.lit(True).alias("_head"))
    terms = s.filter(request & F.col("term").isNotNull()).groupBy(*period, "term").agg(F.min(at).alias("at"))
    terms = terms.groupBy(*period).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]), "&").alias("terms"))
    flag = lambda name, test: F.when(test, WEB_FLAGS[name]).otherwise(0)
    answered = (F.col("_responses") > 0) | (F.col("_requests") > 1) if compat else F.col("_responses") > 0
    flags = flag("request", F.col("_requests") > 0) + flag("response", answered) + flag("syn", F.col("_syn").isNotNull()) + flag("head", F.coalesce("_head", F.lit(False))) + flag("host", F.col("host").isNotNull()) + flag("cookie", F.col("cookie").isNotNull())
    rows = out.join(heads, period, "left").join(terms, period, "left")
    return rows.select(*period, "first_ts", "last_ts", "sniffer_id", "host", "cookie", F.coalesce("terms", F.lit("")).alias("terms"), flags.alias("flags"))
