"""Networks (BSSIDs) as their beacons and probe responses describe them: rejects, change events and latest state.

Batch form: what a network last said is a running value of segmented scans, so a
hot network is many slices of time. Stream form: `network_step` on keyed state.
Both give the same events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Scan, scan
from .state import Step

BROADCAST = "ff:ff:ff:ff:ff:ff"
#: Columns that descriptions may lack, and their types.
DEFAULTS = {"ta": "string", "ibss": "boolean", "group_cipher": "int", "cipher_bits": "int", "bcn_int": "int", "adv_channel": "int"}
EVENTS = "bssid string, ts timestamp, frame_id long, event string, old string, new string, changed boolean, odd boolean"


def descriptions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that describe a network, rejected rows): no BSSID or the broadcast one, no name element, no beacon interval.

    A name of NUL characters is a hidden one and counts as empty. A probe response
    from another address than its BSSID, outside an IBSS, is `suspicious`.
    """
    rows = df.withColumns({c: F.lit(None).cast(t) for c, t in DEFAULTS.items() if c not in df.columns})
    text = F.col("bssid").cast("string")
    bad = text.isNull() | (text == BROADCAST) | F.col("ssid").isNull() | (F.col("bcn_int").isNull() if "bcn_int" in df.columns else F.lit(False))
    ibss = F.coalesce("ibss", F.lit(False))
    foreign = F.col("ta").isNotNull() & (F.col("ta").cast("string") != text)
    rows = rows.withColumns({"ssid": F.when(F.translate("ssid", "\0", "") == "", "").otherwise(F.col("ssid")), "ibss": ibss, "suspicious": ~F.col("is_beacon") & foreign & ~ibss})
    return rows.filter(~bad), df.filter(bad)


def _accepted(df: DataFrame, order: Sequence[str], slice_seconds: float | None) -> DataFrame:
    """Rows that tell something: the first of a network, and all later ones but the suspicious; `first` marks the former."""
    us = F.unix_micros("ts")
    rows = scan(df, ["bssid"], order, {"_any": Scan("last", F.lit(1))}, us, slice_seconds).withColumn("first", F.col("_any").isNull()).drop("_any")
    return rows.filter(F.col("first") | ~F.col("suspicious"))


def _event(name: str, happens: Column, old: Column, new: Column, changed: Column, odd: Column) -> Column:
    text = lambda c: c.cast("string")
    return F.when(happens, F.struct(F.lit(name).alias("event"), text(old).alias("old"), text(new).alias("new"), changed.alias("changed"), odd.alias("odd")))


def network_events(df: DataFrame, order: Sequence[str] = ("ts", "frame_id"), reveal: bool = False, slice_seconds: float | None = None) -> DataFrame:
    """bssid, ts, frame_id, event, old, new, changed, odd: what a row changes in the known state of its network.

    df: frame_id, ts, bssid, ssid, is_beacon and, if there, ta, ibss, bcn_int,
    adv_channel, cipher_bits, group_cipher. Events, in this order for one row:
    new; renamed; ibss; named_in_beacon (the first beacon with a name); channel
    (one not advertised before, under 32); interval; ciphers (new bits); group.
    changed events are to be passed on, odd ones looked at: a role or interval
    that changes, the first renaming, ciphers or a group cipher where others were
    known. Suspicious rows may only create a network. Rows of an IBSS, which has
    several senders, change no channel, interval or cipher. A hidden network never
    gains a name unless reveal is set (event named).
    """
    rows = _accepted(descriptions(df)[0], order, slice_seconds)
    us, key = F.unix_micros("ts"), ["bssid"]
    name = F.when(F.col("ssid") != "", F.col("ssid"))
    told = F.col("first") | ~F.col("ibss")
    group = F.when(F.coalesce("group_cipher", F.lit(0)) != 0, F.col("group_cipher"))
    bits = F.coalesce("cipher_bits", F.lit(0))
    channel = F.when((F.col("adv_channel") > 0) & (F.col("adv_channel") < 32), F.col("adv_channel"))
    rows = scan(
        rows.withColumn("_channel", channel), key, order,
        {
            "_hidden": Scan("first", F.when(F.col("first"), F.col("ssid") == "")), "_name": Scan("last", name), "_role": Scan("last", F.col("ibss")),
            "_shown": Scan("max", (name.isNotNull() & F.col("is_beacon")).cast("int")), "_interval": Scan("last", F.when(told, F.col("bcn_int"))),
            "_bits": Scan("or", F.when(told, bits)), "_group": Scan("last", F.when(told, group)), "_seen": Scan("first", F.when(told, F.lit(1)), ("_channel",)),
        },
        us, slice_seconds,
    )
    later, yes, no = ~F.col("first"), F.lit(True), F.lit(False)
    nameless = F.col("_hidden") & F.lit(not reveal)
    renamed = later & name.isNotNull() & F.col("_name").isNotNull() & (name != F.col("_name")) & ~nameless
    rows = scan(rows.withColumn("_renamed", renamed), key, order, {"_before": Scan("max", F.when(renamed, 1))}, us, slice_seconds)
    open_ = later & ~F.col("ibss")
    fresh = bits.bitwiseAND(F.bitwise_not(F.coalesce("_bits", F.lit(0)))) != 0
    events = F.array_compact(
        F.array(
            _event("new", F.col("first"), F.lit(None), F.col("ssid"), yes, no),
            _event("named", later & name.isNotNull() & F.col("_name").isNull() & F.lit(reveal), F.lit(""), name, yes, no),
            _event("renamed", F.col("_renamed"), F.col("_name"), name, yes, F.col("_before").isNull()),
            _event("ibss", later & (F.col("ibss") != F.col("_role")), F.col("_role"), F.col("ibss"), no, yes),
            _event("named_in_beacon", later & name.isNotNull() & F.col("is_beacon") & (F.col("_shown") == 0), F.lit(None), name, yes, no),
            _event("channel", open_ & F.col("_channel").isNotNull() & F.col("_seen").isNull(), F.lit(None), F.col("_channel"), yes, no),
            _event("interval", open_ & (F.col("bcn_int") != F.col("_interval")), F.col("_interval"), F.col("bcn_int"), no, yes),
            _event("ciphers", open_ & fresh, F.col("_bits"), bits.bitwiseOR(F.coalesce("_bits", F.lit(0))), yes, F.col("_bits") != 0),
            _event("group", open_ & group.isNotNull() & (F.col("_group").isNull() | (group != F.col("_group"))), F.col("_group"), group, yes, F.col("_group").isNotNull()),
        )
    )
    return rows.select("bssid", "ts", "frame_id", F.explode(events).alias("e")).select("bssid", "ts", "frame_id", "e.*")


def network_state(df: DataFrame, order: Sequence[str] = ("ts", "frame_id"), reveal: bool = False, slice_seconds: float | None = None) -> DataFrame:
    """bssid, ssid, renamed, ssid_in_beacons, channels (bit mask), bcn_int, ibss, ciphers, group_cipher, last_updated after all rows."""
    rows = _accepted(descriptions(df)[0], order, slice_seconds)
    at = F.struct(*order)
    told = F.col("first") | ~F.col("ibss")
    latest = lambda c, where: F.max_by(c, F.when(where, at))
    name = latest(F.col("ssid"), F.col("ssid") != "")
    hidden = F.max(F.col("first") & (F.col("ssid") == "")) & F.lit(not reveal)
    channel = (F.col("adv_channel") > 0) & (F.col("adv_channel") < 32)
    # while a network keeps one name, it was never renamed
    names = F.countDistinct(F.when(F.col("ssid") != "", F.col("ssid")))
    return rows.groupBy("bssid").agg(
        F.when(hidden, "").otherwise(F.coalesce(name, F.lit(""))).alias("ssid"), (~hidden & (names > 1)).alias("renamed"), F.max(F.col("is_beacon") & (F.col("ssid") != "")).alias("ssid_in_beacons"),
        F.coalesce(F.bit_or(F.when(told & channel, F.call_function("shiftleft", F.lit(1), F.col("adv_channel") - 1))), F.lit(0)).alias("channels"), latest(F.col("bcn_int"), told & F.col("bcn_int").isNotNull()).alias("bcn_int"),
        latest(F.col("ibss"), F.lit(True)).alias("ibss"), F.coalesce(F.bit_or(F.when(told, F.col("cipher_bits"))), F.lit(0)).alias("ciphers"),
        F.coalesce(latest(F.col("group_cipher"), told & (F.coalesce("group_cipher", F.lit(0)) != 0)), F.lit(0)).alias("group_cipher"), F.max("ts").alias("last_updated"),
    )


def network_step(reveal: bool = False) -> Step:
    """The stream form of network_events, on rows of `descriptions`; the state of a network is what is known of it.

    `known_network` makes such a state from a row of network_state, so a stream
    can begin with what an earlier run knew.
    """

    def step(state: dict | None, rows: list[dict]) -> tuple[dict, list[dict]]:
        out = []
        for row in rows:
            if state is not None and row["suspicious"]:
                continue

            def emit(event, old, new, changed, odd, row=row):
                say = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
                out.append({"bssid": row["bssid"], "ts": row["ts"], "frame_id": row["frame_id"], "event": event, "old": say(old), "new": say(new), "changed": changed, "odd": odd})

            name, ibss, shown = row["ssid"], bool(row["ibss"]), bool(row["ssid"] and row["is_beacon"])
            channel, interval, bits, group = row.get("adv_channel"), row.get("bcn_int"), row.get("cipher_bits") or 0, row.get("group_cipher") or 0
            mask = 1 << int(channel) - 1 if channel and 0 < channel < 32 else 0
            if state is None:
                state = {"name": name, "hidden": not name and not reveal, "renamed": False, "ibss": ibss, "shown": shown, "channels": mask, "interval": interval, "bits": int(bits), "group": int(group)}
                emit("new", None, name, True, False)
                continue
            if name and not state["hidden"] and name != state["name"]:
                if state["name"]:
                    emit("renamed", state["name"], name, True, not state["renamed"])
                    state["renamed"] = True
                else:
                    emit("named", "", name, True, False)
                state["name"] = name
            if ibss != state["ibss"]:
                emit("ibss", state["ibss"], ibss, False, True)
                state["ibss"] = ibss
            if shown and not state["shown"]:
                emit("named_in_beacon", None, name, True, False)
                state["shown"] = True
            if ibss:
                continue
            if mask & ~state["channels"]:
                emit("channel", None, int(channel), True, False)
                state["channels"] |= mask
            if interval is not None and interval != state["interval"]:
                if state["interval"] is not None:
                    emit("interval", int(state["interval"]), int(interval), False, True)
                state["interval"] = interval
            if bits & ~state["bits"]:
                emit("ciphers", state["bits"], int(bits) | state["bits"], True, state["bits"] != 0)
                state["bits"] |= int(bits)
            if group and group != state["group"]:
                emit("group", state["group"] or None, int(group), True, state["group"] != 0)
                state["group"] = int(group)
        return state, out

    return step


def known_network(row: dict, reveal: bool = False) -> dict:
    """The state of network_step from a row of network_state."""
    return {"name": row["ssid"], "hidden": not row["ssid"] and not reveal, "renamed": bool(row["renamed"]), "ibss": bool(row["ibss"]), "shown": bool(row["ssid_in_beacons"]), "channels": int(row["channels"]), "interval": row["bcn_int"], "bits": int(row["ciphers"]), "group": int(row["group_cipher"])}
