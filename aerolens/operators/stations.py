"""What each transmitter sent: frames as captured and as their sequence numbers tell, by interval.

A station numbers its frames with one counter for each (receiver, traffic class)
of its QoS data frames and one for all others. Some stations number QoS frames
with the common counter, too; frames vote on that until a station is decided.

Batch form: running values of segmented scans, all built-in functions, so a hot
station is many slices of time. Stream form: `inference_step` on keyed state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import Scan, scan
from .state import Step
from .windows import SMALL_NUMBER, advance

#: Votes that decide that a station keeps QoS counters (below) or the common one only (above): fixed values.
KEEPS_QOS, ONE_COUNTER = -16, 256

#: Columns that captures may lack, and what stands for them then.
DEFAULTS = {"ra": "string", "tid": "int", "protected": "boolean", "dir": "int", "ethertype": "int", "bcn_int": "int", "ibss": "boolean"}


def with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in DEFAULTS.items() if c not in df.columns})


def _bit(column: str, bits: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(bits))


def _group_address(column: str) -> Column:
    """Whether an address text is a multicast or broadcast one; other keys are not."""
    return F.coalesce(F.conv(F.substring(F.col(column).cast("string"), 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1, F.lit(False)) & F.col(column).cast("string").contains(":")


def lives(df: DataFrame, key: str, interval_us: int) -> DataFrame:
    """Adds `life`, the interval since which a key was heard in every interval: one not heard for a whole interval begins anew."""
    slot = F.floor(F.unix_micros("ts") / interval_us)
    heard = df.select(key, slot.alias("_slot")).distinct()
    w = Window.partitionBy(key).orderBy("_slot")
    fresh = F.when(F.coalesce(F.col("_slot") - F.lag("_slot").over(w) > 1, F.lit(True)), F.col("_slot"))
    spans = heard.withColumn("_fresh", fresh).withColumn("life", F.max("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
    return df.withColumn("_slot", slot).join(spans, [key, "_slot"]).drop("_slot")


def inferred_frames(df: DataFrame, key: str = "ta", interval: int = 300, order: Sequence[str] = ("ts", "frame_id"), slice_seconds: float | None = 3600) -> DataFrame:
    """Adds `inferred`: frames that each frame's number says were sent since the one before it, at least 1; 0 for control frames.

    QoS data frames to one receiver count by receiver and traffic class (tid);
    their null frames count 1 and may or may not take a number, whichever gives
    the smaller step. A change of class may restart at 0. Where the step of the
    common counter is small and that of the QoS counter is not, the frame counts
    by the common one and votes for a station without QoS counters, the other way
    round against; at 256 for or 16 against the station is decided. Frames by the
    common counter are the only ones that it knows. A station not heard for a
    whole interval (seconds) is forgotten. Needs ftype, fsubtype, retry, seq;
    without ra and tid there are no QoS counters.
    """
    rows = lives(with_defaults(df).filter(F.col(key).isNotNull()), key, interval * 1_000_000)
    names = [*df.columns, "life"]
    seq, numbered = F.col("seq"), F.col("ftype") != 1
    qos = (F.col("ftype") == 2) & (_bit("fsubtype", 8) != 0) & F.col("ra").isNotNull() & F.col("tid").isNotNull() & ~_group_address("ra")
    null = qos & (_bit("fsubtype", 4) != 0)
    rows = rows.withColumns({"_n": F.coalesce(numbered, F.lit(False)), "_qos": F.coalesce(qos, F.lit(False)), "_null": F.coalesce(null, F.lit(False))})
    us, keys = F.unix_micros("ts"), [key, "life"]
    carries = F.col("_qos") & ~F.col("_null")
    before = {
        "_any": Scan("last", F.when(F.col("_n"), seq)),
        "_class": Scan("last", F.when(carries, seq), ("ra", "tid")),
        "_class_null": Scan("last", F.when(F.col("_qos"), seq), ("ra", "tid")),
        "_tid": Scan("last", F.when(carries, F.col("tid")), ("ra",)),
    }
    rows = scan(rows, keys, order, before, us, slice_seconds)
    step = lambda last: advance(F.col(last), seq, F.col("retry"))
    by_class = F.when(F.col("_class").isNull(), step("_class")).otherwise(F.least(step("_class"), step("_class_null")))
    restarts = F.col("_tid").isNotNull() & (F.col("_tid") != F.col("tid")) & (seq < SMALL_NUMBER)
    rows = rows.withColumns({"_common": step("_any"), "_by_class": F.when(restarts, F.least(by_class, seq + 1)).otherwise(by_class)})
    near, far = (lambda c: F.col(c) < SMALL_NUMBER), (lambda c: F.col(c) >= SMALL_NUMBER)
    vote = F.when(carries, F.when(far("_by_class") & near("_common"), 1).when(near("_by_class") & far("_common"), -1))
    rows = scan(rows.withColumn("_vote", vote), keys, order, {"_votes": Scan("sum", F.col("_vote"), inclusive=True)}, us, slice_seconds)
    decided = F.when(F.col("_votes") <= KEEPS_QOS, False).when(F.col("_votes") >= ONE_COUNTER, True)
    rows = scan(rows, keys, order, {"_decided": Scan("first", decided)}, us, slice_seconds)
    common = carries & F.coalesce("_decided", F.coalesce(F.col("_vote") == 1, F.lit(False)))
    plain = F.col("_n") & (~F.col("_qos") | common)
    rows = scan(rows.withColumn("_by_common", common), keys, order, {"_base": Scan("last", F.when(plain, seq))}, us, slice_seconds)
    gap = F.when(F.col("_null"), 1).when(F.col("_by_common"), F.col("_common")).when(F.col("_qos"), F.col("_by_class")).otherwise(step("_base"))
    return rows.withColumn("inferred", F.when(F.col("_n"), F.greatest(gap, F.lit(1))).otherwise(0)).select(*names, "inferred")


INFERENCE = "frame_id long, ta string, ts timestamp, inferred int"


def inference_step(interval_us: int = 300_000_000, key: str = "ta") -> Step:
    """The stream form of inferred_frames: one row a frame; the state of a station is its counters, votes and last interval.

    Rows hold what inferred_frames needs, ts_us besides; a control frame gives 0.
    """

    def advanced(last: int | None, seq: int, retry: bool) -> int:
        if last is None:
            return seq if seq < SMALL_NUMBER else 1
        if last <= seq:
            return seq - last
        return 0 if last - seq < 3 and retry else seq + 4096 - last

    def number(state: dict, row: dict) -> int:
        if row["ftype"] == 1:
            return 0
        seq, retry, ra, tid = int(row["seq"]), bool(row["retry"]), row.get("ra"), row.get("tid")
        qos = row["ftype"] == 2 and row["fsubtype"] & 8 and ra is not None and tid is not None and not (":" in str(ra) and int(str(ra)[:2], 16) & 1)
        common = advanced(state["any"], seq, retry)
        state["any"] = seq
        if qos:
            to = state["to"].setdefault(ra, {"tid": None, "data": {}, "all": {}})
            if row["fsubtype"] & 4:
                to["all"][tid] = seq
                return 1
            gap = advanced(to["data"].get(tid), seq, retry)
            if tid in to["data"]:
                gap = min(gap, advanced(to["all"][tid], seq, retry))
            if to["tid"] not in (None, tid) and seq < SMALL_NUMBER:
                gap = min(gap, seq + 1)
            to["tid"], to["data"][tid], to["all"][tid] = tid, seq, seq
            by_common = state["votes"] >= ONE_COUNTER
            if KEEPS_QOS < state["votes"] < ONE_COUNTER:
                by_common = gap >= SMALL_NUMBER > common
                state["votes"] += by_common - (gap < SMALL_NUMBER <= common)
            if not by_common:
                return max(gap, 1)
            state["base"] = seq
            return max(common, 1)
        gap = advanced(state["base"], seq, retry)
        state["base"] = seq
        return max(gap, 1)

    def step(state: dict | None, rows: list[dict]) -> tuple[dict, list[dict]]:
        out = []
        for row in rows:
            slot = int(row["ts_us"]) // interval_us
            if state is None or slot - state["slot"] > 1:
                state = {"any": None, "base": None, "votes": 0, "to": {}}
            state["slot"] = slot
            out.append({"frame_id": row["frame_id"], key: row[key], "ts": row["ts"], "inferred": number(state, row)})
        return state, out

    return step


def station_stats(df: DataFrame, interval: int = 300, key: str = "ta", order: Sequence[str] = ("ts", "frame_id"), slice_seconds: float | None = 3600) -> DataFrame:
    """start, key, packets, bytes, non_ctrl_packets, inferred_packets, data_bytes, encrypt_data_bytes, layer3_bytes, beacons, inferred_beacons, flags.

    One row a transmitter and interval (seconds). Data frames are those that
    carry data; unprotected ones with an ethertype have layer 3 bytes after their
    header and that of LLC. Beacons sent are inferred from the beacon interval (of
    1024 us), if a single one was seen. flags: client 1, access point 2, IBSS 4,
    by the direction of data frames; beacons are an access point's, or an IBSS
    member's besides, if their capability says so. Rows without transmitter,
    frames without the optional columns and null values add nothing.
    """
    rows = inferred_frames(with_defaults(df), key, interval, order, slice_seconds)
    data = (F.col("ftype") == 2) & (_bit("fsubtype", 4) == 0)
    beacon = (F.col("ftype") == 0) & (F.col("fsubtype") == 8)
    header = 24 + F.when(F.col("dir") == 3, 6).otherwise(0) + F.when(_bit("fsubtype", 8) != 0, 2).otherwise(0)
    packet = F.col("length") - header - 6
    layer3 = F.when(data & ~F.coalesce("protected", F.lit(False)) & F.col("ethertype").isNotNull() & (packet > 0), packet)
    role = F.when(data, F.when(F.col("dir") == 1, 1).when(F.col("dir") == 2, 2).when(F.col("dir") == 0, 4)).when(beacon, F.lit(2) + F.when(F.coalesce("ibss", F.lit(False)), 4).otherwise(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    interval_seen = F.when(beacon & (F.col("bcn_int") > 0), F.col("bcn_int"))
    one = F.when(F.min(interval_seen) == F.max(interval_seen), F.max(interval_seen))
    sent = F.coalesce(F.floor(F.lit(interval * 1_000_000) / (1024 * one)), F.lit(0)).cast("long")
    slot = F.timestamp_micros(F.floor(F.unix_micros("ts") / (interval * 1_000_000)) * (interval * 1_000_000)).alias("start")
    return rows.groupBy(slot, key).agg(
        F.count("*").alias("packets"), total("length").alias("bytes"), F.count_if(F.col("ftype") != 1).alias("non_ctrl_packets"), total("inferred").alias("inferred_packets"),
        total(F.when(data, F.col("length"))).alias("data_bytes"), total(F.when(data & F.col("protected"), F.col("length"))).alias("encrypt_data_bytes"), total(layer3).alias("layer3_bytes"),
        F.count_if(beacon).alias("beacons"), sent.alias("inferred_beacons"), F.coalesce(F.bit_or(role), F.lit(0)).cast("int").alias("flags"),
    )
