"""Window-function work: gaps, sessions, rolling statistics, dwell and shares."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import Scan, scan


#: A number below this may be the first of a counter that began at 0; steps below it are small (fixed value).
SMALL_NUMBER = 8


def advance(last: Column, seq: Column, retry: Column, modulus: int = 4096, small: int = SMALL_NUMBER, slip: int = 3) -> Column:
    """Steps of a wrapping counter from its last number; a small step back of a retry is none.

    Without a last number it is the number itself if that is small, else 1.
    """
    first = F.when(seq < small, seq).otherwise(1)
    back = F.when((last - seq < slip) & retry, F.lit(0)).otherwise(seq + modulus - last)
    return F.when(last.isNull(), first).when(last <= seq, seq - last).otherwise(back)


def sequence_gaps(df: DataFrame, key: str = "ta", order: Sequence[str] = ("ts", "frame_id"), seq: str = "seq", retry: str = "retry", modulus: int = 4096, small: int = SMALL_NUMBER, slip: int = 3, slice_seconds: float | None = None) -> DataFrame:
    """Adds `gap`: frames that the sequence number says were sent since the last one of the key, this one included.

    A step back of less than `slip` on a retry is 0; any other step back wraps.
    The first frame counts its number if that is under `small`, else 1. Control
    frames (ftype 1, if there is such a column) and rows without number have no
    gap and are passed over.
    """
    numbered = F.col(seq) if "ftype" not in df.columns else F.when(F.coalesce(F.col("ftype") != 1, F.lit(True)), F.col(seq))
    rows = scan(df.withColumn("_seq", numbered), [key], order, {"_last": Scan("last", F.col("_seq"))}, F.unix_micros(order[0]), slice_seconds)
    gap = F.when(F.col("_seq").isNotNull(), advance(F.col("_last"), F.col("_seq"), F.col(retry), modulus, small, slip))
    return rows.withColumn("gap", gap).drop("_seq", "_last")


def inferred_packets(df: DataFrame, key: str = "ta", **options) -> DataFrame:
    """Numbered frames of each key as captured, and as its sequence numbers tell; a gap of 0 still counts the captured frame."""
    return sequence_gaps(df, key, **options).groupBy(key).agg(F.count("gap").alias("captured"), F.coalesce(F.sum(F.when(F.col("gap").isNotNull(), F.greatest("gap", F.lit(1)))).cast("long"), F.lit(0)).alias("inferred"))


def ping_loss(df: DataFrame, source: str = "source", order: Sequence[str] = ("ts", "event_id"), seq: str = "seq", delay: str | None = None, slice_seconds: float | None = None) -> DataFrame:
    """received, dropped, duplicates per source; with a delay column also its weighted mean over the pings received.

    Number 0 restarts the count; a number not above the highest since then is a
    duplicate or late. The very first row of a source adds its own number as
    drops. With slice_seconds the first of order is a time and a hot source is
    counted slice by slice of it.
    """
    us = F.unix_micros(order[0]) if slice_seconds is not None else F.lit(0)
    runs = scan(df, [source], order, {"_run": Scan("sum", (F.col(seq) == 0).cast("int"), inclusive=True), "_any": Scan("last", F.lit(1))}, us, slice_seconds)
    gaps = scan(runs, [source], order, {"_high": Scan("max", F.col(seq), ("_run",))}, us, slice_seconds)
    first = F.col("_any").isNull()
    fresh = F.col("_high").isNull() | (F.col(seq) > F.col("_high"))
    lost = F.when(first, F.col(seq)).when(F.col(seq) == 0, F.lit(0)).when(fresh, F.col(seq) - F.coalesce("_high", F.col(seq)) - F.when(F.col("_high").isNull(), 0).otherwise(1)).otherwise(0)
    marked = gaps.withColumn("_fresh", fresh).withColumn("_lost", lost)
    counts = marked.groupBy(source).agg(F.count_if("_fresh").alias("received"), F.sum("_lost").cast("long").alias("dropped"), F.count_if(~F.col("_fresh")).alias("duplicates"))
    if delay is None:
        return counts
    from .state import keyed_ewma

    return counts.join(keyed_ewma(marked.filter("_fresh"), [source], list(order), delay).withColumnRenamed("ewma", "avg_delay"), source, "left")


def gap_sessions(df: DataFrame, keys: Sequence[str], ts: str = "ts", gap_seconds: float = 1200, inclusive: bool = True, order: Sequence[str] = (), slice_seconds: float | None = None) -> DataFrame:
    """Adds `session` (from 1): rows at most the gap after the previous one of their key belong together.

    With slice_seconds a key is cut into slices of time (see scan), so that a hot
    key is many sorted runs.
    """
    limit = int(gap_seconds * 1_000_000)
    us, along = F.unix_micros(ts), [ts, *order]
    rows = scan(df, keys, along, {"_last": Scan("last", us)}, us, slice_seconds)
    pause = us - F.col("_last")
    new = F.when(pause.isNull(), 1).otherwise((pause > limit if inclusive else pause >= limit).cast("int"))
    return scan(rows.withColumn("_new", new), keys, along, {"session": Scan("sum", F.col("_new"), inclusive=True)}, us, slice_seconds).drop("_new", "_last")


def session_summary(df: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """first_ts, last_ts and requests of each session."""
    return gap_sessions(df, keys, **options).groupBy(*keys, "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("requests"))


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int, slice_seconds: float) -> tuple[DataFrame, list[str]]:
    """(rows of every slice of time and, with _own false, the last `back` rows before it, the columns that make a run).

    The first of order is a time. Slices hand their last rows on to those after
    them, past sparse ones, until these have enough.
    """
    run = [*keys, "_slice"]
    rows = df.withColumn("_slice", F.floor(F.unix_micros(order[0]) / int(slice_seconds * 1_000_000))).withColumn("_own", F.lit(True))
    last = F.row_number().over(Window.partitionBy(*run).orderBy(*(F.col(c).desc() for c in order)))
    tail = rows.withColumn("_n", last).filter(F.col("_n") <= back)
    sizes = rows.groupBy(*run).agg(F.count("*").alias("_size"))
    ahead = Window.partitionBy(*keys).orderBy("_slice")
    spread = sizes.withColumn("_after", F.collect_list(F.struct("_slice", "_size")).over(ahead.rowsBetween(1, max(1, back))))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<to:bigint,held:bigint>>").alias("to"))
    walk = F.aggregate("_after", start, lambda a, x: F.when(a["held"] < back, F.struct((a["held"] + x["_size"]).alias("held"), F.concat(a["to"], F.array(F.struct(x["_slice"].alias("to"), a["held"].alias("held")))).alias("to"))).otherwise(a))
    targets = spread.select(*run, F.explode(walk["to"]).alias("t")).select(*run, "t.to", "t.held")
    handed = tail.join(targets, run).filter(F.col("_n") + F.col("held") <= back).withColumn("_slice", F.col("to")).withColumn("_own", F.lit(False)).drop("to", "held", "_n")
    return rows.unionByName(handed.select(*rows.columns)), run


def rolling_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int = 11, slice_seconds: float | None = None) -> DataFrame:
    """Adds `median` (element n div 2 of the sorted last values) and `spread` (largest less smallest).

    With slice_seconds a key is cut into slices of time, each with the rows before
    it that its first windows look back to (see with_halo).
    """
    both, run = (df, list(keys)) if slice_seconds is None else with_halo(df, keys, order, window - 1, slice_seconds)
    w = Window.partitionBy(*run).orderBy(*order).rowsBetween(1 - window, 0)
    values = F.sort_array(F.collect_list(value).over(w))
    out = both.withColumn("_v", values).withColumn("median", F.get("_v", (F.size("_v") / 2).cast("int"))).withColumn("spread", F.array_max("_v") - F.array_min("_v")).drop("_v")
    return out if slice_seconds is None else out.filter("_own").drop("_own", "_slice")


def with_neighbour(df: DataFrame, keys: Sequence[str], ts: str = "ts", order: Sequence[str] = (), slice_seconds: float | None = None, after: bool = False) -> DataFrame:
    """Adds _beside, the time of the row before (or after) in its key.

    With slice_seconds a key is cut into slices of time, so that a hot key is
    many sorted runs: only the first (or last) row of a slice looks into the
    slice beside it, which one row a slice tells.
    """
    step = F.lead if after else F.lag
    if slice_seconds is None:
        return df.withColumn("_beside", step(ts).over(Window.partitionBy(*keys).orderBy(ts, *order)))
    run = [*keys, "_slice"]
    rows = df.withColumn("_slice", F.floor(F.unix_micros(ts) / int(slice_seconds * 1_000_000)))
    edge = (F.min if after else F.max)(ts)
    slices = rows.groupBy(*run).agg(edge.alias("_edge")).withColumn("_edge", step("_edge").over(Window.partitionBy(*keys).orderBy("_slice")))
    inside = step(ts).over(Window.partitionBy(*run).orderBy(ts, *order))
    # null keys meet as well
    other = slices.select(*(F.col(k).alias(f"_k_{k}") for k in run), "_edge")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in run])
    return rows.withColumn("_inside", inside).join(other, same, "left").withColumn("_beside", F.coalesce("_inside", "_edge")).select(*df.columns, "_beside")


def report_duration(df: DataFrame, keys: Sequence[str], ts: str = "ts", order: Sequence[str] = (), default_seconds: float = 10, slice_seconds: float | None = None) -> DataFrame:
    """Adds `duration_msec`: time since the key's previous report, the default for the first."""
    rows = with_neighbour(df, keys, ts, order, slice_seconds)
    return rows.withColumn("duration_msec", F.coalesce(((F.unix_micros(ts) - F.unix_micros("_beside")) / 1000).cast("long"), F.lit(int(default_seconds * 1000)))).drop("_beside")


def moving_averages(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, spans: Sequence[int] = (1, 10, 60), slice_seconds: float | None = None) -> DataFrame:
    """Adds avg_<n>, the mean of the last n rows, for each span.

    With slice_seconds the first of order is a time and a key is cut into slices
    of it, each with the rows before it that the longest span looks back to.
    """
    both, run = (df, list(keys)) if slice_seconds is None else with_halo(df, keys, order, max(spans) - 1, slice_seconds)
    w = Window.partitionBy(*run).orderBy(*order)
    out = both.withColumns({f"avg_{n}": F.avg(value).over(w.rowsBetween(1 - n, 0)) for n in spans})
    return out if slice_seconds is None else out.filter("_own").drop("_own", "_slice")


def ewma(values: Column, shift: int = 4) -> Column:
    """Exponentially weighted mean of an ordered array: each step moves 1 / 2^shift of the way; starts at the first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)).cast("double"), lambda m, x: m + (x - m) / (1 << shift))


def fidelity(df: DataFrame, ap: str = "bssid", sniffer: str = "sniffer_id", ts: str = "ts", bcn_int_us: int = 102_400, interval_seconds: int = 300, ewma_shift: int = 4, threshold: float | None = None) -> DataFrame:
    """Share of an access point's beacons that a sniffer captures, at most 1, smoothed over its intervals."""
    slot = F.floor(F.unix_micros(ts) / (interval_seconds * 1_000_000)).alias("slot")
    share = F.least(F.lit(1.0), F.count("*") / F.lit(interval_seconds * 1_000_000 / bcn_int_us))
    slots = df.groupBy(ap, sniffer, slot).agg(share.alias("share"))
    out = slots.groupBy(ap, sniffer).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "share"))), lambda x: x["share"]).alias("v"))
    out = out.select(ap, sniffer, ewma(F.col("v"), ewma_shift).alias("fidelity"))
    return out if threshold is None else out.filter(F.col("fidelity") >= threshold)


def channel_dwell(changes: DataFrame, sniffer: str = "sniffer_id", ts: str = "ts", order: Sequence[str] = (), slice_seconds: float | None = None) -> DataFrame:
    """Seconds that each sniffer spent on each channel between its changes."""
    rows = with_neighbour(changes, [sniffer], ts, order, slice_seconds, after=True)
    return rows.withColumn("_us", F.unix_micros("_beside") - F.unix_micros(ts)).filter("_us is not null").groupBy(sniffer, "channel").agg((F.sum("_us") / 1e6).alias("dwell_sec"))


def channel_shares(rates: DataFrame, sniffer: str = "sniffer_id", period: float = 1.0, minimum: float = 0.02) -> DataFrame:
    """A period shared among channels by rate, none under the minimum; a sniffer without any rate keeps equal shares.

    Channels are taken by ascending rate: each gets its part of what is left, but
    the minimum at least, so later ones give way. A sniffer has a dozen channels.
    """
    rows = F.sort_array(F.collect_list(F.struct("rate", "channel")))
    total = F.sum("rate")
    grouped = rates.groupBy(sniffer).agg(rows.alias("r"), total.alias("total"))
    start = F.struct(F.lit(float(period)).alias("left"), F.col("total").cast("double").alias("rates"), F.array().cast("array<struct<channel:int,share:double>>").alias("out"))

    def take(acc: Column, x: Column) -> Column:
        share = F.greatest(F.lit(minimum * period), F.when(acc["rates"] > 0, acc["left"] * x["rate"] / acc["rates"]).otherwise(F.lit(0.0)))
        entry = F.struct(x["channel"].cast("int").alias("channel"), share.alias("share"))
        return F.struct((acc["left"] - share).alias("left"), (acc["rates"] - x["rate"]).alias("rates"), F.concat(acc["out"], F.array(entry)).alias("out"))

    shares = F.when(F.col("total") > 0, F.aggregate("r", start, take)["out"]).otherwise(F.transform("r", lambda x: F.struct(x["channel"].cast("int").alias("channel"), (F.lit(float(period)) / F.size("r")).alias("share"))))
    return grouped.select(sniffer, F.explode(shares).alias("s")).select(sniffer, "s.*")


def coverage_ranges(df: DataFrame, flow: str = "flow", start: str = "start", length: str = "length", slice_length: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(captured ranges of each flow, touching ones merged; covered bytes, span and share per flow).

    With slice_length a flow is cut into slices of so many bytes by where its
    ranges start, so that a hot flow is many sorted runs (see scan).
    """
    rows = df.filter(F.col(length) > 0).withColumn("_end", F.col(start) + F.col(length))
    along, at, slices = [start, "_end"], F.col(start) * 1_000_000, slice_length
    rows = scan(rows, [flow], along, {"_high": Scan("max", F.col("_end"))}, at, slices)
    gap = F.when(F.col("_high").isNull() | (F.col(start) > F.col("_high")), 1).otherwise(0)
    marked = scan(rows.withColumn("_gap", gap), [flow], along, {"_island": Scan("sum", F.col("_gap"), inclusive=True)}, at, slices)
    ranges = marked.groupBy(flow, "_island").agg(F.min(start).alias("lo"), F.max("_end").alias("hi")).drop("_island")
    covered, span = F.sum(F.col("hi") - F.col("lo")).alias("covered"), (F.max("hi") - F.min("lo")).alias("span")
    summary = ranges.groupBy(flow).agg(F.count("*").alias("ranges"), covered, span)
    return ranges, summary.withColumn("share", F.col("covered") / F.col("span"))


def channel_changes(df: DataFrame, ap: str = "ap", ts: str = "ts", order: Sequence[str] = (), log_per_day: int = 1500, push_per_day: int = 100, frame: str | None = None) -> DataFrame:
    """Every change of an access point's channel: ap, ts, prev_chan, new_chan, logged, pushed.

    Frames without channel say nothing. The first changes of a day are to be
    logged and, fewer of them, pushed; no change is left out. With frame, a
    column of ids, prev_frame (the last one on the old channel) and new_frame are
    what a push hands on.
    """
    w = Window.partitionBy(ap).orderBy(ts, *order)
    seen = df.filter(F.col("channel").isNotNull()).withColumn("prev_chan", F.lag("channel").over(w))
    frames = []
    if frame:
        seen = seen.withColumn("prev_frame", F.lag(frame).over(w)).withColumn("new_frame", F.col(frame))
        frames = ["prev_frame", "new_frame"]
    nth = F.row_number().over(Window.partitionBy(ap, F.to_date(ts)).orderBy(ts, *order))
    moved = seen.filter("prev_chan <> channel").withColumn("_n", nth)
    return moved.select(ap, ts, "prev_chan", F.col("channel").alias("new_chan"), (F.col("_n") <= log_per_day).alias("logged"), (F.col("_n") <= push_per_day).alias("pushed"), *frames)


def time_order(df: DataFrame, ts: str = "ts", arrival_ts: str | None = None, timeout_seconds: float = 5, drop_late: bool = False, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows in time order over range partitions, late rows).

    Late: arrived the timeout or more after their time; they pass unless dropped.
    A row without arrival time is not late.
    """
    ranged = lambda d: d.repartitionByRange(F.col(ts)).sortWithinPartitions(ts, *order)
    if arrival_ts is None:
        return ranged(df), df.limit(0)
    late = F.coalesce(F.unix_micros(arrival_ts) - F.unix_micros(ts) >= int(timeout_seconds * 1_000_000), F.lit(False))
    return ranged(df.filter(~late)), df.filter(late) if not drop_late else df.filter(late).limit(0)
