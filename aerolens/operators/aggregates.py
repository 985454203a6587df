"""Counters, interval reports, argmax choices and roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the overlay header and of the annotations on every packet, and the compression seen in a trace: fixed values.
OVERLAY_HEADER, ANNOTATIONS, COMPRESSION = 40, 48, 0.35

#: Frame classes; they overlap.
CLASSES: dict[str, str] = {
    "mgmt": "ftype = 0",
    "ctrl": "ftype = 1",
    "data": "ftype = 2",
    "null_data": "ftype = 2 and fsubtype & 4 = 4",
    "beacon": "ftype = 0 and fsubtype = 8",
    "encrypted": "ftype = 2 and protected",
}


def class_counts(df: DataFrame, classes: Mapping[str, str] = CLASSES, keys: Sequence[str] = (), length: str = "length") -> DataFrame:
    """packets and bytes of every class in one pass."""
    aggs = []
    for name, test in ((n, F.expr(t)) for n, t in classes.items()):
        aggs += [F.count_if(test).alias(f"{name}_packets"), F.coalesce(F.sum(F.when(test, F.col(length))), F.lit(0)).cast("long").alias(f"{name}_bytes")]
    return df.groupBy(*keys).agg(*aggs)


def bytes_as_integer(raw: Column, offset: int, length: int, little_endian: bool = False) -> Column:
    """The unsigned integer at an offset of a binary column; null where the row is too short."""
    if not 1 <= length <= 4:
        raise ValueError("length must be 1 to 4")
    part = F.substring(raw, offset + 1, length)
    digits = F.hex(part)
    if little_endian:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(length))))
    return F.when(F.length(raw) >= offset + length, F.conv(digits, 16, 10).cast("long"))


def interval_counts(df: DataFrame, ts: str = "ts", interval: str = "300 seconds", keys: Sequence[str] = (), measures: Mapping[str, Column] | None = None) -> DataFrame:
    """Counts of each key and tumbling interval by event time."""
    measures = measures or {"packets": F.count("*")}
    out = df.groupBy(F.window(ts, interval).alias("w"), *keys).agg(*(m.alias(n) for n, m in measures.items()))
    return out.select(F.col("w.start").alias("start"), *keys, *measures)


def ip_traffic(df: DataFrame, interval: str, keys: Sequence[str], order: Sequence[str], first_packet_quirk: bool = False) -> DataFrame:
    """packets and bytes per IP protocol; with the quirk the first packet of a key and interval counts its frame length."""
    if not first_packet_quirk:
        return interval_counts(df, interval=interval, keys=keys, measures={"packets": F.count("*"), "bytes": F.sum("ip_len").cast("long")})
    w = F.window("ts", interval)
    head = F.min(F.struct(*order, "length", "ip_len")).alias("head")
    out = df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("packets"), F.sum("ip_len").cast("long").alias("s"), head)
    return out.select(F.col("w.start").alias("start"), *keys, "packets", (F.col("s") - F.col("head.ip_len") + F.col("head.length")).alias("bytes"))


def traffic_counts(df: DataFrame, interval: str, ranges: Mapping[str, Sequence[tuple[int, int]]], keys: Sequence[str] = (), order: Sequence[str] = ("frame_id",), first_packet_quirk: bool = True) -> DataFrame:
    """start, keys, kind, code, high, packets, bytes of every kind of traffic, in one pass.

    kind ether counts by ethertype, wifi by type and subtype (type + 4 * subtype),
    ip by protocol, and tcp and udp by each port range (code to high) that holds
    one of the ports. Ether and wifi count whole frames, ip its own length (but
    the frame's for the first packet of a protocol and interval), tcp and udp
    that length without the IP header. A frame without a layer does not count
    there. Columns: ts, length, ethertype, ftype, fsubtype, ip_proto, ip_len,
    ip_hl (bytes), sport, dport.
    """
    count = lambda kind, code, size, high=None: F.struct(F.lit(kind).alias("kind"), F.lit(code).cast("int").alias("code") if isinstance(code, int) else code.cast("int").alias("code"), F.lit(high).cast("int").alias("high"), size.cast("long").alias("size"))
    ip = F.col("ip_proto").isNotNull()
    entries = [F.when(F.col("ethertype").isNotNull(), count("ether", F.col("ethertype"), F.col("length"))), F.when(F.col("ftype").isNotNull(), count("wifi", F.col("ftype") + 4 * F.col("fsubtype"), F.col("length"))), F.when(ip, count("ip", F.col("ip_proto"), F.col("ip_len")))]
    # fixed values: numbers of the protocols
    for kind, proto in (("tcp", 6), ("udp", 17)):
        for low, high in ranges.get(kind, ()):
            inside = F.col("sport").between(low, high) | F.col("dport").between(low, high)
            entries.append(F.when((F.col("ip_proto") == proto) & inside, count(kind, low, F.col("ip_len") - F.col("ip_hl"), high)))
    rows = df.select("ts", *keys, *order, "length", "ip_len", F.explode(F.array_compact(F.array(*entries))).alias("c"))
    out = rows.groupBy(F.window("ts", interval).alias("w"), *keys, "c.kind", "c.code", "c.high").agg(F.count("*").alias("packets"), F.sum("c.size").alias("s"), F.min(F.struct(*order, "length", "ip_len")).alias("head"))
    first = F.when((F.col("kind") == "ip") & F.lit(first_packet_quirk), F.col("head.length") - F.col("head.ip_len")).otherwise(0)
    return out.select(F.col("w.start").alias("start"), *keys, "kind", "code", "high", "packets", (F.col("s") + first).alias("bytes"))


def lower_median(col: str) -> Column:
    """Element ceil(n / 2) of the sorted values without nulls."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {col})")


def cdf_points(df: DataFrame, col: str, n: int = 100, ascending: bool = True) -> DataFrame:
    """point, value: the values at ranks int((i + 1) * (count - 1) / n) of the sorted column.

    Ranks come from counts of distinct values, range-partitioned, so no task sorts all rows.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("k"))
    order = F.col("value").asc() if ascending else F.col("value").desc()
    parts = counts.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    base = parts.groupBy("part").agg(F.sum("k").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inner = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.join(base, "part").withColumn("hi", F.col("base") + F.sum("k").over(inner)).withColumn("lo", F.col("hi") - F.col("k"))
    total = counts.agg(F.sum("k").alias("total")).scalar()
    points = df.sparkSession.range(n).select(F.col("id").cast("int").alias("point"), F.floor((F.col("id") + 1) * (total - 1) / n).alias("rank"))
    # n rows, so the broadcast is as small as the report
    return ranked.join(F.broadcast(points), (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("point", "value")


def best_observer(counts: DataFrame, entity: str, observer: str, measures: Sequence[str]) -> DataFrame:
    """The observer with most of the first measure that an entity has at all; ties keep the lower id."""
    # a later measure only counts where all earlier ones are zero
    w = Window.partitionBy(entity)
    keep = None
    zero = F.lit(True)
    for m in measures:
        most = F.max(m).over(w)
        test = zero & (most > 0) & (F.col(m) == most)
        keep = test if keep is None else keep | test
        zero = zero & (most == 0)
    return counts.withColumn("_keep", keep).filter("_keep").groupBy(entity).agg(F.min(observer).alias(observer))


def owner_with_hysteresis(counts: DataFrame, previous: DataFrame, *, entity: str = "bssid", observer: str = "sniffer_id", rate: str = "rate", duration: str | None = None, least_duration: float = 0, ratio: float = 1.25, margin: float = 10240.0, sticky: bool = True) -> DataFrame:
    """The observer with the highest rate of each entity, later ids winning ties.

    An entity that has an owner keeps it for good if sticky; else unless the best
    rate is at least ratio times and margin above the owner's own, which is 0
    where it hears nothing. With a duration column an entity that no observer has
    watched for least_duration is not decided: it keeps its owner or has none.
    """
    watched = F.max(duration) if duration else F.lit(float(least_duration))
    best = counts.groupBy(entity).agg(F.max(F.struct(rate, observer)).alias("b"), watched.alias("watched")).filter(F.col("watched") >= least_duration)
    own = counts.select(entity, F.col(observer).alias("owner"), F.col(rate).alias("own_rate"))
    both = best.join(previous.select(entity, "owner").join(own, [entity, "owner"], "left"), entity, "full")
    own_rate = F.coalesce("own_rate", F.lit(0.0))
    better = (F.col(f"b.{rate}") >= own_rate * ratio) & (F.col(f"b.{rate}") >= own_rate + margin)
    moves = F.col("owner").isNull() | (F.lit(not sticky) & F.col("b").isNotNull() & better)
    return both.select(entity, F.when(moves, F.col(f"b.{observer}")).otherwise(F.col("owner")).alias("owner"))


def bytes_on_wire(size: Column, packets: Column) -> Column:
    return (size + packets * (OVERLAY_HEADER + ANNOTATIONS)) * COMPRESSION


def link_load(traffic: DataFrame, paths: DataFrame, factor: float = 1.0) -> DataFrame:
    """Bytes over every undirected link: traffic (src, dst, bytes) sent along paths (src, dst, links)."""
    hops = traffic.join(paths, ["src", "dst"]).select(F.explode("links").alias("l"), (F.col("bytes") * factor).alias("b"))
    return hops.groupBy(F.least("l.a", "l.b").alias("a"), F.greatest("l.a", "l.b").alias("b")).agg(F.sum("b").alias("bytes"))


def usage_by_class(traffic: DataFrame, paths: DataFrame) -> DataFrame:
    """host, class, kbits: both ends of every link used, over the span seen (no span: 1 ms)."""
    hops = traffic.join(paths, ["src", "dst"]).select("class", "ts", "bytes", F.explode("links").alias("l"))
    ends = hops.select("class", "ts", "bytes", F.explode(F.array("l.a", "l.b")).alias("host"))
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    out = ends.groupBy("host", "class").agg(F.sum("bytes").alias("bytes"), span.alias("span"))
    return out.select("host", "class", (F.col("bytes") * 8 / 1024 / F.when(F.col("span") == 0, F.lit(0.001)).otherwise(F.col("span"))).alias("kbits"))


def host_status(messages: DataFrame, now: Column, keys: Sequence[str] = ("host",), last: Sequence[str] = ("cpu", "rss"), sums: Sequence[str] = ("recv", "drop", "bytes"), gap: int = 60, order: Sequence[str] = ()) -> DataFrame:
    """Last values, running sums, uptime without gaps, and whether the host is online.

    A pause of `gap` seconds or more is a gap; uptime is the length of all runs
    of messages between gaps, 10 s at least. order tells messages of one time apart.
    """
    us = F.unix_micros("ts")
    w = Window.partitionBy(*keys).orderBy("ts", *order)
    pause = us - F.lag(us).over(w)
    marked = messages.withColumn("_up", F.when(pause < gap * 1_000_000, pause).otherwise(0))
    at = F.struct("ts", *order)
    out = marked.groupBy(*keys).agg(*(F.max_by(c, at).alias(c) for c in last), *(F.sum(c).alias(c) for c in sums), F.max("ts").alias("last_seen"), F.sum("_up").alias("_up"))
    up = F.greatest(F.lit(10.0), F.col("_up") / 1e6)
    return out.withColumn("uptime", up).withColumn("online", F.unix_micros(now) - F.unix_micros("last_seen") < gap * 1_000_000).drop("_up")


def loss_accounting(events: DataFrame, running: bool = False) -> DataFrame:
    """Packets not accounted for: captured - queue drops - drops - produced + in - out."""
    sign = F.when(F.col("kind").isin("captured", "in"), 1).when(F.col("kind").isin("waitq_drops", "drops", "produced", "out"), -1).otherwise(0)
    signed = events.withColumn("signed", sign * F.col("n"))
    if running:
        return signed.withColumn("unaccounted", F.sum("signed").over(Window.partitionBy("host").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    return signed.groupBy("host").agg(F.sum("signed").alias("unaccounted"))


def association_counts(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Clients, access points, IBSS and all stations; IBSS stations are in neither of the first two."""
    ibss = F.col("is_ibss")
    return states.groupBy(*keys).agg(
        F.count_if(~ibss & ~F.col("is_ap")).alias("clients"), F.count_if(~ibss & F.col("is_ap")).alias("aps"), F.count_if(ibss).alias("ibss"), F.count("*").alias("stations"), F.countDistinct("bssid").alias("bss")
    )
