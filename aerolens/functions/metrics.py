"""Logs to entries, entries to typed tables and metric series."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolens.session import staged

from .scalars import kv_field, kv_map, line_pairs, pair_value

#: Log levels in rising order.
LEVELS = ("DEBUG", "DATA", "INFO", "WARN", "ERR", "CRIT")
_LINE = r"^(\w{3})\s+(\d{1,2})\s+(\d\d:\d\d:\d\d)\.(\d{3})\s+(\S+)\s+(\w+):?\s+(.*)$"


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in LEVELS)), level).cast("int") - 1


def parse_log(lines: DataFrame, now: Column, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(entries, rejected lines) of `Mon day time.msec source LEVEL message` lines.

    Lines carry no year: a month later than that of now belongs to the year before.
    """
    part = lambda i: F.regexp_extract(value, _LINE, i)
    stamp = lambda year: F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), part(1), F.lit(" "), F.lpad(part(2), 2, "0"), F.lit(" "), part(3), F.lit("."), part(4)), F.lit("yyyy MMM dd HH:mm:ss.SSS"))
    this, last = stamp(F.year(now)), stamp(F.year(now) - 1)
    ts = F.when(F.month(this) > F.month(now), last).otherwise(F.coalesce(this, last))
    rank = level_rank(part(6))
    marked = lines.withColumns({"ts": ts, "source": part(5), "level": part(6), "level_rank": rank, "data": part(7)})
    good = F.col("ts").isNotNull() & (F.col("level_rank") >= 0)
    return marked.filter(good).drop(value), marked.filter(~F.coalesce(good, F.lit(False))).select(value)


def log_order(entries: DataFrame, keys: Sequence[str] = (), ts: str = "ts", arrival: str = "line", window_seconds: int = 60) -> DataFrame:
    """Adds `place`, the place of each entry in a reader's output, from 1 in each file (keys).

    A reader holds entries back until one has come whose time is the window or
    more after theirs, and hands them out by time. An entry that comes later
    than that goes out as soon as it can: after all that went out before it
    came. Lines of one time leave as they came.
    """
    us = F.unix_micros(ts)
    limit = window_seconds * 1_000_000
    read = Window.partitionBy(*keys).orderBy(arrival)
    top = F.max(us).over(read.rowsBetween(Window.unboundedPreceding, -1))
    # what was on hand when an entry came: its times up to the highest less the window had gone out by then
    late = F.coalesce(us <= top - limit, F.lit(False))
    marked = entries.withColumn("_at", F.when(late, top - limit).otherwise(us))
    out = Window.partitionBy(*keys).orderBy("_at", F.when(late, 1).otherwise(0), arrival)
    return marked.withColumn("place", F.row_number().over(out)).drop("_at")


def with_fields(entries: DataFrame) -> DataFrame:
    """Adds head (first word of the message) and fields (map of the rest)."""
    tail = F.regexp_extract("data", r"(?s)^\S+\s+(.*)$", 1)
    return entries.withColumn("head", F.regexp_extract("data", r"^(\S+)", 1)).withColumn("fields", kv_map(tail, dashes=True))


def _field(key: str) -> Column:
    """A field of an entry's message; the head is a pair without value."""
    return kv_field(F.col("data"), key)


def _of_kind(sources: Sequence[str], head: str) -> Column:
    return F.col("source").isin(*sources) & F.col("data").startswith(f"{head} ")


@dataclass(frozen=True)
class TableSpec:
    """Which entries make a table, what its reports are told apart by, and its columns: name -> (field, type)."""

    source: str
    head: str
    columns: Mapping[str, tuple[str, str]]
    keys: tuple[str, ...] = ("host",)

    def entries(self) -> Column:
        """`source*` stands for the source and all that continue it, `source_*` for those with a name after the underscore."""
        source = F.col("source")
        if self.source.endswith("_*"):
            test = source.startswith(self.source[:-1])
        elif self.source.endswith("*"):
            test = source.startswith(self.source[:-1])
        else:
            test = source == self.source
        return test & F.col("data").startswith(f"{self.head} ")


def _longs(**fields: str) -> dict[str, tuple[str, str]]:
    return {"host": ("host", "string")} | {name: (field, "long") for name, field in fields.items()}


#: Log record kinds, their tables, and the fields of their columns.
TABLES: dict[str, TableSpec] = {
    "pcap_stats": TableSpec("pcap", "STATS", _longs(kernel_recv="kern-recv", kernel_drop="kern-drop", mem_drop="mem-drop", all_capt_packets="pre-capt-pkts", all_capt_bytes="pre-capt-bytes", filt_capt_packets="post-capt-pkts", filt_capt_bytes="post-capt-bytes")),
    "query_stats": TableSpec("queries", "STATS", _longs() | {"query": ("query", "string")} | _longs(in_packets="in-pkts", out_msgs="out-pkts", out_bytes="out-bytes", dropped_msgs="drop-pkts"), ("host", "query")),
    "toserver_query_stats": TableSpec("to_server", "STATS", _longs() | {"query": ("query", "string")} | _longs(dequeued_msgs="count", dequeued_bytes="bytes")),
    "toserver_output_stats": TableSpec("to_server", "OUT-STATS", _longs(sent_msgs="count", sent_bytes="bytes") | {"compress_rate": ("avg-compress-rate", "double"), "avg_compress_size": ("avg-compress-size", "double"), "avg_cpu": ("avg-cpu", "double")}),
    "overlay_sniffer_stats": TableSpec(
        "wifi_ol",
        "STATS",
        _longs(
            total_routes="routes", self_routes="self-routes", no_route_packets="no-route-pkts", unclassified_packets="unclassified", bcast_packets="bcast-pkts", waitq_dropped_msgs="waitq-drops", waitq_dropped_bytes="waitq-drop-bytes", ttl_dropped_msgs="ttl-drops",
            ttl_dropped_bytes="ttl-drop-bytes", from_self_packets="from-self-pkts", from_peers_packets="from-peers-pkts", net_recv_msgs="recv", net_recv_bytes="recv-bytes",
        ),
    ),
    "overlay_server_stats": TableSpec("wifi_ol_*", "STATS", _longs(total_routes="routes")),
    "overlay_server_sockrecv": TableSpec("ol_in_proxy", "STATS", _longs(net_recv_msgs="recv", net_recv_bytes="recv-bytes")),
    "overlay_peer_input_stats": TableSpec("wifi_ol*", "IN-STATS", _longs() | {"peer": ("peer", "string")} | _longs(recv_packets="in-pkts", recv_ctrl_msgs="in-ctrl", recv_bytes="in-bytes")),
    "overlay_peer_output_stats": TableSpec(
        "wifi_ol*",
        "OUT-STATS",
        _longs()
        | {"peer": ("peer", "string")}
        | _longs(enqueued_packets="queued-pkts", enqueued_ctrl_msgs="queued-ctrl", enqueued_bytes="queued-bytes", enqueued_reroute_msgs="queued-reroutes", dropped_packets="drop-pkts", dropped_ctrl_msgs="drop-ctrl", dropped_bytes="drop-bytes", dequeued_msgs="out-all", sent_bytes="send-bytes")
        | {"compress_rate": ("compress-rate", "double"), "avg_compress_size": ("avg-compress-size", "double"), "avg_cpu": ("avg-cpu", "double")},
    ),
}


def typed_table(entries: DataFrame, spec: TableSpec, order: Sequence[str] = (), default_seconds: float = 10) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected entries) of one kind; a missing or malformed field rejects the entry.

    Rows get duration_msec, the time since the report before of the same keys.
    Sources with a name after `wifi_ol_` give it as testbed.
    """
    kind = entries.filter(spec.entries())
    cols = {name: _field(field).try_cast(kind_) for name, (field, kind_) in spec.columns.items()}
    if spec.source == "wifi_ol_*":
        cols["testbed"] = F.substring("source", 9, 1 << 30)
    typed = kind.withColumns(cols)
    whole = F.lit(True)
    for name in cols:
        whole &= F.col(name).isNotNull()
    kept = [c for c in entries.columns if c not in cols and c not in ("data", "source", "level")]
    # a report counts for the time of the next one even where another field of it is bad
    last = F.lag("ts").over(Window.partitionBy(*spec.keys).orderBy("ts", *order))
    duration = F.coalesce(((F.unix_micros("ts") - F.unix_micros(last)) / 1000).cast("long"), F.lit(int(default_seconds * 1000)).cast("long"))
    named = typed.dropna(subset=list(spec.keys)).withColumn("duration_msec", duration)
    return named.filter(whole).select(*kept, *cols, "duration_msec"), typed.filter(~whole).select(*entries.columns)


@dataclass(frozen=True)
class Metric:
    """kind: packets (rate), bytes (rate in Kbit), measure (mean) or count (sum); entries and the value that they give."""

    kind: str
    entries: Column | None = None
    value: Column | None = None


#: Seconds between two reports of a log source: fixed value.
REPORT_SECONDS = 10
#: Bytes of headers a packet and compression seen in a trace: fixed values.
HEADER_BYTES, COMPRESSION = 88, 0.35

_PCAP, _SERVER = ("pcap", "script"), ("net_proxy", "to_server")


def _parsed(key: str) -> Column:
    """A field of an entry whose pairs are at hand (`_pairs`)."""
    return pair_value(F.col("_pairs"), key)


def _basic(kind: str, sources: str | Sequence[str], head: str, field: str) -> Metric:
    return Metric(kind, _of_kind([sources] if isinstance(sources, str) else sources, head), _number(field))


def _number(key: str) -> Column:
    return _parsed(key).try_cast("double")


def _metrics() -> dict[str, Metric]:
    """Names, kinds, sources and fields are fixed values."""
    allocated = F.split_part(_parsed("alloc-pkts"), F.lit("/"), F.lit(1)).try_cast("double")
    new = lambda i: F.regexp_extract("data", r"^created (\d+) new routes; updated (\d+) routes", i).try_cast("double")
    routed = (F.col("source") == "wifi_ol") & F.col("data").rlike(r"^created \d+ new routes; updated \d+ routes")
    self_records = F.filter(F.split("data", r"\|"), lambda r: kv_field(r, "src") == kv_field(r, "dst"))
    own = lambda key: F.when(F.size(self_records) > 0, F.aggregate(self_records, F.lit(0.0), lambda a, r: a + F.coalesce(kv_field(r, key).try_cast("double"), F.lit(0.0))))
    usage = _of_kind(["wifi_ol"], "NET-USAGE")
    merged = _of_kind(["wifi_merge"], "STATS")
    return {
        "cpu": _basic("measure", "system", "SYSINFO", "cpu-10"),
        "mem": Metric("measure", _of_kind(["system"], "SYSINFO"), _number("maxrss-kb") / 1024),
        "mem-drops": _basic("packets", _PCAP, "STATS", "mem-drop"),
        "alloc-pkts": Metric("measure", _of_kind(["system"], "SYSINFO"), allocated),
        "alloc-payloads": Metric("measure", _of_kind(["system"], "SYSINFO"), allocated),
        "kern-recv": _basic("packets", _PCAP, "STATS", "kern-recv"),
        "kern-drops": _basic("packets", _PCAP, "STATS", "kern-drop"),
        "pcap-bytes": _basic("bytes", _PCAP, "STATS", "pre-capt-bytes"),
        "pcap-pkts": _basic("packets", _PCAP, "STATS", "pre-capt-pkts"),
        "captured-bytes": _basic("bytes", _PCAP, "STATS", "post-capt-bytes"),
        "captured-pkts": _basic("packets", _PCAP, "STATS", "post-capt-pkts"),
        "log-queue-drops": _basic("packets", _PCAP, "APP-STATS", "log-qdrops"),
        "pkt-queue-drops": _basic("packets", _PCAP, "APP-STATS", "pkt-qdrops"),
        "no-route-pkts": _basic("measure", "wifi_ol", "STATS", "no-route-pkts"),
        "net": Metric("measure"),
        "net-links": Metric("measure"),
        "overlay-drops": _basic("packets", "wifi_ol", "STATS", "drops"),
        "overlay-drop-bytes": _basic("bytes", "wifi_ol", "STATS", "drop-bytes"),
        "overlay-waitq-drops": _basic("packets", "wifi_ol", "STATS", "waitq-drops"),
        "overlay-waitq-drop-bytes": _basic("bytes", "wifi_ol", "STATS", "waitq-drop-bytes"),
        "overlay-produced": _basic("packets", "wifi_ol", "STATS", "out-pkts"),
        "overlay-bytes-in": _basic("bytes", "wifi_ol", "IN-STATS", "in-bytes"),
        "overlay-bytes-out": _basic("bytes", "wifi_ol", "OUT-STATS", "send-bytes"),
        "overlay-bytes-self": Metric("bytes", usage, own("capt-bytes")),
        "overlay-pkts-in": Metric("packets", _of_kind(["wifi_ol"], "IN-STATS"), _number("in-pkts") + _number("in-ctrl")),
        "overlay-pkts-out": _basic("packets", "wifi_ol", "OUT-STATS", "out-all"),
        "overlay-pkts-self": Metric("packets", usage, own("capt-pkts")),
        "ol-waitq-drops": _basic("packets", "wifi_ol", "STATS", "waitq-drops"),
        "to-server": Metric("bytes", _of_kind(_SERVER, "STATS"), (_number("bytes") + _number("count") * HEADER_BYTES) * COMPRESSION),
        "assigned-bssids": _basic("measure", "wifi_ol", "STATS", "self-routes"),
        "route-additions": Metric("count", routed, new(1)),
        "route-changes": Metric("count", routed, new(2)),
        "unaccounted-packets": Metric("measure"),
        "merge-rate": Metric("measure", merged, F.when(_number("out-merges") != 0, _number("avg-merge"))),
    }


#: Names of all metrics.
METRICS = (
    "cpu mem mem-drops alloc-pkts alloc-payloads kern-recv kern-drops pcap-bytes pcap-pkts captured-bytes captured-pkts log-queue-drops pkt-queue-drops no-route-pkts net net-links overlay-drops overlay-drop-bytes overlay-waitq-drops overlay-waitq-drop-bytes "
    "overlay-produced overlay-bytes-in overlay-bytes-out overlay-bytes-self overlay-pkts-in overlay-pkts-out overlay-pkts-self ol-waitq-drops to-server assigned-bssids route-additions route-changes unaccounted-packets merge-rate"
).split()

#: What adds to the packets that a host must account for, and what takes from them: fixed values.
_ACCOUNT = {"captured-pkts": 1, "ol-waitq-drops": -1, "overlay-drops": -1, "overlay-produced": -1, "overlay-pkts-in": 1, "overlay-pkts-out": -1}


def metric_values(entries: DataFrame, names: Sequence[str], coordinator: str, *, hosts: Sequence[str] | None = None, paths: DataFrame | Callable[[DataFrame], DataFrame] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """metric, kind, host, ts, value of each entry that reports one of the metrics, in one pass over the log.

    Rates are per second, byte rates in Kbit. Route metrics belong to the
    coordinator, which else counts only where the host list names it. The net
    metrics need paths (src, dst, links), or a function that makes them from the
    traffic's src and dst, and name a link's hosts, or the link as `a-b`.
    Unaccounted packets are the running sum of a host.

    The pairs of a line are found once. Where running sums or paths need what the
    lines say a second time, that is staged as a table of values.
    """
    specs = _metrics()
    scale = {"packets": 1 / REPORT_SECONDS, "bytes": 8 / (1024 * REPORT_SECONDS)}
    host = _parsed("host")
    row = lambda metric, kind, who, value, src=F.lit(None), dst=F.lit(None): F.struct(F.lit(metric).alias("metric"), F.lit(kind).alias("kind"), who.alias("host"), value.cast("double").alias("value"), src.cast("string").alias("src"), dst.cast("string").alias("dst"))
    reports = []
    for name in names:
        m = specs[name]
        if m.entries is None:
            continue
        who = F.lit(coordinator) if name.startswith("route-") else kv_field(F.split_part("data", F.lit("|"), F.lit(1)), "src") if name.endswith("-self") else host
        reports.append(F.when(m.entries, row(name, m.kind, who, m.value * scale.get(m.kind, 1.0))))
    summed = "unaccounted-packets" in names
    if summed:
        terms = [F.when(specs[n].entries, specs[n].value * sign) for n, sign in _ACCOUNT.items()]
        known = F.coalesce(*terms)
        reports.append(F.when(known.isNotNull(), row("unaccounted-packets", "measure", host, sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0)))))
    wired = [n for n in ("net", "net-links") if n in names and paths is not None]
    found = F.array_compact(F.array(*reports)) if reports else None
    if wired:
        sent = F.transform(F.coalesce(_sent(coordinator), F.array().cast(_SENT)), lambda r: row("net", "measure", F.lit(None).cast("string"), r["bytes"], r["src"], r["dst"]))
        found = sent if found is None else F.concat(found, sent)
    if found is None:
        return entries.select(F.lit("").alias("metric"), F.lit("").alias("kind"), F.lit("").alias("host"), "ts", F.lit(0.0).alias("value")).limit(0)
    # generated over, so that a line is parsed once however many metrics read it
    parsed = entries.withColumn("_pairs", F.explode(F.array(line_pairs(F.col("data")))))
    values = parsed.select("ts", *order, F.explode(found).alias("r")).select("ts", *order, "r.*").filter("value is not null")
    if summed or wired:
        values = staged(values, "metrics")
    out = values.filter("host is not null and metric <> 'unaccounted-packets'").select("metric", "kind", "host", "ts", "value")
    if summed:
        running = Window.partitionBy("host").orderBy("ts", *order).rowsBetween(Window.unboundedPreceding, 0)
        own = values.filter("host is not null and metric = 'unaccounted-packets'")
        out = out.unionByName(own.select("metric", "kind", "host", "ts", F.sum("value").over(running).alias("value")))
    if wired:
        traffic = values.filter((F.col("metric") == "net") & F.col("dst").isNotNull())
        links = paths(traffic.select("src", "dst").distinct()) if callable(paths) else paths
        hops = traffic.join(links, ["src", "dst"]).select("ts", "value", F.explode("links").alias("l"))
        for name in wired:
            who = F.explode(F.array("l.a", "l.b")) if name == "net" else F.concat_ws("-", "l.a", "l.b")
            out = out.unionByName(hops.select(F.lit(name).alias("metric"), F.lit("measure").alias("kind"), who.alias("host"), "ts", "value"))
    if hosts is not None:
        return out.filter(F.col("host").isin(*hosts))
    return out.filter((F.col("host") != coordinator) | F.col("metric").startswith("route-"))


def metric_series(entries: DataFrame, name: str, coordinator: str, window: int = 60, hosts: Sequence[str] | None = None, **options) -> DataFrame:
    """host, ts, value of a metric in windows: sums of rates and counts, means of measures; the time is the mean time.

    Times are summed exactly, as a sum of doubles would lose microseconds and depend on the order of rows.
    Without a host list the coordinator counts only for routes.
    """
    rows = metric_values(entries, [name], coordinator, hosts=hosts, **options)
    agg = F.when(F.first("kind") == "measure", F.avg("value")).otherwise(F.sum("value"))
    total = F.sum(F.unix_micros("ts").cast("decimal(19,0)")).alias("_us")
    out = rows.groupBy("host", F.window("ts", f"{window} seconds").alias("w")).agg(total, F.count("*").alias("_n"), agg.alias("value")).withColumn("_whole", F.expr("_us div _n"))
    # the double nearest the mean, rounded down
    at = F.floor(F.col("_whole") + (F.col("_us") % F.col("_n")).cast("double") / F.col("_n"))
    return out.select("host", F.timestamp_micros(at.cast("long")).alias("ts"), "value")


_SENT = "array<struct<src:string,dst:string,class:string,bytes:double>>"


def _sent(coordinator: str) -> Column:
    """What an entry says was sent over the network, null if nothing; without what a host sent itself."""
    to_server = F.struct(_parsed("host").alias("src"), F.lit(coordinator).alias("dst"), F.lit("merged").alias("class"), _number("bytes").alias("bytes"))
    raw = F.struct(_parsed("host").alias("src"), F.lit(coordinator).alias("dst"), F.lit("raw").alias("class"), ((_number("post-capt-bytes") + _number("post-capt-pkts") * HEADER_BYTES) * COMPRESSION).alias("bytes"))
    record = lambda r: F.struct(kv_field(r, "src").alias("src"), kv_field(r, "dst").alias("dst"), F.lit("overlay").alias("class"), kv_field(r, "capt-bytes").try_cast("double").alias("bytes"))
    sent = (
        F.when(_of_kind(_SERVER, "STATS") & (_parsed("port") == "on_wire"), F.array(to_server))
        .when(_of_kind(["script"], "STATS"), F.array(raw))
        .when(_of_kind(["wifi_ol"], "NET-USAGE"), F.transform(F.split("data", r"\|"), record))
    )
    return F.filter(sent, lambda r: r["bytes"].isNotNull() & (r["src"] != r["dst"]) & ((r["class"] != "overlay") | ((r["bytes"] != 0) & (r["src"] != coordinator)))).cast(_SENT)


def net_traffic(entries: DataFrame, coordinator: str) -> DataFrame:
    """src, dst, class, ts, bytes of what hosts sent over the network.

    class merged: bytes on the wire to the coordinator; raw: captured bytes that
    would go there, with headers and compression; overlay: bytes of each record
    of a usage line but for those to oneself, from the coordinator, or none.
    """
    parsed = entries.withColumn("_pairs", F.explode(F.array(line_pairs(F.col("data")))))
    return parsed.select("ts", F.explode(_sent(coordinator)).alias("s")).select("s.src", "s.dst", "s.class", "ts", "s.bytes")


def route_events(entries: DataFrame, coordinator: str) -> DataFrame:
    """ts, host, event (addition or change) and n from messages on created and updated routes; both events of every message."""
    names = {"route-additions": "addition", "route-changes": "change"}
    rows = metric_values(entries, list(names), coordinator)
    return rows.select("ts", "host", F.when(F.col("metric") == "route-additions", "addition").otherwise("change").alias("event"), F.col("value").cast("long").alias("n"))


def merge_rate(counts: DataFrame) -> DataFrame:
    """Captures merged per frame put out, per host; rows without output are skipped."""
    return counts.filter("n_out > 0").groupBy("host").agg((F.sum("n_in") / F.sum("n_out")).alias("rate"))
