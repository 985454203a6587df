"""Small graphs: skew paths between sniffers and routes between hosts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolens.session import cut_lineage


def routes(observations: DataFrame, now: str | None = None, window_seconds: int = 7200) -> DataFrame:
    """src, dst, gateway: the gateway seen most often in the window before the last observation; ties keep the lowest."""
    us = F.unix_micros("ts")
    recent = observations
    if window_seconds:
        last = observations.agg(F.max(us)).scalar()
        recent = observations.filter(us >= last - window_seconds * 1_000_000)
    counts = recent.groupBy("src", "dst", "gateway").agg(F.count("*").alias("n"))
    return counts.groupBy("src", "dst").agg(F.min_by("gateway", F.struct(-F.col("n"), F.col("gateway"))).alias("gateway"))


def skew_paths(edges: DataFrame, base: int, keys: tuple[str, ...] = ("slice",)) -> DataFrame:
    """keys, sniffer_id, hops, skew_us, spread_us: the path of fewest hops from the base in the graph of each key, one graph without keys.

    Of equal hops the path through the lowest ids wins. edges: keys, src, dst,
    skew_us, spread_us. A round extends the paths of all keys by one hop, and the
    search ends with a round that reaches no sniffer.
    """
    if not keys:
        found = skew_paths(edges.withColumn("slice", F.lit(0)), base).drop("slice")
        alone = edges.sparkSession.range(1).select(F.lit(base).alias("sniffer_id"), F.lit(0).alias("hops"), F.lit(0).cast("long").alias("skew_us"), F.lit(0).cast("long").alias("spread_us"))
        return found.unionByName(alone.join(found, "sniffer_id", "left_anti"))
    via = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    edges = cut_lineage(edges)  # every round reads them
    zero = F.lit(0).cast("long")
    hops = edges.select(*keys, F.col("src").alias("sniffer_id"), F.col("dst").alias("next"), F.col("skew_us").alias("e_skew"), F.col("spread_us").alias("e_spread"))
    level = edges.select(*keys).distinct().withColumns({"sniffer_id": F.lit(base), "hops": F.lit(0), "skew_us": zero, "spread_us": zero, "via": F.lit(str(base).rjust(8, "0"))})
    found = level = cut_lineage(level)
    while True:
        step = level.join(hops, [*keys, "sniffer_id"]).select(*keys, F.col("next").alias("sniffer_id"), (F.col("hops") + 1).alias("hops"), (F.col("skew_us") + F.col("e_skew")).alias("skew_us"), (F.col("spread_us") + F.col("e_spread")).alias("spread_us"), F.concat("via", F.lit("/"), via("next")).alias("via"))
        best = step.groupBy(*keys, "sniffer_id").agg(F.min(F.struct("via", "hops", "skew_us", "spread_us")).alias("m")).select(*keys, "sniffer_id", "m.hops", "m.skew_us", "m.spread_us", "m.via")
        level = cut_lineage(best.join(found, [*keys, "sniffer_id"], "left_anti"))
        if level.isEmpty():
            return found.drop("via")
        found = cut_lineage(found.unionByName(level))


def walk_routes(pairs: DataFrame, table: DataFrame, max_hops: int = 20, wired: DataFrame | None = None, coordinator=None) -> tuple[DataFrame, DataFrame]:
    """(src, dst, links) of the pairs whose routes arrive, and the pairs whose routes loop, end or exceed max_hops.

    links are sorted ends of each hop in order. wired (src, dst) are direct
    links that go before the table; a route of wired links alone has no links.
    The hop to a coordinator adds no link, and none leads through it.

    Routes double in each round: the route from a host is that of k hops and the
    one of k hops from where it ends, so five rounds walk 32 hops.
    """
    end = lambda at, to: F.array(F.struct(F.least(at, to).alias("a"), F.greatest(at, to).alias("b")))
    hops = table.select(F.col("src").alias("at"), F.col("dst"), F.col("gateway").cast(table.schema["dst"].dataType).alias("next"), F.lit(False).alias("all_wired"))
    if wired is not None:
        direct = wired.select(F.col("src").alias("at"), F.col("dst"), F.col("dst").alias("next"), F.lit(True).alias("all_wired")).distinct()
        hops = hops.join(direct, ["at", "dst"], "left_anti").unionByName(direct)
    links = end("at", "next")
    if coordinator is not None:
        hops = hops.filter((F.col("next") != coordinator) | (F.col("dst") == coordinator))
        links = F.when(F.col("next") == coordinator, F.array().cast(hops.select(links.alias("l")).schema["l"].dataType)).otherwise(links)
    walk = cut_lineage(hops.filter("at <> dst").select("at", "dst", "next", "all_wired", F.lit(1).alias("n"), links.alias("links")))
    for _ in range(math.ceil(math.log2(max(2, max_hops)))):
        on = walk.select(F.col("at").alias("next"), "dst", F.col("next").alias("_next"), F.col("all_wired").alias("_wired"), F.col("n").alias("_n"), F.col("links").alias("_links"))
        further = walk.filter("next <> dst").join(on, ["next", "dst"])
        walk = cut_lineage(walk.filter("next = dst").unionByName(further.select("at", "dst", F.col("_next").alias("next"), (F.col("all_wired") & F.col("_wired")).alias("all_wired"), (F.col("n") + F.col("_n")).alias("n"), F.concat("links", "_links").alias("links"))))
    arrived = walk.filter((F.col("next") == F.col("dst")) & (F.col("n") <= max_hops))
    arrived = arrived.select(F.col("at").alias("src"), "dst", F.when(F.col("all_wired"), F.slice("links", 1, 0)).otherwise(F.col("links")).alias("links"))
    ends = pairs.select("src", "dst")
    return ends.join(arrived, ["src", "dst"]), ends.join(arrived, ["src", "dst"], "left_anti")
