"""As-of, range, bit-mask and data-quality joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, value_cols: Sequence[str], *, strict: bool = False, tolerance: Column | None = None, slice_length: float | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time.

    strict: before only. tolerance: an older right row gives nulls (an interval
    or, for numeric times, a number). Among right rows of one time the greatest
    values win, whatever the input order.

    Union, sort by key, time and side, carry the last right row forward; no state
    is kept. With slice_length (seconds or, for numeric times, their unit) a key
    is cut into slices of time, so that a key with a third of all rows is many
    sorted runs: each slice's last right row is one row, these are carried over
    the slices of the key, and a slice begins with what it inherits.
    """
    side = 0 if not strict else 1
    keys = [f"_k_{c}" for c in by]
    carried = F.struct(F.col(right_ts).alias("_at"), *(F.col(c).alias(f"_v_{c}") for c in value_cols))
    l = left.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col(left_ts).alias("_ts"), F.lit(1 - side).alias("_side"), F.struct(*left.columns).alias("_left"))
    r = right.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col(right_ts).alias("_ts"), F.lit(side).alias("_side"), carried.alias("_right"))
    both = l.unionByName(r, allowMissingColumns=True)
    if slice_length is None:
        run = keys
    else:
        run = [*keys, "_slice"]
        number = F.unix_micros("_ts") / 1_000_000 if dict(left.dtypes)[left_ts].startswith("timestamp") else F.col("_ts")
        both = both.withColumn("_slice", F.floor(number / slice_length))
        # one row a slice; it goes to the head of the next slice of its key that has rows
        last = both.filter("_right is not null").groupBy(*run).agg(F.max(F.struct("_ts", "_right")).alias("_m")).select(*run, F.col("_m._right").alias("_own"))
        slices = both.select(*run).distinct().join(last, run, "left")
        over = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        heads = slices.withColumn("_right", F.last("_own", ignorenulls=True).over(over)).filter("_right is not null").select(*run, F.col("_right._at").alias("_ts"), F.lit(-1).alias("_side"), "_right")
        both = both.unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*run).orderBy("_ts", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_right", ignorenulls=True).over(w)).filter("_left is not null")
    hit = F.col("_last._at").isNotNull()
    if tolerance is not None:
        hit &= F.col("_ts") - F.col("_last._at") < tolerance
    return seen.select("_left.*", *(F.when(hit, F.col(f"_last._v_{c}")).alias(f"asof_{c}") for c in value_cols))


def range_join(df: DataFrame, ranges: Sequence[tuple[int, int]], value_cols: Sequence[str]) -> DataFrame:
    """A row once for every range (low, high) that any of the values lies in.

    The ranges are a short fixed list, so each row picks its own from it; no join.
    """
    listed = F.array(*(F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in ranges))
    inside = lambda r: reduce(lambda a, b: a | b, [F.col(c).between(r["low"], r["high"]) for c in value_cols])
    return df.withColumn("_range", F.explode(F.filter(listed, inside))).select(*df.columns, "_range.low", "_range.high")


def range_count(df: DataFrame, ranges: Sequence[tuple[int, int]], value_cols: Sequence[str], keys: Sequence[str | Column], measures: dict[str, Column]) -> DataFrame:
    """Counts per range and keys."""
    return range_join(df, ranges, value_cols).groupBy("low", "high", *keys).agg(*(m.alias(n) for n, m in measures.items()))


def bitmask_join(df: DataFrame, mask_col: str, lookup: DataFrame, bit_col: str) -> DataFrame:
    """A row once for every lookup row whose bits it shares: bits are exploded, then an equi join."""
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda b: F.col(mask_col).cast("long").bitwiseAND(b) != 0)
    exploded = df.withColumn("_bit", F.explode(bits))
    names = lookup.withColumn("_bits", F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda b: F.col(bit_col).cast("long").bitwiseAND(b) != 0)).withColumn("_bit", F.explode("_bits")).drop("_bits")
    return exploded.join(names, "_bit").drop("_bit").distinct()


def node_lookup(df: DataFrame, nodes: DataFrame, host: str = "host") -> tuple[DataFrame, DataFrame]:
    """(rows with node_id, rows of unknown hosts)."""
    joined = df.join(nodes.select(F.col("hostname").alias("_h"), "node_id"), F.col(host) == F.col("_h"), "left").drop("_h")
    return joined.filter("node_id is not null"), joined.filter("node_id is null").drop("node_id")


def skew_pairs(merged: DataFrame, members: str = "members") -> DataFrame:
    """Every ordered pair of members of a merged frame: src, dst, skew_us. Members per frame are few, one a sniffer."""
    pairs = F.flatten(F.transform(members, lambda a: F.transform(F.filter(members, lambda b: b["sniffer_id"] != a["sniffer_id"]), lambda b: F.struct(a["sniffer_id"].alias("src"), b["sniffer_id"].alias("dst"), (b["ts_us"] - a["ts_us"]).alias("skew_us")))))
    return merged.select("frame_id", F.explode(pairs).alias("p")).select("frame_id", "p.*")


def compare_records(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """One row: how many records differ, by reason."""
    x, y = a.select(key, F.struct(*cols).alias("x")), b.select(key, F.struct(*cols).alias("y"))
    both = x.join(y, key, "full")
    present = F.col("x").isNotNull() & F.col("y").isNotNull()
    counts = [F.count_if(F.col("y").isNull()).alias("only_first"), F.count_if(F.col("x").isNull()).alias("only_second")]
    counts += [F.count_if(present & ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))).alias(f"differs_{c}") for c in cols]
    return both.agg(F.count("*").alias("records"), *counts)


def check_routes(frames: DataFrame, owners: DataFrame) -> DataFrame:
    """verdict per frame: its BSSID's owner must be the sender."""
    joined = frames.join(owners, "bssid", "left")
    verdict = F.when(F.col("bssid").isNull(), "no_bssid").when(F.col("owner").isNull(), "no_owner").when(F.col("owner") != F.col("sniffer_id"), "wrong_sender").otherwise("ok")
    return joined.withColumn("verdict", verdict)
