"""Filters, routing and samples of frame streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclude_value(df: DataFrame, col: str, value, ignore_case: bool = False) -> DataFrame:
    """Rows whose column differs from value; rows without a value pass. Only the row side is lower-cased."""
    c = F.lower(col) if ignore_case else F.col(col)
    return df.filter(~c.eqNullSafe(F.lit(value)))


def mask_filter(df: DataFrame, col: str, *tests: tuple[int, int]) -> DataFrame:
    """Rows for which every (mask, value) holds on the byte."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(col).bitwiseAND(F.lit(m)) == v for m, v in tests]))


def min_length(df: DataFrame, col: str = "length", longest_dropped: int = 15) -> DataFrame:
    """Frames long enough to name a transmitter."""
    return df.filter(F.col(col) > longest_dropped)


def violations(rules: Mapping[str, str]) -> Column:
    """The names of the rules (SQL conditions) that a row breaks."""
    return F.array_compact(F.array(*(F.when(F.expr(broken), F.lit(name)) for name, broken in rules.items())))


def validate_frames(df: DataFrame, rules: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the rules they break)."""
    marked = df.withColumn("violations", violations(rules))
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


#: The shortest frames by type. A header of 24 bytes; data frames 6 more with four addresses and 2 more
#: with QoS; control frames by subtype. Types, subtypes and the version of the protocol that there are.
FRAME_RULES: dict[str, str] = {
    "no_length": "length is null or length < 2",
    "bad_version": "coalesce(version, 0) <> 0",
    "unknown_type": "not coalesce(ftype in (0, 1, 2), false)",
    "reserved_management": "ftype = 0 and fsubtype in (6, 7, 14, 15)",
    "reserved_control": "ftype = 1 and fsubtype < 8",
    "short_management": "ftype = 0 and length < 24",
    "short_data": "ftype = 2 and length < 24 + case when dir = 3 then 6 else 0 end + case when (fsubtype & 8) <> 0 then 2 else 0 end",
    "short_control": "ftype = 1 and fsubtype >= 8 and length < case when fsubtype in (12, 13) then 10 else 16 end",
}


#: Rules of decoded management frames (protected, tags, bad_ciphers) after those above. Fixed fields are
#: whole; the elements begin with name (0) and rates (1), or rates alone in responses to associations. Protected ones pass.
ELEMENT_RULES: dict[str, str] = {
    "short_fields": "ftype = 0 and not protected and length < 24 + case fsubtype when 0 then 4 when 1 then 6 when 2 then 10 when 3 then 6 when 5 then 12 when 8 then 12 when 10 then 2 when 11 then 4 when 12 then 2 else 0 end",
    "no_name": "ftype = 0 and not protected and fsubtype in (0, 2, 4, 5, 8) and coalesce(get(tags, 0), -1) <> 0",
    "no_rates": "ftype = 0 and not protected and (fsubtype in (0, 2, 4, 5, 8) and coalesce(get(tags, 1), -1) <> 1 or fsubtype in (1, 3) and coalesce(get(tags, 0), -1) <> 1)",
    "bad_ciphers": "ftype = 0 and not protected and coalesce(bad_ciphers, false)",
}


def route(df: DataFrame, rules: Sequence[tuple[str, Column]], default: str | None = None) -> DataFrame:
    """Rows with the name of the first rule that holds; without a default, rows that none matches are dropped."""
    if default is None and not rules:
        return df.limit(0)
    chosen = reduce(lambda c, r: c.when(r[1], F.lit(r[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0]))) if rules else F.lit(default)
    if rules and default is not None:
        chosen = chosen.otherwise(F.lit(default))
    out = df.withColumn("route", chosen)
    return out if default is not None else out.filter(F.col("route").isNotNull())


def http_requests(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(rows whose payload begins an HTTP request, the rest)."""
    is_request = F.coalesce(F.col(payload).rlike(r"^(GET|POST|HEAD|PUT|DELETE|OPTIONS|TRACE|CONNECT) \S+ HTTP/1"), F.lit(False))
    return df.filter(is_request), df.filter(~is_request)


def shared_filter(df: DataFrame, predicates: Sequence[Column | None]) -> DataFrame:
    """Rows that any query wants; a query without a filter wants everything."""
    if not predicates or any(p is None for p in predicates):
        return df
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in predicates]))


def select_taps(df: DataFrame, taps: Sequence[str], dupes: bool = False) -> DataFrame:
    """Rows of the chosen taps; duplicate merged frames only where asked for."""
    chosen = df.filter(F.col("tap").isin(*taps))
    return chosen if dupes else chosen.filter((F.col("tap") != "merged") | ~F.coalesce("is_dupe", F.lit(False)))


def split_first(df: DataFrame, n: int, order_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the first n rows in order, the rest); rows that tie are told apart by their other columns.

    Spark plans the first as a top-n, so no task sorts all. Rows equal in every
    column are alike: those beyond the n are counted and put back.
    """
    columns = [*order_by, *(c for c in df.columns if c not in order_by)]
    whole = F.struct(*columns)
    top = df.orderBy(*columns).limit(n)
    edge = top.agg(F.max(whole).alias("edge"), F.count("*").alias("n")).first()
    if not edge["n"]:
        return top, df
    at_edge = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, edge["edge"], strict=True)])
    after = F.lit(False)
    for c, v in reversed(list(zip(columns, edge["edge"], strict=True))):
        value = F.lit(v)
        greater = F.col(c).isNotNull() if v is None else F.coalesce(F.col(c) > value, F.lit(False))
        after = greater | (F.col(c).eqNullSafe(value) & after)
    rest = df.filter(after)
    spare = df.filter(at_edge).count() - top.filter(at_edge).count()
    if spare:
        row = top.filter(at_edge).limit(1)
        rest = rest.unionByName(df.sparkSession.range(spare).drop("id").crossJoin(F.broadcast(row)).select(*df.columns))
    return top, rest


def follow_learned(df: DataFrame, learn: Column, key: str = "bssid", also: str | None = "ta", ts: str = "ts", order: str = "frame_id") -> tuple[DataFrame, DataFrame]:
    """(frames of learned keys from the learning frame on, the rest).

    A key is learned by the first frame for which `learn` holds; a frame is
    looked up by its key, else by `also`.
    """
    learned = df.filter(learn).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(ts, order)).alias("_from"))
    look = F.coalesce(F.col(key), F.col(also)) if also else F.col(key)
    marked = df.withColumn("_look", look).join(learned, F.col("_look") == F.col("_key"), "left")
    follows = F.coalesce(F.struct(ts, order) >= F.col("_from"), F.lit(False))
    drop = ("_look", "_key", "_from")
    return marked.filter(follows).drop(*drop), marked.filter(~follows).drop(*drop)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row of each key: what a filter on unseen values passes."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def random_drop(df: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """Drop about so large a share of the rows."""
    return df.sample(1 - share, seed)
