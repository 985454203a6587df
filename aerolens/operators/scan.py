"""Segmented scans: running values of a key, slice of time by slice of time.

A window over a whole key is one task, however hot the key. A scan cuts keys into
slices of time. One row a slice sums it up, a window over these few rows says what
came before each slice, and that goes as one row more at the head of the slice; so
each slice is scanned on its own and a hot key is many sorted runs. It works for
all values that combine associatively: the last, first, largest, smallest, sum
and union of bits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMBINE = {"last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True), "max": F.max, "min": F.min, "sum": F.sum, "or": F.bit_or}


@dataclass(frozen=True)
class Scan:
    """A running value: kind (last, first, max, min, sum, or) of what is not null in the rows before, with the row itself if inclusive.

    by are columns that part a key further.
    """

    kind: str
    value: Column
    by: tuple[str, ...] = ()
    inclusive: bool = False

    def of_slice(self, name: str, order: Sequence[str], reverse: bool) -> Column:
        place = F.when(F.col(name).isNotNull(), F.struct(*order))
        if self.kind in ("last", "first"):
            return (F.max_by if (self.kind == "last") != reverse else F.min_by)(name, place)
        return _COMBINE[self.kind](name)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Scan], ts_us: Column | str, slice_seconds: float | None = None, reverse: bool = False) -> DataFrame:
    """Adds the columns; order must be total within a key, so that reruns agree. reverse scans from the last row to the first.

    With slice_seconds df is read twice, once for the sums of slices, which are
    one row a key and slice (and `by`). Null keys are a key.
    """
    along = [F.desc(c) if reverse else F.asc(c) for c in order]
    value = {name: f"_v_{name}" for name in columns}
    rows = df.withColumns({value[n]: s.value for n, s in columns.items()})
    run, own = list(keys), F.lit(True)
    if slice_seconds is not None:
        run = [*keys, "_slice"]
        us = F.col(ts_us) if isinstance(ts_us, str) else ts_us
        rows = rows.withColumn("_slice", F.floor(us / int(slice_seconds * 1_000_000)))
    rows = rows.withColumn("_own", own)
    both = rows
    if slice_seconds is not None:
        for by in dict.fromkeys(s.by for s in columns.values()):
            group = {n: s for n, s in columns.items() if s.by == by}
            sums = rows.groupBy(*run, *by).agg(*(s.of_slice(value[n], order, reverse).alias(value[n]) for n, s in group.items()))
            before = Window.partitionBy(*keys, *by).orderBy(F.desc("_slice") if reverse else F.asc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
            carried = sums.select(*run, *by, *(_COMBINE[s.kind](value[n]).over(before).alias(value[n]) for n, s in group.items()))
            some = reduce(lambda a, b: a | b, (F.col(value[n]).isNotNull() for n in group))
            both = both.unionByName(carried.filter(some).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    out = {}
    for n, s in columns.items():
        w = Window.partitionBy(*run, *s.by).orderBy("_own", *along).rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        out[n] = _COMBINE[s.kind](value[n]).over(w)
    return both.withColumns(out).filter("_own").select(*df.columns, *columns)


def by_heat(df: DataFrame, keys: Sequence[str], hot_rows: int | None, run: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """run(rows, sliced) over the rows of ordinary keys as they are, and over those of keys with more than hot_rows in slices.

    Counting the keys is one pass with map-side sums; hot keys are few, and a
    table without them is run at once. None slices nothing.
    """
    if hot_rows is None:
        return run(df, False)
    keyed = df.withColumn("_key", F.struct(*keys))
    hot = keyed.groupBy("_key").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows).select("_key")
    if hot.isEmpty():
        return run(df, False)
    return run(keyed.join(hot, "_key", "left_anti").drop("_key"), False).unionByName(run(keyed.join(hot, "_key", "left_semi").drop("_key"), True))
