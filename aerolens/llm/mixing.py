"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every step is a built-in DataFrame function. Targets come from one aggregate per
source; the sample comes from a seeded order of each source's documents, cut at
the target by two rounds of prefix sums, so no source is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, staged


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """source, source_size -> also target, whole (repetitions), part (words of one more).

    Sources in code-point order, null last, take the weights in turn and share
    `share` times all words; none exceeds max_epochs times its own size and the
    excess goes to the others by weight until none is above. Sorted by cap over
    weight the capped sources are a prefix, so one pass of running sums finds
    the level. One row a source goes through one task here, nothing else does;
    that suits names of sources, up to some millions, not a column such as a
    url host.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    level = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    return (
        totals.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(level), zero))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(level), zero))
        .withColumn("capped", F.col("ratio") <= F.col("left") / F.col("open"))
        .withColumn("left", F.max(F.when(~F.col("capped"), F.struct(F.col("open"), F.col("left")))).over(whole)["left"])
        .withColumn("open", F.max(F.when(~F.col("capped"), F.col("open"))).over(whole))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("left") / F.col("open")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long")))
        .withColumn("part", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
        .select("source", "source_size", "target", "whole", "part")
    )


def mix_sources(docs: DataFrame, *, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """Words that the mix takes of each document.

    Returns doc_id, source, size, source_size, target, taken and the carried
    columns. Each source repeats all its documents `whole` times; of one more
    repetition it takes documents in the order of md5(seed, doc_id), whole ones
    until the target is reached and the last in part, so a source's sum is its
    target to the word. Null text: size 0. Null sources are one source, the
    last. Equal documents (ties, repeated rows) are interchangeable; where the
    doc_id is null the text takes its place in the order. Only rows of one
    doc_id, or of one text without id, must share a cell of the order, and only
    the cell in which a source's words run out is sorted, by one task a source.
    No documents: no rows.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    order = F.md5(F.concat(F.lit(f"{seed}:"), name))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = staged(docs.select("doc_id", "source", size.alias("size"), order.alias("nth"), F.struct(*carry).alias("carried") if carry else F.lit(None).cast("int").alias("carried")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    work = Scratch(docs.sparkSession)
    targets = work.staged(targets, "targets")

    def boundary(cells: DataFrame, cell: str, left: str) -> DataFrame:
        """source and the cell in which the words left run out, with the words left for it."""
        running = Window.partitionBy("source").orderBy(cell)
        return (
            cells.withColumn("upto", F.sum("words").over(running))
            .filter((F.col(left) > F.col("upto") - F.col("words")) & (F.col(left) <= F.col("upto")))
            .select("source", F.col(cell), (F.col(left) - F.col("upto") + F.col("words")).alias(f"left_{cell}"))
        )

    first, second = F.substring("nth", 1, 3), F.substring("nth", 4, 3)
    sums = rows.groupBy("source", first.alias("c1")).agg(F.sum("size").alias("words"))
    cut1 = boundary(_with(sums, targets.select("source", "part")), "c1", "part")
    inside = _with(rows.select("source", "size", first.alias("c"), second.alias("c2")), cut1).filter("c = c1")
    sums = inside.groupBy("source", "c2", "left_c1").agg(F.sum("size").alias("words"))
    cut2 = boundary(sums, "c2", "left_c1")
    cuts = staged(_with(_with(targets, cut1), cut2), "cuts")
    work.clear()

    all_rows = _with(rows, cuts).withColumns({"a": first, "b": second})
    # no boundary: the part is 0 and nothing more is taken
    in_cell = F.coalesce((F.col("a") == F.col("c1")) & (F.col("b") == F.col("c2")), F.lit(False))
    before = F.coalesce((F.col("a") < F.col("c1")) | ((F.col("a") == F.col("c1")) & (F.col("b") < F.col("c2"))), F.lit(False))
    outside = all_rows.filter(~in_cell).withColumn("extra", F.when(before, F.col("size")).otherwise(F.lit(0).cast("long")))
    running = Window.partitionBy("source").orderBy("nth", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    cell = (
        all_rows.filter(in_cell)
        .withColumn("upto", F.sum("size").over(running))
        .withColumn("extra", F.least("size", F.greatest(F.lit(0).cast("long"), F.col("left_c2") - F.col("upto") + F.col("size"))))
        .drop("upto")
    )
    taken = F.col("whole") * F.col("size") + F.col("extra")
    return outside.unionByName(cell).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *(F.col(f"carried.{c}").alias(c) for c in carry if c not in ("doc_id", "source")))


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on source, null matching null; right has a row a source."""
    other = right.withColumnRenamed("source", "_source")
    return left.join(other, left["source"].eqNullSafe(other["_source"]), "left").drop("_source")
