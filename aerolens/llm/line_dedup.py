"""Line dedup: the first document with a line keeps it, all later ones lose it.

Every step is a built-in DataFrame function. Lines travel as 128-bit hashes of
their keys with document and position. They are range-partitioned by hash and
sorted by hash, document and position; the stream of a hash begins with its first
document, and every line of a later one is marked. What comes back for a document
is a compressed bitmap of the lines it keeps, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch, lower_ascii, staged


def split_lines(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id, row_hash, pos of every line whose key is long enough; row_hash is xxhash64 of the text."""
    key = lower_ascii(F.btrim(F.col("line"), F.lit(SPACES)))
    return (
        docs.filter("doc_id is not null")
        .select("doc_id", F.xxhash64("text").alias("row_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "row_hash", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "row_hash", "pos")
    )


def later_lines(lines: DataFrame, work: Scratch, salts: int = 64) -> DataFrame:
    """doc_id, row_hash, pos of each line that a document with a smaller id holds too.

    A hash with more than a quarter of a partition's fair share of rows is hot;
    there are at most four a partition, so they fit a broadcast. The rows of a
    hot hash are salted by document into several streams, so none of them knows
    the first document; it is aggregated apart, one row a hot hash.
    """
    fair = max(1, lines.count() // (4 * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") > max(fair, salts)).select("h1", "h2", F.lit(True).alias("hot"))
    hot = work.staged(hot, "hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    salted = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", salt)
    ranged = salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id", "pos")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranged.select("h1", "h2", "doc_id", "row_hash", "pos", "hot", F.first("doc_id").over(stream).alias("first_doc"))
    heads = lines.join(F.broadcast(hot), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("doc_id").alias("hot_doc"))
    first = F.coalesce("hot_doc", "first_doc")
    return seen.join(F.broadcast(heads), ["h1", "h2"], "left").filter(F.col("doc_id") > first).select("doc_id", "row_hash", "pos")


def line_keep_bitmaps(docs: DataFrame, *, min_chars: int = 10, salts: int = 64) -> DataFrame:
    """doc_id, row_hash, bitmap of the lines that a document keeps.

    bitmap maps words to 64 bits: bit p % 64 of word p div 64 is set where line
    p stays. Words of which all lines stay are left out, and documents that lose
    nothing have no row.
    """
    work = Scratch(docs.sparkSession)
    lines = work.staged(line_hashes(docs, min_chars), "lines")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("cast(pos % 64 as int)"))
    words = later_lines(lines, work, salts).groupBy("doc_id", "row_hash", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    bitmaps = staged(words.groupBy("doc_id", "row_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bitmap")), "bitmaps")
    work.clear()
    return bitmaps


def line_dedup(docs: DataFrame, *, min_chars: int = 10, salts: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """Whole texts without the lines that an earlier document holds.

    A line's key is the line stripped of ASCII white space at both ends, A-Z
    lower-cased. Keys of at least min_chars code points found in two or more
    documents stay only in the smallest doc_id that holds them, there in every
    place; all other lines stay.

    Returns doc_id, n_lines, n_dropped, kept_text, bitmap and the carried
    columns for every row. A null or empty text is one empty line. Repeated rows
    of a doc_id count as one document, each row judged by its own lines. A row
    without doc_id is no document: it is kept whole and starts nothing.
    """
    bitmaps = line_keep_bitmaps(docs, min_chars=min_chars, salts=salts)
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text", F.struct(*carry).alias("carried") if carry else F.lit(None).cast("int").alias("carried"))
    lines = split_lines(F.col("text"))
    every = F.lit(-1).cast("long")
    dense = F.when(
        F.col("bitmap").isNotNull(),
        F.transform(F.sequence(F.lit(0), F.expr("cast((n_lines - 1) div 64 as int)")), lambda w: F.coalesce(F.element_at("bitmap", w), every)),
    )
    bit = lambda i: F.call_function("shiftright", F.get("dense", (i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1))
    kept = F.when(F.col("dense").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda line, i: bit(i) == 1), "\n"))
    dropped = F.coalesce(F.aggregate("dense", F.lit(0).cast("long"), lambda n, w: n + 64 - F.bit_count(w)), F.lit(0).cast("long"))
    out = (
        rows.join(bitmaps, ["doc_id", "row_hash"], "left")
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("dense", dense)
        .select("doc_id", "n_lines", dropped.alias("n_dropped"), kept.alias("kept_text"), "bitmap", "carried")
    )
    return out.select("doc_id", "n_lines", "n_dropped", "kept_text", "bitmap", *(F.col(f"carried.{c}").alias(c) for c in carry))
