"""A training corpus from raw documents: five stages, each on all that the one before kept.

In every stage a null text is an empty text, columns beyond those of documents
are ignored, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolens.llm.common import Scratch
from aerolens.llm.line_dedup import line_dedup
from aerolens.llm.mixing import mix_sources
from aerolens.llm.near_dedup import near_duplicates
from aerolens.llm.packing import pack_documents
from aerolens.llm.queries import tokenizer_path
from aerolens.llm.toxicity import fit_toxicity, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5.

    Empty and null texts have the score of no terms. Rows without doc_id are
    scored too but teach nothing. Repeated rows stay or go together.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model, carry=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has.

    Every row stays; a text may end up empty, and a null text becomes empty.
    Rows of one doc_id are one document and lose nothing to each other. A row
    without doc_id is kept whole and takes no lines from others.
    """
    out = line_dedup(docs, carry=("lang", "source"))
    kept = F.col("kept_text")
    return out.select("doc_id", kept.alias("text"), "lang", "source", F.length(kept).cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Rows of that doc_id with a text of the group stay, repeated ones as often as
    they come. Empty texts are copies of nothing and stay, as do rows without
    doc_id.
    """
    verdicts = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id", "row_hash").distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("row_hash"))
    kept = rows.join(verdicts, ["doc_id", "row_hash"], "left_semi").select(*COLUMNS)
    return kept.unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, always whole.

    The last document of a source, which the mix takes in part, is taken once
    more if that brings the source nearer to its target, so a source is off by
    half a document at most. One that is not taken has no row. Documents without
    words are taken once. A null source is a source.
    """
    mixed = mix_sources(docs, carry=("text", "lang", "n_chars"))
    size, taken = F.col("size"), F.col("taken")
    times = F.when(size > 0, F.floor(taken / size) + (2 * (taken % size) >= size).cast("long")).otherwise(F.lit(1).cast("long"))
    copies = mixed.withColumn("times", times).filter("times > 0").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return copies.select("doc_id", "text", "lang", "source", "n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids; an empty or null text is its end id alone, repeated rows are packed each."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus; what a stage returns is written and read again by the next, and then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        work = Scratch(spark)
        docs = work.staged(stage(spark, docs, sf_dir), name)
        if before:
            before.clear()
        before = work
    # packing has its own copy of what it needs
    packed = STAGES[-1][1](spark, docs, sf_dir)
    before.clear()
    return packed


#: Learned scores, hashing and packing cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None
