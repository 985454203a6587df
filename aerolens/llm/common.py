"""Pieces shared by the text operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def give_back() -> None:
    """What this worker's allocators keep for later goes back to the system: a worker lives on from job to job, beside other work."""
    pa.default_memory_pool().release_unused()
    # in the C library of most Linux systems, and nowhere else
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, as in tests, a local session gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-aerolens-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """A folder for the staged tables of one piece of work, emptied when nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark)}/aerolens-{uuid.uuid4().hex}"
        self.used = False

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        self.used = True
        return _written(df, f"{self.folder}/{name}-{uuid.uuid4().hex}")

    def clear(self) -> None:
        """Delete all tables: an empty one takes the place of the folder."""
        if self.used:
            self.spark.createDataFrame([], "gone int").coalesce(1).write.mode("overwrite").parquet(self.folder)


#: Spark setting: drop a query's shuffle files when it ends, not when the driver happens to collect garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    A lost executor then costs the tasks it ran, not the work before them, and the
    shuffle files of the work before go at once. Tables that a lazy result reads
    are staged here, until clear_staged; those that end with the work, in its
    Scratch.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/aerolens-{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return _written(df, path)


#: Tables that results of an application read.
_STAGED: dict[str, list[str]] = {}


def clear_staged(spark: SparkSession) -> int:
    """Empty the tables that this application's earlier results read, once these results are written or not needed; how many."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        spark.createDataFrame([], "gone int").coalesce(1).write.mode("overwrite").parquet(path)
    return len(paths)
