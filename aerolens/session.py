"""Session and table helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_session(app: str = "aerolens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; conf overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; times without zone become TIMESTAMP, as watermarks need it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(zoneless) if zoneless else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, as in tests, a local session gets a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-aerolens-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint of df in the shared folder, so that loops do not repeat earlier rounds."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back, for what several later steps read, until clear_staged."""
    path = f"{shared_dir(df.sparkSession)}/aerolens-{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that results of an application read.
_STAGED: dict[str, list[str]] = {}


def clear_staged(spark: SparkSession) -> int:
    """Empty the tables that this application's earlier results read, once these results are written or not needed; how many."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        spark.createDataFrame([], "gone int").coalesce(1).write.mode("overwrite").parquet(path)
    return len(paths)
