"""Tables between the steps of an operator, in the shared folder that the session names for checkpoints.

A step is written as Parquet, so that lineage ends there and any executor can read it; the shuffle files of the job that
wrote it go as soon as it is written, and dropped() removes a step that the next one has taken in. What the returned
DataFrame still reads goes when the session's file system is closed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows from which a key counts as heavy, and the most heavy keys that a broadcast holds.
HEAVY_ROWS, HEAVY_KEYS = 1000, 10_000
#: Ids (8 bytes each) up to which a semi or anti join is broadcast instead of shuffling texts.
BROADCAST_IDS = 1_000_000

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session gets a folder of its own; a cluster gets an error, because executors don't share local folders."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each has ended."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def staged(df: DataFrame) -> DataFrame:
    """The rows, written as compressed Parquet and read again."""
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    with _clean_shuffles(spark):
        df.write.option("compression", "zstd").parquet(name)
    path, files = _path(spark, name)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(name)
    out.__dict__["_staged_at"] = name
    return out


def dropped(*steps: DataFrame) -> None:
    """Removes the files of staged tables that nothing reads any more."""
    for step in steps:
        path, files = _path(step.sparkSession, step.__dict__.pop("_staged_at"))
        files.delete(path, True)


def heavy_keys(df: DataFrame, keys: list[str], least: int = HEAVY_ROWS, most: int = HEAVY_KEYS) -> DataFrame:
    """(keys, rows) of the keys that hold `least` rows or more; if they are over `most`, of those with a share of 1 / `most` of all rows, which can't be more than `most`. Counts are partial before the shuffle."""
    found = staged(df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") >= least))
    if found.count() > most:
        found = found.where(F.col("rows") * most >= df.count())
    return found


def join_split(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has few rows for a key, where left may hold a large part of its rows under one key.

    Rows of heavy keys stay where they are and meet a broadcast of those keys' right rows (HEAVY_KEYS keys at most); the
    others are shuffled. The keys in left must not be null.
    """
    heavy = heavy_keys(left, keys) if heavy is None else heavy
    if heavy.isEmpty():
        return left.join(right, keys, how)
    only = F.broadcast(heavy.select(*keys))
    few = right.join(only, keys, "left_semi")
    met = left.join(only, keys, "left_semi").join(F.broadcast(few), keys, how)
    return met.unionByName(left.join(only, keys, "left_anti").join(right, keys, how))


def small_enough(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """ids with a hint to broadcast them if they are few; counted first."""
    return F.broadcast(ids) if ids.count() <= most else ids
