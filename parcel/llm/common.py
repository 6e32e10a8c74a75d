"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcel.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text): extra columns of any name are left behind; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that when every character is one byte."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower()))


_KEPT: dict = {}


def worker_cache(key, build):
    """An object that outlives a task in its Python worker. There is one at a time: the object
    of another operator or model is let go first, so stages that share workers do not add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession):
    """Shuffle files of frames made and run inside go when their job ends. For results that are
    stored: nothing reads those files again, and Spark would else keep them until the driver's next
    collection. (A frame takes the setting when it is made, hence the ``select`` below.)"""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder (reliable, never local). Spark removes
    the files once nothing refers to the frame any more. Go on with the result, not with ``df``:
    the shuffles behind ``df`` are gone."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint()


def number_rows(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` plus a row number in column ``name``, written once in the shared checkpoint folder.
    The number is stored with its row, so every later scan finds the same one, whatever partitions
    it is planned in. Types that Parquet does not hold go to a checkpoint, which is larger."""
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    if any(re.search("void|interval|variant", kind) for _, kind in docs.dtypes):
        return cut(rows)
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/numbered/{uuid.uuid4().hex}"
    with shuffles_released(docs.sparkSession):
        rows.select("*").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)
