"""Materialized tables (SRC-12, SRC-13) and lineage cuts in the shared checkpoint folder.

``materialize(df, name, config)`` writes ``<root>/<name>_<hash>`` where the
hash is md5 of the canonical JSON of ``config`` (first 8 hex digits); a
``_SUCCESS`` marker makes ``exists`` true only for complete writes, so a
step that died half-way is recomputed, never half-read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from parcel.session import ensure_checkpoint_dir, store_root


def config_key(config: dict | None) -> str:
    """md5 of the canonical (sorted-key, compact) JSON of a config, 8 hex digits."""
    text = json.dumps(config or {}, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.md5(text.encode("utf-8")).hexdigest()[:8]


def _path(spark: SparkSession, name: str, config: dict | None, root: str | None) -> str:
    return f"{(root or store_root(spark)).rstrip('/')}/{name}_{config_key(config)}"


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def exists(spark: SparkSession, name: str, config: dict | None = None,
           root: str | None = None) -> bool:
    """True when a complete materialization of (name, config) exists."""
    return _fs_exists(spark, _path(spark, name, config, root) + "/_SUCCESS")


def save(df: DataFrame, name: str, config: dict | None = None, root: str | None = None,
         partition_by: list[str] | None = None) -> str:
    """Write (overwrite) the materialization; returns its path."""
    path = _path(df.sparkSession, name, config, root)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def load(spark: SparkSession, name: str, config: dict | None = None,
         root: str | None = None) -> DataFrame:
    return spark.read.parquet(_path(spark, name, config, root))


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder (recursive); False when there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.delete(p, True))


def clear(spark: SparkSession, name: str, config: dict | None = None,
          root: str | None = None) -> bool:
    """Delete one materialization (recursive)."""
    return delete(spark, _path(spark, name, config, root))


def materialize(df: DataFrame, name: str, config: dict | None = None,
                root: str | None = None) -> DataFrame:
    """SRC-12: write then read back (lineage cut)."""
    save(df, name, config, root)
    return load(df.sparkSession, name, config, root)


def cached_step(spark: SparkSession, name: str, config: dict | None,
                build: Callable[[], DataFrame], use_cache: bool = True,
                root: str | None = None) -> DataFrame:
    """SRC-13: reuse a step's materialized output when (name, config) exists;
    otherwise build, materialize and return it. ``use_cache=False`` always rebuilds."""
    if use_cache and exists(spark, name, config, root):
        return load(spark, name, config, root)
    return materialize(build(), name, config, root)


def scratch_path(spark: SparkSession, kind: str = "parcel_scratch") -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def scratch_table(df: DataFrame) -> DataFrame:
    """Anonymous lineage cut: a Parquet table under the shared checkpoint folder."""
    path = scratch_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def scratch(df: DataFrame) -> Iterator[DataFrame]:
    """``scratch_table`` for jobs that end inside the block; the files go with it."""
    path = scratch_path(df.sparkSession)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.parquet(path)
    finally:
        delete(df.sparkSession, path)
