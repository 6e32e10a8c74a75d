"""Readers for the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")
# Fixed-size dimensions: never worth spreading out.
TINY = {"region", "nation"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One table as a lazily scanned parquet relation (pruning and pushdown apply).

    ``spread``: input-parallelism floor for plans with heavy per-row work
    (string building, parsing, HTML). A file written as one row group scans
    as one task no matter its size; when a scan yields fewer partitions than
    the cluster's default parallelism it is spread round-robin so the per-row
    work uses every core. Cheap scans (aggregations) skip it: the extra
    exchange costs more than it saves. On large inputs the scan already has
    far more splits than cores and nothing is added either way.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread and name not in TINY:
        target = spark.sparkContext.defaultParallelism
        if target > 1 and df.rdd.getNumPartitions() < target:
            df = df.repartition(target)
    return df
