"""Session helpers: one place that knows the configuration the operators assume."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "parcel",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return (or create) a session with the settings the library relies on.

    On a cluster the master, memory and checkpoint folder come from the
    submitting environment; only AQE and the session time zone are forced.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Profiles fold many aggregates into one pass; keep them in whole-stage
        # codegen (the default of 100 buffer fields turns it off for ~20 corr()).
        .config("spark.sql.codegen.maxFields", "1000")
        .config("spark.sql.codegen.hugeMethodLimit", SESSION_DEFAULTS["spark.sql.codegen.hugeMethodLimit"])
    )
    if master and master.startswith("local"):
        builder = (
            builder
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
            .config("spark.driver.memory", os.environ.get("PARCEL_DRIVER_MEMORY", "16g"))
        )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _size_cluster_shuffles(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    The cluster names it in ``spark.checkpoint.dir``; a local folder is only
    created when nothing is configured (local tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="parcel-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can
    import it wherever the driver was started from."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="parcel-package-")
    path = os.path.join(folder, "parcel_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _SHIPPED[sc.applicationId] = path


def store_root(spark: SparkSession) -> str:
    """Root folder for materialized tables: next to the shared checkpoint folder."""
    base = spark.conf.get("parcel.store.root", None)
    if base:
        return base
    ckpt = ensure_checkpoint_dir(spark)
    return ckpt.rstrip("/") + "/parcel_store"


# SQL settings the operators rely on for speed (not for correctness); applied to any
# session handed to the catalogue unless the user set them explicitly.
SESSION_DEFAULTS = {
    "spark.sql.codegen.maxFields": "1000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles a method of more than 8000 bytes: a wide projection fused into one
    # would be interpreted row by row. Such a stage is generated as many small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Cluster shuffle sizing: AQE starts from many partitions and coalesces them to the
# advisory size, so a 100 TB join does not land in Spark's default 200 reducers
# (AQE can merge small partitions but not split large ones, skew aside).
CLUSTER_MIN_SHUFFLE_PARTITIONS = 2048
CLUSTER_PARTITIONS_PER_CORE = 4
ADVISORY_PARTITION_BYTES = "256m"


def _size_cluster_shuffles(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        return
    if spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None):
        return
    if spark.conf.get("spark.sql.shuffle.partitions", "200") != "200":
        return  # sized by the user
    n = max(CLUSTER_MIN_SHUFFLE_PARTITIONS, CLUSTER_PARTITIONS_PER_CORE * sc.defaultParallelism)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    advisory = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    if advisory in (None, "64MB", "64m", "67108864", "67108864b"):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", ADVISORY_PARTITION_BYTES)


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``SESSION_DEFAULTS`` where still at Spark's default; size cluster shuffles;
    ensure a checkpoint dir."""
    builtin = {"spark.sql.codegen.maxFields": "100", "spark.sql.codegen.hugeMethodLimit": "65535"}
    for key, value in SESSION_DEFAULTS.items():
        current = spark.conf.get(key, None)
        if current is None or current == builtin.get(key):
            spark.conf.set(key, value)
    _size_cluster_shuffles(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark
