"""Run ledger (RL-*) and run-ranking windows (WN-2, WN-4..6).

The ledger is an append-only Parquet table
``runs(run_id, run_name, family, start_time, status, params map, metrics map)``;
ranking is ``min_by`` / ``max_by`` (one aggregation, no global sort).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that must match the reference's results.
LOGGED_PREFIXES = ["train_", "val_", "test_"]
SKIPPED_SUFFIX = "_trans"


def logged_metrics(metrics: Column) -> Column:
    """RL-1: keep ``train_/val_/test_`` metrics, drop ``*_trans`` ones."""
    keep = None
    for p in LOGGED_PREFIXES:
        keep = (lambda k, p=p: k.startswith(p)) if keep is None else \
            (lambda k, p=p, prev=keep: prev(k) | k.startswith(p))
    return F.map_filter(metrics, lambda k, v: keep(k) & ~k.endswith(SKIPPED_SUFFIX))


def append_runs(runs: DataFrame, path: str) -> None:
    """RL-1: append runs to the Parquet ledger (one file set per append)."""
    runs.write.mode("append").parquet(path)


def leaderboard(runs: DataFrame, metric: str = "test_rmse", status: str = "FINISHED",
                since=None, top: int | None = None) -> DataFrame:
    """RL-2 / WN-6: finished runs since a time, ordered by a metric (top-k report)."""
    df = runs.where(F.col("status") == status)
    if since is not None:
        df = df.where(F.col("start_time") >= F.lit(since).cast("timestamp"))
    df = df.withColumn(metric, F.col("metrics")[metric])
    ordered = df.orderBy(F.col(metric).asc_nulls_last(), F.col("run_id"))
    return ordered.limit(top) if top else ordered


def best_run(runs: DataFrame, metric: str = "test_rmse", name_contains: str | None = None
             ) -> DataFrame:
    """RL-3 / WN-4: best run by a metric (ties -> smallest run_id), optional name filter."""
    df = runs
    if name_contains:
        df = df.where(F.lower("run_name").contains(name_contains.lower()))
    m = F.col("metrics")[metric]
    df = df.where(m.isNotNull())
    key = F.struct(m.alias("m"), F.col("run_id").alias("id"))
    return df.agg(F.min_by(F.struct(*[F.col(c) for c in ("run_id", "run_name")]), key)
                  .alias("b"), F.min(key).alias("k")).select(
        "b.run_id", "b.run_name", F.col("k.m").alias(metric))


def latest_run(runs: DataFrame, status: str = "FINISHED") -> DataFrame:
    """WN-5: most recent run with a status (ties -> largest run_id)."""
    key = F.struct(F.col("start_time").alias("t"), F.col("run_id").alias("id"))
    return (runs.where(F.col("status") == status)
            .agg(F.max_by(F.struct("run_id", "run_name", "start_time"), key).alias("b"))
            .select("b.*"))


def known_family(name: Column) -> Column:
    """Whether the run name tells a model family."""
    n = F.lower(name)
    return n.contains("xgb") | n.contains("rf")


def family_flags(runs: DataFrame) -> DataFrame:
    """RL-4: model family / log target / extended features from the run name. A name that tells
    no family stops the job: such a run cannot be retrained."""
    n = F.lower("run_name")
    family = (F.when(n.contains("xgb"), "xgboost").when(n.contains("rf"), "random_forest")
              .otherwise(F.raise_error(F.concat(F.lit("no model family in run name: "),
                                                F.coalesce("run_name", F.lit("null"))))))
    return runs.withColumns({"family": family, "log_target": n.contains("log"),
                             "extended": n.contains("feature_eng")})


def compare(runs: DataFrame, models: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """RL-5: metric x model table (pivot over a fixed model list: no extra job)."""
    long = runs.select("run_name", F.explode(
        F.map_filter("metrics", lambda k, v: k.isin(*metrics))).alias("metric", "value"))
    return long.groupBy("metric").pivot("run_name", list(models)).agg(F.avg("value"))


def best_so_far(trials: DataFrame, value: str, order, study: str | None = None) -> Column:
    """WN-2: running minimum of the objective over trial order (within a study).

    Window form, for studies of bounded size (a search has a trial budget).
    ``ordered.running_min`` is the form for groups of any size.
    """
    order = [order] if isinstance(order, str) else list(order)
    w = Window.orderBy(*order) if study is None else Window.partitionBy(study).orderBy(*order)
    return F.min(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
