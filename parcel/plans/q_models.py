"""Catalogue: metrics, residuals, folds/OOF, contributions, trials and the run ledger.

Predictions here are a fixed formula (the order total predicted from its
line items), so every metric has an exact SQL oracle; fitted estimators
live in ``q_ml`` with rows-only checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcel.functions import parse as P
from parcel.operators import fit as FIT
from parcel.operators import folds as FO
from parcel.operators import metrics as M
from parcel.operators import runs as RL
from parcel.operators import split as SP
from parcel.operators import study as ST
from parcel.operators.ordered import SLICE_ROWS, running_min
from parcel.plans.common import r6
from parcel.sources.tables import table

HASH = ("(CAST(('0x' || substr(md5(CAST({k} AS VARCHAR) || ':42'), 1, 8)) AS BIGINT)"
        " / 4294967296.0)")
FEATS = ["revenue", "n_items", "sum_qty", "avg_discount"]


def order_features(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: target (total price), line-item features, formula prediction, split, fold.

    lineitem is pre-aggregated per order (partial aggregation) before the
    join, so the join moves one row per order, not one per line item.
    """
    li = (table(spark, sf, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
               .alias("revenue"),
               F.count(F.lit(1)).cast("double").alias("n_items"),
               F.sum("l_quantity").alias("sum_qty"),
               F.avg("l_discount").alias("avg_discount")))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"))
    j = o.join(li, o.o_orderkey == li.l_orderkey).drop("l_orderkey")
    return (j.withColumn("yhat", F.col("revenue"))
            .withColumn("split", SP.split_column("o_orderkey", 0.2, 0.1))
            .withColumn("fold", SP.fold_column("o_orderkey", 5)))


def _round(df: DataFrame, cols, n=6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) for c in cols})


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """ML-4 / ML-5: RMSE, MAE, R², MAPE per split in one pass."""
    m = M.evaluate(order_features(spark, sf), "y", "yhat", "split")
    return _round(m, ["rmse", "mae", "r2", "mape"])


def log_target_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """ML-7: metrics after the inverse transform of a log1p-scale target and prediction."""
    df = order_features(spark, sf).withColumns({"ly": F.log1p("y"), "lp": F.log1p("yhat")})
    m = M.evaluate(df, "ly", "lp", "split", inverse=F.expm1)
    return _round(m, ["rmse", "mae", "r2", "mape"])


def huber_loss(spark: SparkSession, sf: str) -> DataFrame:
    """ML-6: Huber loss (delta = 1000) per split."""
    m = M.evaluate(order_features(spark, sf), "y", "yhat", "split",
                   metrics={"huber": M.huber(1000.0)})
    return _round(m, ["huber"], 2)


def user_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """UD-2: a user metric registry ``{name: (y, yhat) -> aggregate}``."""
    reg = {"rmse": M.rmse, "max_error": lambda y, p: F.max(F.abs(y - p)),
           "bias": lambda y, p: F.avg(p - y)}
    m = M.evaluate(order_features(spark, sf), "y", "yhat", "split", metrics=reg)
    return _round(m, list(reg))


def residual_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AG-15: min / max / median / mean / population std of residuals."""
    df = order_features(spark, sf).withColumn("e", F.col("y") - F.col("yhat"))
    med = FIT.exact_quantiles(df, "e", [0.5])[0]
    return df.agg(r6(F.min("e")).alias("min"), r6(F.max("e")).alias("max"),
                  r6(F.lit(med)).alias("median"), r6(F.avg("e")).alias("mean"),
                  r6(F.stddev_pop("e")).alias("std"))


def extreme_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """OD-5: |e| >= p95(|e|) flag; flagged count and their mean |e|."""
    df = order_features(spark, sf).withColumn("ae", F.abs(F.col("y") - F.col("yhat")))
    t = FIT.exact_quantiles(df, "ae", [0.95])[0]
    flag = F.col("ae") >= F.lit(t)
    return df.agg(r6(F.lit(t)).alias("threshold"), F.count_if(flag).alias("n_extreme"),
                  r6(F.avg(F.when(flag, F.col("ae")))).alias("mean_abs_extreme"))


def top_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """WN-3: the 5 largest absolute residuals (top-k report; ties by key)."""
    df = order_features(spark, sf).withColumn("abs_error", F.abs(F.col("y") - F.col("yhat")))
    return (df.orderBy(F.desc("abs_error"), F.asc("o_orderkey")).limit(5)
            .select("o_orderkey", r6("abs_error").alias("abs_error")))


def union_splits(spark: SparkSession, sf: str) -> DataFrame:
    """ST-1: train and val unioned by name (retrain set), summarised per source split."""
    df = order_features(spark, sf)
    tv = (df.where(F.col("split") == "train").unionByName(df.where(F.col("split") == "val")))
    return tv.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                   F.round(F.sum("y"), 2).alias("sum_y"))


def oof_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """SP-4: out-of-fold predictions of the fold-mean model, one row per key."""
    df = order_features(spark, sf).select("o_orderkey", "y", "fold")
    stats, _ = FO.moments(df, ["y"], "fold")
    means = by_fold({f: FO.others(stats["y"], f, FO.Moments()).mean for f in range(5)})
    return df.select("o_orderkey", "fold", r6(means).alias("oof_pred"))


def by_fold(values: dict) -> Column:
    """A number per fold as a column over ``fold``."""
    return F.element_at(F.create_map(*[F.lit(x) for f, v in values.items() for x in (f, v)]), F.col("fold"))


def fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """ML-11 / AG-16 / ST-3: per-fold RMSE of the formula model, then mean and std."""
    per = M.evaluate(order_features(spark, sf), "y", "yhat", "fold", metrics={"rmse": M.rmse})
    long = per.select(F.lit("rmse").alias("metric"), F.col("rmse").alias("value"))
    return long.groupBy("metric").agg(r6(F.avg("value")).alias("mean"),
                                      r6(F.stddev("value")).alias("std"))


def _per_fold_corr(spark: SparkSession, sf: str) -> DataFrame:
    pairs = FO.comoments(order_features(spark, sf), FEATS, "y", "fold")
    rows = [(f, c, FO.others(pairs[c], f, FO.CoMoments()).corr) for f in range(5) for c in FEATS]
    return spark.createDataFrame(rows, "cv_fold int, feature string, r double").select(
        "cv_fold", "feature", F.abs("r").alias("importance"))


def importance_mean(spark: SparkSession, sf: str) -> DataFrame:
    """ML-14 / AG-17: per-fold importances, mean over folds; a feature absent in a fold is 0."""
    imp = _per_fold_corr(spark, sf)
    return imp.groupBy("feature").agg(r6(F.sum("importance") / F.lit(5.0)).alias("importance"))


def linear_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """ML-15 / AG-18: phi = beta * (x - mean x) with beta fitted on the training folds;
    mean |phi| per fold on held-out rows, then averaged across folds."""
    df = order_features(spark, sf)
    pairs = FO.comoments(df, FEATS, "y", "fold")
    fits = {c: {f: FO.others(pairs[c], f, FO.CoMoments()) for f in range(5)} for c in FEATS}
    phi = df.select("fold", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), (
        by_fold({f: m.slope for f, m in fits[c].items()}) * (F.col(c) - by_fold({f: m.mx for f, m in fits[c].items()}))
    ).alias("phi")) for c in FEATS])))
    per_fold = phi.groupBy("fold", "feature").agg(F.avg(F.abs("phi")).alias("m"))
    return per_fold.groupBy("feature").agg(r6(F.avg("m")).alias("mean_abs_contribution"))


def contribution_eur(spark: SparkSession, sf: str) -> DataFrame:
    """AG-19: contribution in money for a log-target linear model:
    expm1(pred + phi) - expm1(pred), mean absolute value per feature."""
    df = order_features(spark, sf).withColumns({"ly": F.log1p("y"), "pred": F.log1p("yhat")})
    st = df.agg(*[F.regr_slope(F.col("ly"), F.col(f)).alias(f"b_{f}") for f in FEATS],
                *[F.avg(f).alias(f"m_{f}") for f in FEATS]).first()
    phi = df.select("pred", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 (F.lit(st[f"b_{f}"]) * (F.col(f) - F.lit(st[f"m_{f}"]))).alias("phi"))
        for f in FEATS])))
    eur = F.expm1(F.col("pred") + F.col("phi")) - F.expm1("pred")
    return phi.groupBy("feature").agg(F.round(F.avg(F.abs(eur)), 4).alias("mean_abs_eur"))


# ---------------------------------------------------------------------------- trials
SPACE = {"max_depth": {"type": "int", "low": 3, "high": 10},
         "subsample": {"type": "float", "low": 0.5, "high": 1.0},
         "eta": {"type": "float", "low": 0.01, "high": 0.3, "log": True},
         "booster": {"type": "categorical", "choices": ["gbtree", "dart"]}}


def trial_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """ML-8: one parameter draw per trial (trial ids = event ids), hash-uniform per name."""
    ev = table(spark, sf, "events").select("event_id")
    draws = ST.sampled(SPACE, F.col("event_id"))
    return ev.select("event_id", *[(r6(c) if SPACE[n]["type"] == "float" else c).alias(n) for n, c in draws.items()])


def best_so_far(spark: SparkSession, sf: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """WN-2: running minimum of the objective per study (user) over trial order (ts, id)."""
    ev = table(spark, sf, "events")
    out = running_min(ev, "value", ["ts", "event_id"], "user_id", slice_rows=slice_rows)
    return out.select("event_id", "user_id", "ts", "event_type", r6("value").alias("value"), "props",
                      r6("best_value").alias("best_value"))


# ---------------------------------------------------------------------------- run ledger
RUN_NAMES = {"purchase": "XGBoost_Optuna_log", "click": "RandomForest_optuna",
             "view": "Linear_baseline", "signup": "XGB_feature_eng_Optuna", "error": "RF_Feature_Eng_log"}


def runs_from_events(spark: SparkSession, sf: str) -> DataFrame:
    """A run ledger derived from events: one run per event, metrics from its value."""
    ev = table(spark, sf, "events")
    name = F.create_map(*[x for k, v in RUN_NAMES.items() for x in (F.lit(k), F.lit(v))])
    v = F.col("value")
    metrics = F.create_map(
        F.lit("train_rmse"), v * 100, F.lit("val_rmse"), v * 110,
        F.lit("test_rmse"), v * 120 + (F.col("user_id") % 7).cast("double"),
        F.lit("test_mae"), v * 80, F.lit("test_rmse_trans"), v, F.lit("fit_seconds"), v * 2)
    # a run logs some metrics only: click runs have no validation, errors no test MAE
    gone = F.when(F.col("event_type") == "click", F.lit("val_rmse")).when(
        F.col("event_type") == "error", F.lit("test_mae")).otherwise("")
    metrics = F.map_filter(metrics, lambda k, _: k != gone)
    params = F.create_map(F.lit("max_depth"), (F.col("user_id") % 10).cast("string"),
                          F.lit("eta"), F.lit("0.1"))
    return ev.select(F.col("event_id").alias("run_id"), name[F.col("event_type")].alias("run_name"),
                     F.col("ts").alias("start_time"),
                     F.when(v < 5, "FAILED").otherwise("FINISHED").alias("status"),
                     params.alias("params"), metrics.alias("metrics"))


def logged_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """RL-1: metrics kept by the ledger filter (train_/val_/test_, not *_trans)."""
    r = runs_from_events(spark, sf)
    kept = RL.logged_metrics(F.col("metrics"))
    return r.select("run_id", F.size(kept).alias("n_logged"),
                    F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"))


def run_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """RL-2 / WN-6: finished runs since 2024-01-15, 10 best by test RMSE."""
    lb = RL.leaderboard(runs_from_events(spark, sf), "test_rmse", since="2024-01-15", top=10)
    return lb.select("run_id", "run_name", r6("test_rmse").alias("test_rmse"))


def best_run(spark: SparkSession, sf: str) -> DataFrame:
    """RL-3 / WN-4: best 'optuna' run by test RMSE."""
    b = RL.best_run(runs_from_events(spark, sf), "test_rmse", "Optuna")
    return b.select("run_id", "run_name", r6("test_rmse").alias("test_rmse"))


def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    """WN-5: latest finished run."""
    return RL.latest_run(runs_from_events(spark, sf)).select(
        "run_id", "run_name", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"))


def run_family_flags(spark: SparkSession, sf: str) -> DataFrame:
    """RL-4: family / log / extended derived from the name of the runs that can be retrained."""
    runs = runs_from_events(spark, sf).where(RL.known_family(F.col("run_name")))
    return RL.family_flags(runs).select("run_id", "run_name", "family", "log_target", "extended")


def ab_compare(spark: SparkSession, sf: str) -> DataFrame:
    """RL-5: metric x model comparison table (fixed model list pivot)."""
    models = ["XGBoost_Optuna_log", "RandomForest_optuna"]
    t = RL.compare(runs_from_events(spark, sf), models, ["test_rmse", "test_mae"])
    return t.select("metric", *[r6(m).alias(m) for m in models])


def param_text_to_number(spark: SparkSession, sf: str) -> DataFrame:
    """SC-20: parameter text -> number, integral values also as integers."""
    ev = table(spark, sf, "events")
    txt = F.get_json_object("props", "$.k")
    scaled = F.concat(txt, F.lit(".5"))
    return ev.select("event_id", P.param_number(txt).alias("k_num"),
                     P.param_integral(txt).alias("k_int"),
                     P.param_integral(scaled).alias("k_half_int"))


def event_props_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-3 on a JSON text column: explicit schema, PERMISSIVE parse."""
    ev = table(spark, sf, "events")
    parsed = F.from_json("props", "k BIGINT, missing STRING", {"mode": "PERMISSIVE"})
    return ev.select("event_id", parsed["k"].alias("k"), parsed["missing"].alias("missing"))


QUERIES = {
    "regression_metrics": regression_metrics,
    "log_target_metrics": log_target_metrics,
    "huber_loss": huber_loss,
    "user_metrics": user_metrics,
    "residual_summary": residual_summary,
    "extreme_residuals": extreme_residuals,
    "top_residuals": top_residuals,
    "union_splits": union_splits,
    "oof_assembly": oof_assembly,
    "fold_metrics": fold_metrics,
    "importance_mean": importance_mean,
    "linear_contributions": linear_contributions,
    "contribution_eur": contribution_eur,
    "trial_sampling": trial_sampling,
    "best_so_far": best_so_far,
    "logged_metrics": logged_metrics,
    "run_leaderboard": run_leaderboard,
    "best_run": best_run,
    "latest_run": latest_run,
    "run_family_flags": run_family_flags,
    "ab_compare": ab_compare,
    "param_text_to_number": param_text_to_number,
    "event_props_flatten": event_props_flatten,
}

_OF = f"""OF AS (
  SELECT o_orderkey, o_totalprice AS y, revenue, n_items, sum_qty, avg_discount, revenue AS yhat,
    CASE WHEN {HASH.format(k='o_orderkey')} < 0.2 THEN 'test'
         WHEN {HASH.format(k='o_orderkey')} < 0.3 THEN 'val' ELSE 'train' END AS split,
    CAST(floor({HASH.format(k='o_orderkey')} * 5) AS INTEGER) AS fold
  FROM orders JOIN (
    SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS revenue,
      CAST(count(*) AS DOUBLE) AS n_items, sum(l_quantity) AS sum_qty, avg(l_discount) AS avg_discount
    FROM lineitem GROUP BY l_orderkey) li ON o_orderkey = l_orderkey)"""


def _w(sql: str) -> str:
    return "WITH " + _OF + ",\n" + sql if sql.lstrip().startswith("X AS") else \
        "WITH " + _OF + "\n" + sql


_METRICS = """round(sqrt(avg(pow({y} - {p}, 2))), 6) AS rmse, round(avg(abs({y} - {p})), 6) AS mae,
  round(1 - sum(pow({y} - {p}, 2)) / (count({y}) * var_pop({y})), 6) AS r2,
  round(avg(abs({y} - {p}) / greatest(abs({y}), 1e-8)) * 100, 6) AS mape"""

_RUNS = """R AS (
  SELECT event_id AS run_id, CASE event_type """ + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in RUN_NAMES.items()) + """ END AS run_name,
    ts AS start_time, CASE WHEN value < 5 THEN 'FAILED' ELSE 'FINISHED' END AS status,
    value * 120 + CAST(user_id % 7 AS DOUBLE) AS test_rmse, value * 80 AS test_mae
  FROM events)"""

ORACLE = {
    "regression_metrics": _w(f"SELECT split, {_METRICS.format(y='y', p='yhat')} FROM OF GROUP BY split"),
    "log_target_metrics": _w(
        "SELECT split, " + _METRICS.format(y="(exp(ln(1 + y)) - 1)", p="(exp(ln(1 + yhat)) - 1)")
        + " FROM OF GROUP BY split"),
    "huber_loss": _w("""SELECT split, round(avg(CASE WHEN abs(y - yhat) <= 1000.0
  THEN 0.5 * abs(y - yhat) * abs(y - yhat) ELSE 1000.0 * (abs(y - yhat) - 0.5 * 1000.0) END), 6)
  AS huber FROM OF GROUP BY split""").replace("), 6)\n  AS huber", "), 2)\n  AS huber"),
    "user_metrics": _w("""SELECT split, round(sqrt(avg(pow(y - yhat, 2))), 6) AS rmse,
  round(max(abs(y - yhat)), 6) AS max_error, round(avg(yhat - y), 6) AS bias FROM OF GROUP BY split"""),
    "residual_summary": _w("""SELECT round(min(y - yhat), 6) AS min, round(max(y - yhat), 6) AS max,
  round(median(y - yhat), 6) AS median, round(avg(y - yhat), 6) AS mean,
  round(stddev_pop(y - yhat), 6) AS std FROM OF"""),
    "extreme_residuals": _w(""", T AS (SELECT quantile_cont(abs(y - yhat), 0.95) AS t FROM OF)
SELECT round(max(t), 6) AS threshold, count(CASE WHEN abs(y - yhat) >= t THEN 1 END) AS n_extreme,
  round(avg(CASE WHEN abs(y - yhat) >= t THEN abs(y - yhat) END), 6) AS mean_abs_extreme
FROM OF, T""").replace("\n, T AS", ",\nT AS"),
    "top_residuals": _w("""SELECT o_orderkey, round(abs(y - yhat), 6) AS abs_error FROM OF
ORDER BY abs(y - yhat) DESC, o_orderkey LIMIT 5"""),
    "union_splits": _w("""SELECT split, count(*) AS n, round(sum(y), 2) AS sum_y FROM OF
WHERE split IN ('train', 'val') GROUP BY split"""),
    "oof_assembly": _w(""", M AS (SELECT f AS cv_fold, avg(y) AS m FROM OF, range(5) t(f)
  WHERE fold <> f GROUP BY f)
SELECT o_orderkey, fold, round(m, 6) AS oof_pred FROM OF JOIN M ON fold = cv_fold""").replace(
        "\n, M AS", ",\nM AS"),
    "fold_metrics": _w(""", P AS (SELECT fold, sqrt(avg(pow(y - yhat, 2))) AS rmse FROM OF GROUP BY fold)
SELECT 'rmse' AS metric, round(avg(rmse), 6) AS mean, round(stddev_samp(rmse), 6) AS std FROM P""")
    .replace("\n, P AS", ",\nP AS"),
    "importance_mean": _w(""", I AS (""" + "\nUNION ALL\n".join(
        f"SELECT f, '{c}' AS feature, abs(corr({c}, y)) AS imp FROM OF, range(5) t(f) "
        f"WHERE fold <> f GROUP BY f" for c in FEATS) + """)
SELECT feature, round(sum(imp) / 5.0, 6) AS importance FROM I GROUP BY feature""")
    .replace("\n, I AS", ",\nI AS"),
    "linear_contributions": _w(""", CF AS (SELECT f AS cv_fold, """ + ", ".join(
        f"regr_slope(y, {c}) AS b_{c}, avg({c}) AS m_{c}" for c in FEATS)
        + """ FROM OF, range(5) t(f) WHERE fold <> f GROUP BY f),
PH AS (""" + "\nUNION ALL\n".join(
            f"SELECT fold, '{c}' AS feature, b_{c} * ({c} - m_{c}) AS phi FROM OF JOIN CF ON fold = cv_fold"
            for c in FEATS) + """),
PF AS (SELECT fold, feature, avg(abs(phi)) AS m FROM PH GROUP BY fold, feature)
SELECT feature, round(avg(m), 6) AS mean_abs_contribution FROM PF GROUP BY feature""")
    .replace("\n, CF AS", ",\nCF AS"),
    "contribution_eur": _w(""", D AS (SELECT *, ln(1 + y) AS ly, ln(1 + yhat) AS pred FROM OF),
ST AS (SELECT """ + ", ".join(f"regr_slope(ly, {c}) AS b_{c}, avg({c}) AS m_{c}" for c in FEATS)
        + """ FROM D),
PH AS (""" + "\nUNION ALL\n".join(
            f"SELECT pred, '{c}' AS feature, b_{c} * ({c} - m_{c}) AS phi FROM D, ST" for c in FEATS)
        + """)
SELECT feature, round(avg(abs((exp(pred + phi) - 1) - (exp(pred) - 1))), 4) AS mean_abs_eur
FROM PH GROUP BY feature""").replace("\n, D AS", ",\nD AS"),
    "trial_sampling": """
SELECT event_id,
  CAST(3 + floor(""" + HASH.format(k="CAST(event_id AS VARCHAR) || ':max_depth'") + """ * 8) AS INTEGER)
    AS max_depth,
  round(0.5 + """ + HASH.format(k="CAST(event_id AS VARCHAR) || ':subsample'") + """ * 0.5, 6)
    AS subsample,
  round(exp(ln(0.01) + """ + HASH.format(k="CAST(event_id AS VARCHAR) || ':eta'") + """ * ln(0.3 / 0.01)), 6)
    AS eta,
  ['gbtree', 'dart'][CAST(floor(""" + HASH.format(k="CAST(event_id AS VARCHAR) || ':booster'")
    + """ * 2) AS INTEGER) + 1] AS booster
FROM events""",
    "best_so_far": """
SELECT event_id, user_id, ts, event_type, round(value, 6) AS value, props,
  round(min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_value FROM events""",
    "logged_metrics": """
SELECT event_id AS run_id, CASE WHEN event_type IN ('click', 'error') THEN 3 ELSE 4 END AS n_logged,
  CASE event_type WHEN 'click' THEN 'test_mae,test_rmse,train_rmse'
    WHEN 'error' THEN 'test_rmse,train_rmse,val_rmse'
    ELSE 'test_mae,test_rmse,train_rmse,val_rmse' END AS keys
FROM events""",
    "run_leaderboard": "WITH " + _RUNS + """
SELECT run_id, run_name, round(test_rmse, 6) AS test_rmse FROM R
WHERE status = 'FINISHED' AND start_time >= TIMESTAMP '2024-01-15'
ORDER BY test_rmse, run_id LIMIT 10""",
    "best_run": "WITH " + _RUNS + """
SELECT run_id, run_name, round(test_rmse, 6) AS test_rmse FROM R
WHERE lower(run_name) LIKE '%optuna%' ORDER BY test_rmse, run_id LIMIT 1""",
    "latest_run": "WITH " + _RUNS + """
SELECT run_id, run_name, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time FROM R
WHERE status = 'FINISHED' ORDER BY start_time DESC, run_id DESC LIMIT 1""",
    "run_family_flags": "WITH " + _RUNS + """
SELECT run_id, run_name, CASE WHEN contains(lower(run_name), 'xgb') THEN 'xgboost' ELSE 'random_forest' END
    AS family, contains(lower(run_name), 'log') AS log_target,
  contains(lower(run_name), 'feature_eng') AS extended
FROM R WHERE contains(lower(run_name), 'xgb') OR contains(lower(run_name), 'rf')""",
    "ab_compare": "WITH " + _RUNS + """
SELECT 'test_rmse' AS metric,
  round(avg(CASE WHEN run_name = 'XGBoost_Optuna_log' THEN test_rmse END), 6) AS XGBoost_Optuna_log,
  round(avg(CASE WHEN run_name = 'RandomForest_optuna' THEN test_rmse END), 6) AS RandomForest_optuna
FROM R
UNION ALL
SELECT 'test_mae',
  round(avg(CASE WHEN run_name = 'XGBoost_Optuna_log' THEN test_mae END), 6),
  round(avg(CASE WHEN run_name = 'RandomForest_optuna' THEN test_mae END), 6) FROM R""",
    "param_text_to_number": """
SELECT event_id, TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) AS k_num,
  CASE WHEN TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE)
            = floor(TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE))
       THEN TRY_CAST(TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) AS BIGINT) END AS k_int,
  CAST(NULL AS BIGINT) AS k_half_int
FROM events""",
    "event_props_flatten": """
SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  json_extract_string(props, '$.missing') AS missing FROM events""",
}
