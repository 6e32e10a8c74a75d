"""Catalogue: the fitted feature pipeline and pyspark.ml models (rows-only checks)."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcel.functions import parse as P
from parcel.operators import features as FE
from parcel.operators import fit as FIT
from parcel.operators import metrics as M
from parcel.operators import model_config as MC
from parcel.operators import models as ML
from parcel.operators import split as SP
from parcel.operators import study as ST
from parcel.operators.preprocess import facility_flags
from parcel.plans.common import IMPUTE_DEFAULT, clean_listings
from parcel.session import store_root
from parcel.sources.listings import amenity_points, geo_dimension
from parcel.sources.store import config_key

KEEP = ["listing_id", "split", "price_num"]


def build_features(spark: SparkSession, sf: str, priced_only: bool = True, keep: list[str] = KEEP
                   ) -> tuple[DataFrame, FE.FeatureMeta, dict]:
    """Stages 1-5 of the training pipeline: load, preprocess, impute, drop missing target
    (``priced_only``; scoring keeps every listing), split, fit features on the priced training
    rows, transform every split. Also returns the imputation values."""
    base, values, geo = base_listings(spark, sf, priced_only)
    fitted = base.where((F.col("split") == "train") & F.col("price_num").isNotNull())
    meta = FE.fit_features(fitted, geo=geo, amenities=amenity_points(spark, sf))
    keep = keep + (meta.count_columns if "counts" in keep else [])
    return FE.transform_features(base, meta, keep=[k for k in keep if k != "counts"]), meta, values


def base_listings(spark: SparkSession, sf: str, priced_only: bool = True
                  ) -> tuple[DataFrame, dict, DataFrame]:
    """Clean, imputed listings with their split, the imputation values, and the geocode cache
    (of all listings: it is looked up, not fitted)."""
    # Several fit jobs read the cleaned listings: checkpoint them once.
    clean = ML.materialize(clean_listings(spark, sf))
    values = FIT.fit_impute(clean, IMPUTE_DEFAULT)
    filled = FIT.apply_impute(facility_flags(clean, FE.FOLD_FLAGS), values)
    if priced_only:
        filled = filled.where(F.col("price_num").isNotNull())
    return SP.with_split(filled, "listing_id", 0.2, 0.1), values, geo_dimension(clean)


def build_feature_matrix(spark: SparkSession, sf: str, priced_only: bool = True
                         ) -> tuple[DataFrame, FE.FeatureMeta]:
    X, meta, _ = build_features(spark, sf, priced_only)
    return X, meta


def feature_matrix_geo(spark: SparkSession, sf: str) -> DataFrame:
    """FE-15 / JN-2 / JN-3 inside the fitted pipeline, row by row: coordinates with train-only
    centroids, distance bins, amenity counts and bins."""
    X, meta, _ = build_features(spark, sf, keep=[*KEEP, "counts"])
    cols = [*FE.GEO_FEATURES[2:], *[f"{c}_bin_encoded" for c in meta.count_columns]]
    return X.select("listing_id", "split", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
                    *[F.col(c).cast("int").alias(c) for c in cols], *meta.count_columns)


def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """FE-8 / FE-9 / PR-2..4 / SC-19 / SC-21 / JN-8: model-ready features for all splits."""
    X, _ = build_feature_matrix(spark, sf)
    return X


def _training(spark, sf):
    X, meta = build_feature_matrix(spark, sf)
    return ML.materialize(X), meta.feature_columns


def _tree_training(spark, sf):
    X, meta = build_feature_matrix(spark, sf)
    return ML.materialize_vectors(X, meta.feature_columns, KEEP), meta.feature_columns


def _metrics(pred: DataFrame) -> DataFrame:
    m = M.evaluate(pred, "price_num", "prediction", "split")
    return m.select("split", *[F.round(c, 2).alias(c) for c in ("rmse", "mae", "r2", "mape")])


def fit_linear(spark: SparkSession, sf: str) -> DataFrame:
    """ML-1 + IM-6: standard-scaled linear regression on log price, metrics per split."""
    X, feats = _training(spark, sf)
    state = FIT.fit_scaler(X.where(F.col("split") == "train"), feats, "standard")
    Xs = FIT.apply_scaler(X, state)
    fm = ML.fit(Xs.where(F.col("split") == "train"), feats, "price_num", "linear",
                {"fit_intercept": True}, log_target=True)
    return _metrics(ML.predict(fm, Xs))


def fit_forest(spark: SparkSession, sf: str, trees: int = 200, depth: int = 10) -> DataFrame:
    """ML-2: random forest (200 trees, depth 10, seed 42), metrics per split."""
    X, feats = _tree_training(spark, sf)
    fm = ML.fit(X.where(F.col("split") == "train"), feats, "price_num", "random_forest",
                {"n_estimators": trees, "max_depth": depth, "random_state": 42})
    return _metrics(ML.predict(fm, X))


def fit_boosted(spark: SparkSession, sf: str, max_rounds: int = 1000, patience: int = 50) -> DataFrame:
    """ML-3: boosted trees on log price; up to 1000 rounds, stopped after 50 without a better
    validation error. The number of rounds kept comes with the metrics."""
    X, feats = _tree_training(spark, sf)
    fm, rounds = ML.fit_boosted(
        X.where(F.col("split") == "train"), X.where(F.col("split") == "val"), feats, "price_num",
        {"max_depth": 6, "eta": 0.05, "seed": 42, "subsample": 0.85}, True, max_rounds, patience)
    return _metrics(ML.predict(fm, X)).withColumn("n_rounds", F.lit(rounds))


# The catalogue's budget: the families and folds of a full study, few trials of small models. The
# defaults of ``study.run_study`` and ``model_config.CONFIGS`` are the full ones.
SMALL_FOREST = MC.ModelConfig(
    "random_forest_small", "random_forest", [], model_params={"random_state": 42},
    space={"n_estimators": {"type": "int", "low": 5, "high": 15}, "max_depth": {"type": "int", "low": 4, "high": 6},
           "max_features": {"type": "categorical", "choices": ["sqrt", "log2"]}})
SMALL_BOOSTING = MC.ModelConfig(
    "xgboost_small", "gbt", [], model_params={"max_depth": 3, "seed": 42},
    fit_params={"num_boost_round": 12, "early_stopping_rounds": 3},
    space={"eta": {"type": "float", "low": 0.1, "high": 0.4, "log": True},
           "subsample": {"type": "float", "low": 0.8, "high": 1.0}})


def study(spark: SparkSession, sf: str, configs=(SMALL_BOOSTING, SMALL_FOREST), trials: int = 2,
          folds: int = ST.FOLDS) -> ST.Ledger:
    """The catalogue's study of this table, worked off or resumed: trials that its ledger in the
    store already has are not run again."""
    key = config_key({"sf": sf, "configs": [asdict(c) for c in configs], "folds": folds})
    ledger = ST.Ledger(spark, f"{store_root(spark)}/studies", f"listings_{key}")
    have = {(r["family"], r["trial"]) for r in ledger.results().select("family", "trial").distinct().collect()}
    if len(have) < trials * len(configs):
        base, _, geo = base_listings(spark, sf)
        train = ML.materialize(SP.with_folds(base.where(F.col("split") == "train"), "listing_id", folds,
                                            SP.FOLD_SEED))
        matrices = ST.fold_matrices(train, "fold", folds, "price_num", ["listing_id"], geo=geo,
                                    amenities=amenity_points(spark, sf))
        ST.run_study(ledger, configs, ST.cv_objective(matrices, "fold", "price_num"), trials)
    return ledger


def cv_random_search(spark: SparkSession, sf: str) -> DataFrame:
    """ML-8..ML-11 / WN-2: random search over two families, features refitted in every fold, trials
    in a ledger, best so far per family."""
    return study(spark, sf).trials().select(
        "family", "trial", "params", F.round("mean_val_rmse", 2).alias("mean_val_rmse"),
        F.round("best_so_far", 2).alias("best_so_far"))


def retrain_best(spark: SparkSession, sf: str) -> DataFrame:
    """ML-12: the ledger's best trial of either family, refitted on train + val with fixed
    parameters (boosting: the mean number of rounds its folds kept), evaluated on test."""
    ledger = study(spark, sf)
    base, _, geo = base_listings(spark, sf)
    base = ML.materialize(base)
    fitset = base.where(F.col("split") != "test")
    meta = FE.fit_features(fitset, flags=FE.FOLD_FLAGS, geo=geo, amenities=amenity_points(spark, sf))
    X = ML.materialize_vectors(FE.transform_features(base, meta, keep=KEEP), meta.feature_columns, KEEP)
    out = None
    for config in (SMALL_BOOSTING, SMALL_FOREST):
        best = ledger.best(config.family)
        params = json.loads(best["params"])
        chosen = {**params["model"], **params["fit"]}
        if best["rounds"]:
            chosen["num_boost_round"] = round(best["rounds"])
        model, _ = ST.fit_config(config, chosen, X.where(F.col("split") != "test"), None,
                                 meta.feature_columns, "price_num", True)
        m = _metrics(ML.predict(model, X.where(F.col("split") == "test"))).withColumn(
            "family", F.lit(config.family))
        out = m if out is None else out.unionByName(m)
    return out


def config_features(spark: SparkSession, sf: str) -> DataFrame:
    """PR-2 / PR-3 / PR-6: the matrix of the linear model's configured features, gaps filled with 0."""
    X = MC.feature_matrix(clean_listings(spark, sf), MC.CONFIGS["linear_regression"], ["listing_id"])
    return X.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in X.dtypes])


def importance_folds(spark: SparkSession, sf: str, trees: int = 200, depth: int = 10) -> DataFrame:
    """ML-13 / ML-14 / AG-17: forest importances per fold, mean over folds (absent = 0)."""
    X, feats = _tree_training(spark, sf)
    train = SP.with_folds(X.where(F.col("split") != "test"), "listing_id", 5, SP.FOLD_SEED)
    per = None
    for f in range(5):
        fm = ML.fit(train.where(F.col("fold") != f), feats, "price_num", "random_forest",
                    {"n_estimators": trees, "max_depth": depth, "random_state": 42})
        imp = ML.feature_importances(fm, spark).withColumn("fold", F.lit(f))
        per = imp if per is None else per.unionByName(imp)
    return (per.groupBy("feature").agg((F.sum("importance") / F.lit(5.0)).alias("importance"))
            .select("feature", F.round("importance", 6).alias("importance")))


def score_batch(spark: SparkSession, sf: str) -> DataFrame:
    """ML-16: score every listing through sanitize -> enforce schema -> predict -> expm1."""
    X, meta = build_feature_matrix(spark, sf, priced_only=False)
    X, feats = ML.materialize(X), meta.feature_columns
    fm = ML.fit(X.where((F.col("split") == "train") & F.col("price_num").isNotNull()), feats,
                "price_num", "linear", {"fit_intercept": True}, log_target=True)
    return ML.score(X, fm, keep=["listing_id"]).select(
        "listing_id", F.round("prediction", 2).alias("prediction"))


def score_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """ML-16 checked: every listing, priced or not, has one prediction."""
    return score_batch(spark, sf).groupBy("listing_id").agg(
        F.count("prediction").alias("predictions"))


def linear_one_feature(spark: SparkSession, sf: str) -> DataFrame:
    """ML-1 checked: slope and intercept of a fitted one-feature model (order total by revenue
    of its items, training split)."""
    from parcel.plans.q_models import order_features
    train = ML.materialize(order_features(spark, sf).where(F.col("split") == "train"))
    model = ML.fit(train, ["revenue"], "y", "linear", {"fit_intercept": True}).model.stages[-1]
    return spark.createDataFrame([(round(float(model.coefficients[0]), 6),
                                   round(float(model.intercept), 2))], "slope double, intercept double")


def _area_table(spark, sf):
    clean = clean_listings(spark, sf)
    return (clean.groupBy(P.prefix("postal_code_clean", 4).alias("pc4"))
            .agg(F.avg("price_num").alias("avg_price"), F.avg("size_num").alias("avg_size"),
                 F.avg(P.safe_ratio("price_num", "size_num")).alias("avg_price_m2"),
                 F.count("price_num").alias("n_listings"))
            .na.fill(0.0))


AREA_FEATS = ["avg_price", "avg_size", "avg_price_m2", "n_listings"]


def kmeans_areas(spark: SparkSession, sf: str) -> DataFrame:
    """ML-17 + AG-13: standardized area stats, k-means (k=4, seed 42), ranges per cluster."""
    areas = ML.materialize(_area_table(spark, sf))
    scaled = FIT.apply_scaler(areas, FIT.fit_scaler(areas, AREA_FEATS, "standard"), "_z")
    _, assigned = ML.kmeans(scaled, [c + "_z" for c in AREA_FEATS], 4)
    return (assigned.groupBy("cluster")
            .agg(F.count(F.lit(1)).alias("n_areas"),
                 F.round(F.min("avg_price"), 2).alias("min_avg_price"),
                 F.round(F.max("avg_price"), 2).alias("max_avg_price")))


def elbow_curve(spark: SparkSession, sf: str, most: int = 14) -> DataFrame:
    """ML-18: within-cluster cost for k = 2..14."""
    areas = ML.materialize(_area_table(spark, sf))
    scaled = FIT.apply_scaler(areas, FIT.fit_scaler(areas, AREA_FEATS, "standard"), "_z")
    cost = ML.elbow(scaled, [c + "_z" for c in AREA_FEATS], range(2, most + 1))
    return spark.createDataFrame([(k, round(c, 4)) for k, c in cost], "k int, cost double")


QUERIES = {
    "feature_matrix": feature_matrix,
    "feature_matrix_geo": feature_matrix_geo,
    "fit_linear": fit_linear,
    "fit_forest": fit_forest,
    "fit_boosted": fit_boosted,
    "cv_random_search": cv_random_search,
    "retrain_best": retrain_best,
    "config_features": config_features,
    "importance_folds": importance_folds,
    "score_batch": score_batch,
    "score_coverage": score_coverage,
    "linear_one_feature": linear_one_feature,
    "kmeans_areas": kmeans_areas,
    "elbow_curve": elbow_curve,
}

def _oracles() -> dict[str, str]:
    from parcel.plans.oracle_base import with_listing
    from parcel.plans.oracle_features import feature_profile_sql, geo_rows_sql
    from parcel.plans.q_models import _w
    return {"feature_matrix_profile": feature_profile_sql(),
            "feature_matrix_geo": geo_rows_sql(),
            "config_features": with_listing("""
SELECT listing_id, coalesce(CAST(size_num AS DOUBLE), 0) AS size_num, coalesce(bedrooms_d, 0) AS bedrooms,
  CAST(CASE coalesce(energy_label, 'G') WHEN 'G' THEN 0 WHEN 'F' THEN 1 WHEN 'E' THEN 2 WHEN 'D' THEN 3
    WHEN 'C' THEN 4 WHEN 'B' THEN 5 WHEN 'A' THEN 6 WHEN 'A+' THEN 7 WHEN 'A++' THEN 8 WHEN 'A+++' THEN 9
    WHEN 'A++++' THEN 10 END AS DOUBLE) AS energy_label,
  coalesce(year_of_construction_d, 0) AS year_of_construction, coalesce(nr_rooms_d, 0) AS nr_rooms,
  coalesce(bathrooms_d, 0) AS bathrooms, coalesce(toilets_d, 0) AS toilets,
  coalesce(CAST(contribution_vve_num AS DOUBLE), 0) AS contribution_vve_num,
  coalesce(CAST(external_storage_num AS DOUBLE), 0) AS external_storage_num,
  coalesce(CAST(nb_inhabitants AS DOUBLE), 0) AS inhabitants_in_neighborhood,
  round(coalesce(nb_families, 0), 6) AS families_with_children_pct,
  coalesce(nb_price_m2, 0) AS price_per_m2_neighborhood, price_num FROM C""", clean=True),
            "score_coverage": """
SELECT o_orderkey AS listing_id, count(*) AS predictions FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY o_orderkey""",
            "linear_one_feature": _w("""SELECT round(regr_slope(y, revenue), 6) AS slope,
  round(regr_intercept(y, revenue), 2) AS intercept FROM OF WHERE split = 'train'""")}


ORACLE: dict[str, str] = _oracles()


def feature_matrix_profile(spark: SparkSession, sf: str) -> DataFrame:
    """FE-8 / FE-9 checked end to end: per split, the mean of every model feature."""
    X, meta = build_feature_matrix(spark, sf)
    rows = [F.struct(F.lit(f).alias("feature"), F.round(F.avg(f), 4).alias("avg_value"))
            for f in meta.feature_columns]
    return (X.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.array(*rows).alias("r"))
            .select("split", "n", F.inline("r")))


QUERIES["feature_matrix_profile"] = feature_matrix_profile
