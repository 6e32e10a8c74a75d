"""Model fitting, tuning and scoring on ``pyspark.ml`` (ML-1..4, ML-13, ML-14, ML-16..18).

Models consume the wide feature DataFrame; ``VectorAssembler`` appears only
at the model edge. Training data is checkpointed to the shared checkpoint
folder before iterative fits, so a lost executor recomputes from the
checkpoint, not from the raw scan and every upstream join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcel.operators import schema_ops as S

# Reference parameter names -> Spark estimator parameters.
GBT_PARAMS = {"max_depth": "maxDepth", "eta": "stepSize", "num_boost_round": "maxIter",
              "subsample": "subsamplingRate", "min_child_weight": "minInstancesPerNode",
              "gamma": "minInfoGain", "max_bin": "maxBins", "seed": "seed"}
RF_PARAMS = {"n_estimators": "numTrees", "max_depth": "maxDepth",
             "min_samples_leaf": "minInstancesPerNode", "max_features": "featureSubsetStrategy",
             "random_state": "seed", "max_bin": "maxBins"}
LINEAR_PARAMS = {"fit_intercept": "fitIntercept", "alpha": "regParam",
                 "l1_ratio": "elasticNetParam", "solver": "solver"}
FAMILIES = {"linear": (LinearRegression, LINEAR_PARAMS),
            "random_forest": (RandomForestRegressor, RF_PARAMS),
            "gbt": (GBTRegressor, GBT_PARAMS)}
TREES = ("random_forest", "gbt")
VECTOR = "features"


def spark_params(family: str, params: dict) -> tuple[dict, dict]:
    """Translate reference parameter names; returns (spark params, ignored params)."""
    _, mapping = FAMILIES[family]
    out, ignored = {}, {}
    for k, v in params.items():
        if k not in mapping:
            ignored[k] = v
            continue
        name = mapping[k]
        if name == "featureSubsetStrategy":
            v = "all" if v is None else str(v)
        elif name in ("maxDepth", "numTrees", "maxIter", "maxBins", "seed"):
            v = int(v)
        elif name == "minInstancesPerNode":
            v = max(1, int(round(float(v))))
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            v = float(v)
        out[name] = v
    if out.get("maxDepth", 0) > 30:
        raise ValueError(f"max_depth {out['maxDepth']}: Spark's trees have 30 levels at most")
    return out, ignored


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a Parquet table into the shared checkpoint folder.

    Later jobs read the columnar copy (pruning and pushdown apply); a lost
    executor re-reads files instead of recomputing scans and joins.
    """
    from parcel.sources.store import scratch_table
    return scratch_table(df)


@dataclass
class FittedModel:
    model: PipelineModel
    features: list[str]
    family: str
    log_target: bool
    ignored_params: dict = field(default_factory=dict)


def fit(df: DataFrame, features: Sequence[str], label: str, family: str = "linear",
        params: dict | None = None, log_target: bool = False,
        validation_col: str | None = None) -> FittedModel:
    """ML-1 / ML-2 / ML-3: assemble features and fit one estimator."""
    est_cls, _ = FAMILIES[family]
    sp, ignored = spark_params(family, params or {})
    lab = F.log1p(F.col(label)) if log_target else F.col(label).cast("double")
    data = df.withColumn("label", lab).where(F.col("label").isNotNull())
    if validation_col is not None and family == "gbt":
        sp["validationIndicatorCol"] = validation_col
    if family == "linear":
        # One pass builds the normal equations; elastic net is then solved on them instead of
        # by one distributed job per iteration. They hold 4096 features at most: a caller with
        # more passes solver="l-bfgs".
        sp.setdefault("solver", "normal")
    elif family in TREES:
        # Larger per-pass node budget: fewer passes over the data per tree level.
        sp.setdefault("maxMemoryInMB", 1024)
        # A forest looks up the node of every tree in each pass; boosting has one tree at a time, and
        # walking it from the root costs less than writing a table of nodes per pass.
        sp.setdefault("cacheNodeIds", family == "random_forest")
    est = est_cls(featuresCol=VECTOR, labelCol="label", predictionCol="raw_prediction", **sp)
    assembler = VectorAssembler(inputCols=list(features), outputCol=VECTOR,
                                handleInvalid="keep")
    if VECTOR in data.columns:
        model = PipelineModel([assembler, est.fit(data)])
    else:
        model = Pipeline(stages=[assembler, est]).fit(data)
    return FittedModel(model, list(features), family, log_target, ignored)


def dense(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``features`` as one dense vector (a missing value is NaN): the values of the assembler with
    ``handleInvalid="keep"``, which makes sparse vectors of rows with many zeros, where a tree has to
    search for each value, and takes every row apart into objects. ``fit`` and ``predict`` use the
    vectors of a table that has them."""
    if VECTOR in df.columns:
        return df
    nan = F.lit(float("nan"))
    return df.withColumn(VECTOR, array_to_vector(F.array(
        *[F.coalesce(F.col(c).cast("double"), nan) for c in features])))


def materialize_vectors(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` and the dense vectors, written: every pass of a fit reads them as they are instead of
    putting them together from a column per feature."""
    return materialize(dense(df, features).select(*keep, VECTOR))


def stopping_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """(best round, counted from 1; whether ``patience`` rounds passed without a better one)."""
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


FIRST_ROUNDS = 256


def fit_boosted(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, params: dict,
                log_target: bool = False, rounds: int = 1000, patience: int = 50,
                first: int = FIRST_ROUNDS) -> tuple[FittedModel, int]:
    """ML-3: boosting that stops once the validation error has not improved for ``patience``
    rounds; returns the model of the best round and that round. The errors of all rounds are read
    from one fit of ``first`` rounds; only if the rule has not stopped by then, the fit is
    repeated with twice as many (a fit of more rounds begins with the same trees). The model keeps
    the trees up to the best round; nothing is fitted again for that."""
    lab = F.log1p(F.col(label)) if log_target else F.col(label).cast("double")
    n = min(rounds, max(first, patience + 1))
    while True:
        fm = fit(train, features, label, "gbt", {**params, "num_boost_round": n}, log_target)
        held = dense(val.withColumn("label", lab).where(F.col("label").isNotNull()), fm.features)
        errors = list(fm.model.stages[-1].evaluateEachIteration(held, "squared"))
        best, stopped = stopping_round(errors, patience)
        if stopped or n >= rounds:
            break
        n = min(rounds, 2 * n)
    return (fm if best == n else first_rounds(fm, best)), best


def first_rounds(fm: FittedModel, n: int) -> FittedModel:
    """The boosted model of the first ``n`` rounds of a longer fit."""
    assembler, model = fm.model.stages
    java, sc = model._java_obj, SparkContext._active_spark_context
    kind = sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees = sc._gateway.new_array(kind, n)
    weights = sc._gateway.new_array(sc._gateway.jvm.double, n)
    for k, (tree, weight) in enumerate(list(zip(model.trees, model.treeWeights))[:n]):
        trees[k], weights[k] = tree._java_obj, float(weight)
    shorter = sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights)
    shorter.setFeaturesCol(java.getFeaturesCol())
    shorter.setPredictionCol(java.getPredictionCol())
    return FittedModel(PipelineModel([assembler, GBTRegressionModel(shorter)]), fm.features, fm.family,
                       fm.log_target, fm.ignored_params)


def predict(fm: FittedModel, df: DataFrame) -> DataFrame:
    """Raw prediction -> ``prediction`` on the original target scale."""
    ready = fm.family in TREES or VECTOR in df.columns
    out = fm.model.stages[-1].transform(dense(df, fm.features)) if ready else fm.model.transform(df)
    p = F.expm1("raw_prediction") if fm.log_target else F.col("raw_prediction")
    return out.withColumn("prediction", p).drop("features", "raw_prediction")


def score(df: DataFrame, fm: FittedModel | None, keep: Sequence[str] = ()) -> DataFrame:
    """ML-16: sanitize (numeric only) -> enforce model schema (missing 0, extras dropped)
    -> predict -> inverse target transform. Row count is preserved."""
    if fm is None:
        raise RuntimeError("model not initialised")
    if not fm.features:
        raise ValueError("model exposes no feature names")
    numeric = S.numeric_only(df.drop(*keep)) if keep else S.numeric_only(df)
    numeric_cols = set(numeric.columns)
    cols = [F.col(k) for k in keep]
    for f in fm.features:
        c = F.col(f).cast("double") if f in numeric_cols else F.lit(0.0)
        cols.append(F.coalesce(c, F.lit(0.0)).alias(f))
    return predict(fm, df.select(*cols))


def feature_importances(fm: FittedModel, spark) -> DataFrame:
    """ML-13: tree importances as a (feature, importance) DataFrame."""
    est = fm.model.stages[-1]
    imp = est.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(fm.features, [float(x) for x in imp])),
                                 "feature string, importance double")


def kmeans(df: DataFrame, features: Sequence[str], k: int, seed: int = 42):
    """ML-17: k-means on (already scaled) columns; returns (model, assignments)."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    model = Pipeline(stages=[assembler, KMeans(k=k, seed=seed, featuresCol="features",
                                               predictionCol="cluster")]).fit(df)
    return model, model.transform(df).drop("features")


def elbow(df: DataFrame, features: Sequence[str], ks: Sequence[int], seed: int = 42
          ) -> list[tuple[int, float]]:
    """ML-18: (k, within-cluster sum of squares) for each k."""
    out = []
    for k in ks:
        model, _ = kmeans(df, features, k, seed)
        out.append((k, float(model.stages[-1].summary.trainingCost)))
    return out
