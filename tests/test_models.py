"""Fitted models on planted data: what was planted is found."""

import pytest
from pyspark.sql import functions as F

from parcel.operators import models as ML


@pytest.fixture(scope="module")
def planted(spark):
    """y depends on a strongly, on b weakly, not on c."""
    return spark.range(1500).select(
        "id", (F.col("id") * 7 % 31).cast("double").alias("a"), (F.col("id") * 13 % 29).cast("double").alias("b"),
        (F.col("id") * 17 % 23).cast("double").alias("c")).withColumn(
            "y", 50.0 * F.col("a") + 5.0 * F.col("b") + 1000.0).cache()


@pytest.mark.parametrize("family, params", [
    ("random_forest", {"n_estimators": 10, "max_depth": 8, "random_state": 1}),
    ("gbt", {"num_boost_round": 15, "max_depth": 4, "eta": 0.4, "seed": 1})])
def test_trees_find_the_planted_dependence(spark, planted, family, params):
    fm = ML.fit(planted, ["a", "b", "c"], "y", family, params)
    importance = {r["feature"]: r["importance"] for r in ML.feature_importances(fm, spark).collect()}
    assert importance["a"] > 0.6 > importance["b"] and importance["c"] < 0.1
    assert sum(importance.values()) == pytest.approx(1)
    out = ML.predict(fm, planted).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).alias("e"),
                                      F.stddev("y").alias("s")).first()
    assert out["e"] < 0.4 * out["s"]


def _counted(spark, n):
    """Rows with many zeros and some missing values."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 9 != 0, (F.col("id") % 31).cast("double")).alias("a"),
        *[(F.col("id") % k == 0).cast("double").alias(f"z{k}") for k in range(7, 17)]).withColumn(
            "y", 50.0 * F.coalesce("a", F.lit(3.0)) + 400.0 * F.col("z7") + 1000.0)


@pytest.mark.parametrize("family, params", [
    ("random_forest", {"n_estimators": 5, "max_depth": 5, "random_state": 1}),
    ("gbt", {"num_boost_round": 6, "max_depth": 3, "eta": 0.4, "subsample": 0.8, "seed": 1}),
    ("linear", {"fit_intercept": True})])
def test_written_vectors_give_the_model_of_the_columns(spark, family, params):
    from pyspark.ml.linalg import DenseVector
    df = _counted(spark, 900).na.fill(0.0).coalesce(1)        # Spark fits no NaN
    features = [c for c in df.columns if c not in ("id", "y")]
    ready = ML.materialize_vectors(df, features, ["id", "y"])
    assert ready.columns == ["id", "y", ML.VECTOR]
    assert {type(r[ML.VECTOR]) for r in ready.collect()} == {DenseVector}
    by_column = ML.fit(df, features, "y", family, params)
    by_vector = ML.fit(ready, features, "y", family, params)
    if family in ML.TREES:
        plan = lambda fm: fm.model.stages[-1].toDebugString.split("\n", 1)[1]
        assert plan(by_column) == plan(by_vector)
    got = {r["id"]: r["prediction"] for r in ML.predict(by_vector, ready).collect()}
    want = {r["id"]: r["prediction"] for r in by_column.model.transform(df).withColumnRenamed(
        "raw_prediction", "prediction").collect()}
    assert got == pytest.approx(want) and ML.VECTOR not in ML.predict(by_vector, ready).columns


def test_vectors_are_the_assemblers_values(spark):
    import math
    df = _counted(spark, 60)
    features = [c for c in df.columns if c not in ("id", "y")]
    whole = ML.VectorAssembler(inputCols=features, outputCol=ML.VECTOR, handleInvalid="keep").transform(df)
    plain = lambda d: {r["id"]: [None if math.isnan(x) else x for x in r[ML.VECTOR].toArray()] for r in d.collect()}
    assert plain(ML.dense(df, features)) == plain(whole) and any(None in v for v in plain(whole).values())


def test_boosting_keeps_no_table_of_nodes(spark, planted):
    params = {"num_boost_round": 2, "max_depth": 2, "seed": 1}
    assert not ML.fit(planted, ["a"], "y", "gbt", params).model.stages[-1].getCacheNodeIds()


def test_fold_matrices_hold_vectors(spark, monkeypatch):
    from parcel.operators import study as ST
    monkeypatch.setattr(ST.FE, "fit_fold_features", lambda df, fold, k, **o: [
        ST.FE.FeatureMeta(["a"], [], {}, [], {}, extended=False)] * k)
    monkeypatch.setattr(ST.FE, "transform_features", lambda df, m, keep: df.select(*keep, *[
        F.lit(1.0).alias(c) for c in m.feature_columns]))
    df = _counted(spark, 30).withColumn("fold", (F.col("id") % 2).cast("int"))
    for X, features in ST.fold_matrices(df, "fold", 2, "y", ["id"]):
        assert X.columns == ["id", "fold", "y", ML.VECTOR] and X.count() == 30
        assert len(X.first()[ML.VECTOR]) == len(features)


def test_linear_model_finds_the_planted_plane(spark, planted):
    fm = ML.fit(planted, ["a", "b", "c"], "y", "linear", {"fit_intercept": True})
    model = fm.model.stages[-1]
    assert list(model.coefficients) == pytest.approx([50, 5, 0], abs=1e-6)
    assert model.intercept == pytest.approx(1000)
    low = ML.fit(planted.withColumn("y", F.expm1(F.col("a") / 10)), ["a"], "y", "linear", {}, log_target=True)
    got = ML.predict(low, planted.where("a = 20")).first()
    assert got["prediction"] == pytest.approx(6.38905609893065, rel=1e-6)


def test_kmeans_and_elbow_find_planted_clusters(spark):
    rows = [(k, 10.0 * (k % 3) + (k % 7) / 100, -5.0 * (k % 3) + (k % 5) / 100) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double").cache()
    _, assigned = ML.kmeans(df, ["x", "y"], 3)
    pairs = {(r["id"] % 3, r["cluster"]) for r in assigned.collect()}
    assert len(pairs) == 3 and len({c for _, c in pairs}) == 3
    cost = dict(ML.elbow(df, ["x", "y"], [2, 3, 4]))
    assert cost[2] > 25 * cost[3] >= cost[4] > 0
