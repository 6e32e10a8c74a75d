"""Hash splits and folds: deterministic, partition-invariant, right shares."""

from pyspark.sql import functions as F

from parcel.operators import split as SP


def test_split_is_partition_invariant(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = {r["k"]: r["split"] for r in SP.with_split(df, "k", 0.2, 0.1).collect()}
    b = {r["k"]: r["split"] for r in SP.with_split(df.repartition(17), "k", 0.2, 0.1).collect()}
    assert a == b
    shares = {s: sum(1 for v in a.values() if v == s) / len(a) for s in ("train", "val", "test")}
    assert abs(shares["test"] - 0.2) < 0.02 and abs(shares["val"] - 0.1) < 0.02


def test_folds_cover_all_rows_once(spark):
    df = SP.with_folds(spark.range(5000).withColumnRenamed("id", "k"), "k", 5)
    counts = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}
    assert set(counts) == {0, 1, 2, 3, 4} and sum(counts.values()) == 5000
    train = SP.with_split(spark.range(5000).withColumnRenamed("id", "k"), "k", 0.2, 0.1).where("split = 'train'")
    counts = {r["fold"]: r["count"] for r in SP.with_folds(train, "k", 5, SP.FOLD_SEED).groupBy("fold").count().collect()}
    assert len(counts) == 5 and min(counts.values()) > 0.8 * max(counts.values())


def test_run_family_of_an_unknown_name_stops(spark):
    import pytest

    from parcel.operators import runs as RL
    df = spark.createDataFrame([("XGB_feature_eng_log",), ("rf_base",)], "run_name string")
    assert [tuple(r)[1:] for r in RL.family_flags(df).collect()] == [
        ("xgboost", True, True), ("random_forest", False, False)]
    with pytest.raises(Exception, match="no model family"):
        RL.family_flags(df.union(spark.createDataFrame([("linear",)], "run_name string"))).collect()


def test_stopping_round():
    from parcel.operators.models import stopping_round
    assert stopping_round([5, 4, 3, 3, 3.5], 2) == (3, True)
    assert stopping_round([5, 4, 3, 2], 2) == (4, False)
    assert stopping_round([1, 2, 0.5, 2, 2, 2, 0.1], 3) == (3, True)


def test_boosting_stops_no_worse_than_all_rounds(spark):
    from pyspark.sql import functions as F

    from parcel.operators import models as ML
    df = spark.range(600).select((F.col("id") % 17).cast("double").alias("a"),
                                 (F.col("id") % 5).cast("double").alias("b"), "id").withColumn(
        "y", 100 * F.col("a") + 10 * F.col("b") * F.col("a") + (F.hash("id") % 7))
    train, val = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    params = {"max_depth": 3, "eta": 0.3, "seed": 1}
    fm, best = ML.fit_boosted(train, val, ["a", "b"], "y", params, rounds=24, patience=4, first=8)
    every = ML.fit(train, ["a", "b"], "y", "gbt", {**params, "num_boost_round": 24})
    error = lambda m: ML.predict(m, val).agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]
    assert 1 <= best <= 24 and error(fm) <= error(every) * 1.0001
