"""Scoring contracts (FIXTURES F3): expm1 of the model, missing -> 0, extras and text dropped."""

import math

import pytest

from parcel.operators import models as ML


@pytest.fixture(scope="module")
def model(spark):
    # log1p(price) = 10 + 0.01*size + 0.1*rooms + 0.2*has_garden, fitted exactly.
    rows = []
    for s in range(50, 200, 10):
        for r in range(1, 6):
            for g in (0, 1):
                rows.append((float(s), float(r), float(g),
                             math.expm1(10 + 0.01 * s + 0.1 * r + 0.2 * g)))
    df = spark.createDataFrame(rows, "size double, rooms double, has_garden double, price double")
    return ML.fit(df, ["size", "rooms", "has_garden"], "price", "linear", {}, log_target=True)


def test_happy_path(spark, model):
    df = spark.createDataFrame([(1, 120.0, 4.0, 1.0)], "id long, size double, rooms double, "
                                                       "has_garden double")
    p = ML.score(df, model, keep=["id"]).first()["prediction"]
    assert p == pytest.approx(math.expm1(10 + 1.2 + 0.4 + 0.2), rel=1e-6)


def test_missing_features_are_zero(spark, model):
    df = spark.createDataFrame([(1, 100.0)], "id long, size double")
    p = ML.score(df, model, keep=["id"]).first()["prediction"]
    assert p == pytest.approx(math.expm1(10 + 1.0), rel=1e-6)


def test_extra_and_non_numeric_dropped(spark, model):
    df = spark.createDataFrame([(1, 90.0, 3.0, 0.0, -12.5, "corner house"), (2, 70.0, 2.0, 1.0, None, None)],
                               "id long, size double, rooms double, has_garden double, "
                               "tide_level double, agent_remark string")
    out = ML.score(df, model, keep=["id"])
    assert out.columns == ["id", "size", "rooms", "has_garden", "prediction"]
    assert out.count() == 2


def test_failures(spark, model):
    df = spark.createDataFrame([(1, 1.0)], "id long, size double")
    with pytest.raises(RuntimeError):
        ML.score(df, None)
    broken = ML.FittedModel(model.model, [], "linear", True)
    with pytest.raises(ValueError):
        ML.score(df, broken)


def test_param_translation():
    sp, ignored = ML.spark_params("gbt", {"max_depth": 6, "eta": 0.05, "lambda": 10.0,
                                          "min_child_weight": 6.6})
    assert sp == {"maxDepth": 6, "stepSize": 0.05, "minInstancesPerNode": 7}
    assert ignored == {"lambda": 10.0}
