"""Studies: sampled trials, the ledger, resuming, claims, routing; boosting by prefix."""

import json
import time

import pytest
from pyspark.sql import functions as F

from parcel.operators import model_config as MC
from parcel.operators import models as ML
from parcel.operators import study as ST
from parcel.sources.store import scratch_path

CONFIG = MC.ModelConfig("toy_rf", "random_forest", [], model_params={"random_state": 1, "n_estimators": 3},
                        fit_params={"patience": 9}, space={"max_depth": {"type": "int", "low": 2, "high": 4},
                                                           "patience": {"type": "int", "low": 1, "high": 1}})


def test_defaults_are_the_full_budget():
    assert (ST.TRIALS, ST.FOLDS) == (30, 5)
    assert {c.family for c in MC.CONFIGS.values()} == {"linear", "random_forest", "gbt"}
    assert MC.CONFIGS["xgboost_early_stopping"].fit_params == {"num_boost_round": 1000, "early_stopping_rounds": 50}


def test_draws_are_routed_and_repeatable(spark):
    trials = ST.trial_params(spark, CONFIG, 20)
    assert trials == ST.trial_params(spark, CONFIG, 20) != ST.trial_params(spark, CONFIG, 20, seed=1)
    assert {m["max_depth"] for m, _ in trials} == {2, 3, 4}
    assert all(f == {"patience": 1} and m["n_estimators"] == 3 and "patience" not in m for m, f in trials)


def test_a_killed_study_resumes_without_repeating(spark):
    ledger = ST.Ledger(spark, scratch_path(spark, "study_test"), "s")
    assert ledger.best() is None and ledger.trials().count() == 0
    ran = []

    def objective(config, params):
        if len(ran) == 3 and not killed:
            killed.append(1)
            raise KeyboardInterrupt
        ran.append(params["max_depth"])
        return [(f, float(params["max_depth"] * 10 + f), 5, None) for f in range(2)]

    killed = []
    with pytest.raises(KeyboardInterrupt):
        ST.run_study(ledger, [CONFIG], objective, 8)
    assert ledger.results().count() == 6
    # the killed run's claim holds within the lease, and not beyond it
    assert ST.run_study(ledger, [CONFIG], objective, 8) == 4 and len(ran) == 7
    time.sleep(1.1)
    assert ST.run_study(ledger, [CONFIG], objective, 8, lease_seconds=1) == 1 and len(ran) == 8
    assert ST.run_study(ledger, [CONFIG], objective, 8, lease_seconds=0) == 0
    rows = sorted(ledger.trials().collect(), key=lambda r: r["trial"])
    assert [r["trial"] for r in rows] == list(range(8))
    means = [r["mean_val_rmse"] for r in rows]
    assert [r["best_so_far"] for r in rows] == [min(means[:k + 1]) for k in range(8)]
    best = ledger.best("random_forest")
    assert best["trial"] == means.index(min(means)) and json.loads(best["params"])["model"]["max_depth"] == min(ran)


def test_a_claim_is_given_once(spark):
    ledger = ST.Ledger(spark, scratch_path(spark, "study_test"), "s")
    assert ledger.claim("t") and not ledger.claim("t")


def data(spark):
    return spark.range(600).select((F.col("id") % 17).cast("double").alias("a"),
                                   (F.col("id") % 5).cast("double").alias("b"), "id").withColumn(
        "y", 100 * F.col("a") + 10 * F.col("b") * F.col("a") + (F.hash("id") % 7)).withColumn(
            "fold", (F.col("id") % 3).cast("int"))


def test_objective_of_every_family(spark):
    matrices = [(data(spark).cache(), ["a", "b"])] * 3
    run = ST.cv_objective(matrices, "fold", "y", log_target=False)
    forest = run(CONFIG, {"n_estimators": 4, "max_depth": 5, "random_state": 1})
    assert [f for f, *_ in forest] == [0, 1, 2] and all(n == 200 and r is None for _, _, n, r in forest)
    boosting = MC.ModelConfig("toy_xgb", "gbt", [], fit_params={"num_boost_round": 9, "early_stopping_rounds": 2})
    kept = run(boosting, {"max_depth": 3, "eta": 0.5, "seed": 1, **boosting.fit_params})
    assert all(1 <= r <= 9 and e < 200 for _, e, _, r in kept)
    assert all(e < 400 for _, e, _, _ in run(MC.ModelConfig("lin", "linear", []), {"fit_intercept": True}))


def test_boosted_prefix_is_the_shorter_fit(spark):
    """Trees up to the best round of one long fit predict what a fit of that many rounds does."""
    df = data(spark)
    params = {"max_depth": 3, "eta": 0.3, "seed": 1}
    long = ML.fit(df, ["a", "b"], "y", "gbt", {**params, "num_boost_round": 9})
    for n in (1, 4, 9):
        short = ML.fit(df, ["a", "b"], "y", "gbt", {**params, "num_boost_round": n})
        got = ML.predict(ML.first_rounds(long, n), df).orderBy("id").select("prediction").collect()
        want = ML.predict(short, df).orderBy("id").select("prediction").collect()
        assert [r[0] for r in got] == pytest.approx([r[0] for r in want], rel=1e-9)


def test_config_matrix(spark, tmp_path):
    path = tmp_path / "models.json"
    path.write_text(json.dumps({"m": {"family": "linear", "features": ["size_num", "has_lift", "energy_label"]}}))
    config = MC.load_configs(str(path))["m"]
    df = spark.createDataFrame([(1, None, ["lift"], "A", 5.0, "x"), (2, 7, [], None, None, "y")],
                               "listing_id long, size_num long, facilities_list array<string>, energy_label string, "
                               "price_num double, other string")
    X = MC.feature_matrix(df, config, ["listing_id"])
    assert X.columns == ["listing_id", "size_num", "has_lift", "energy_label", "price_num"]
    assert [tuple(r) for r in X.orderBy("listing_id").collect()] == [(1, 0.0, 1.0, 6.0, 5.0), (2, 7.0, 0.0, 0.0, None)]
    with pytest.raises(ValueError, match="size_num"):
        MC.feature_matrix(df.drop("size_num"), config)
