"""Isolation forest: planted outliers get the top scores; the flagged share is the contamination."""

import random

from pyspark.sql import functions as F

from parcel.operators import outliers as OD


def test_isolation_forest_flags_planted_outliers(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(4900)]
    rows += [(5000 + i, 12 + rnd.random(), -12 - rnd.random()) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    flagged, threshold = OD.flag_outliers(df, ["a", "b"], "k", contamination=0.02, n_trees=50)
    got = {r["k"] for r in flagged.where("is_outlier").collect()}
    assert len(got) == 100                       # 2 % of 5000, no ties at the threshold
    assert got == set(range(5000, 5100))         # exactly the planted points
    kept, removed = OD.split_outliers(flagged)
    assert kept.count() == 4900 and removed.count() == 100
    # Same forest for the same data and seed (hash sampling, seeded tree growth).
    again = OD.fit_isolation_forest(df, ["a", "b"], "k", n_trees=5)
    assert again == OD.fit_isolation_forest(df.repartition(7), ["a", "b"], "k", n_trees=5)


def test_every_tree_draws_its_share(spark, monkeypatch):
    """Sampling by skips: each tree gets about p * n rows, each row about p * trees trees."""
    df = spark.range(20_000).select("id", (F.col("id") % 97).cast("double").alias("a"))
    seen = []
    monkeypatch.setattr(OD, "_build_group", lambda features, psi: None)
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandas",
                        lambda self, f, schema: seen.append(self._df) or spark.createDataFrame([], OD.TREE_SCHEMA))
    OD.fit_isolation_forest(df, ["a"], "id", n_trees=40, psi=256, oversample=2.0)
    drawn = seen[0].groupBy("tree_id").agg(F.count("id").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert sorted(r["tree_id"] for r in drawn) == list(range(40))
    assert all(r["n"] == r["d"] and 400 < r["n"] < 630 for r in drawn)
    assert 19_000 < sum(r["n"] for r in drawn) < 22_000
