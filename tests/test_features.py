"""Feature pipeline: meta round trip, batch == one-row transform, energy ordinal."""

import pytest
from pyspark.sql import functions as F

from parcel.functions import geo as G
from parcel.operators import features as FE
from parcel.operators import geo_join as GJ
from parcel.operators import models as ML
from parcel.operators import split as SP
from parcel.plans.q_ml import base_listings, build_feature_matrix
from parcel.sources.listings import amenity_points
from tests.conftest import SF_SMALL


def test_meta_roundtrip_and_one_row_parity(spark):
    X, meta = build_feature_matrix(spark, SF_SMALL)
    assert FE.FeatureMeta.from_json(meta.to_json()) == meta
    assert X.columns == ["listing_id", "split", "price_num"] + meta.feature_columns
    assert len(meta.count_columns) == 16 and "dist_to_center_bin_encoded" in meta.feature_columns
    # Transforming one row alone gives the same features as inside the full batch.
    base, _, _ = base_listings(spark, SF_SMALL)
    some_id = X.orderBy("listing_id").first()["listing_id"]
    one = FE.transform_features(base.where(F.col("listing_id") == some_id), meta,
                                keep=["listing_id"]).first().asDict()
    full = X.where(F.col("listing_id") == some_id).first().asDict()
    for c in meta.feature_columns:
        assert one[c] == pytest.approx(full[c], rel=1e-12, abs=1e-12), c


def _tables(spark, meta):
    read = lambda k: sorted(map(tuple, spark.read.parquet(meta.tables[k]).collect()))
    return {k: read(k) for k in FE.CENTROID_KEYS}


def test_fold_state_ignores_the_folds_own_rows(spark):
    """Every fold's state equals a fit on the other folds alone, although its own rows hold
    planted extremes, levels and places that nothing else has."""
    base, _, _ = base_listings(spark, SF_SMALL)
    rows = ML.materialize(SP.with_folds(base.limit(400), "listing_id", 4))
    leak = lambda f, planted, usual: F.when(F.col("fold") == f, planted).otherwise(usual)
    rows = rows.withColumns({
        "size_num": leak(1, F.lit(1e9).cast("long"), F.col("size_num")),
        "nr_rooms": leak(2, F.lit(-5.0), F.col("nr_rooms")),
        "status": leak(0, F.lit("AAA planted"), F.col("status")),
        "neighborhood": leak(3, F.lit("planted"), F.col("neighborhood")),
        "postal_code_clean": leak(1, F.lit("0000XX"), F.col("postal_code_clean"))})
    rows = ML.materialize(rows)
    geo = ML.materialize(rows.select("address", F.lit(52.0).alias("lat"), (
        4.0 + F.col("listing_id") / 1e6).alias("lon")))
    options = {"geo": geo, "amenities": geo.select(F.lit("school").alias("amenity_type"), "lat", "lon")}
    metas = FE.fit_fold_features(rows, "fold", 4, **options)
    assert len(metas[0].binary_flags) == 22
    for f, meta in enumerate(metas):
        alone = FE.fit_features(rows.where(F.col("fold") != f), flags=FE.FOLD_FLAGS, **options)
        assert (meta.log_cols, meta.ohe_levels) == (alone.log_cols, alone.ohe_levels)
        assert meta.train_medians == pytest.approx(alone.train_medians)
        for key, want in _tables(spark, alone).items():
            got = _tables(spark, meta)[key]
            assert [r[0] for r in got] == [r[0] for r in want]
            assert [r[1:] for r in got] == [pytest.approx(r[1:]) for r in want]
    assert not any("planted" in c for c in metas[0].ohe_columns)
    assert any("planted" in c for m in metas[1:] for c in m.ohe_columns) or metas[1].ohe_levels["status_cat"]
    assert max(metas[1].train_medians["size_num"], 0) < 1e9


def test_toggles(spark):
    base, _, geo = base_listings(spark, SF_SMALL)
    rows = base.limit(200)
    plain = FE.fit_features(rows, extended=False, geo=geo)
    assert not plain.tables and not plain.expanded_features
    assert FE.transform_features(rows, plain, ["listing_id"]).columns == ["listing_id", *plain.feature_columns]
    near = FE.fit_features(rows, geo=geo)
    assert near.expanded_features == FE.EXPANSION_FEATURES + FE.GEO_FEATURES
    assert FE.transform_features(rows, near, ["listing_id"]).count() == 200
    with pytest.raises(ValueError, match="coordinates"):
        FE.fit_features(rows, amenities=geo)


def test_moments_add_up(spark):
    import numpy as np

    from parcel.operators import folds as FO
    r = np.random.default_rng(1)
    parts = [r.gamma(2, 3, n) + 1e4 for n in (50, 1, 0, 200)]
    whole = np.concatenate(parts)
    m = sum((FO.Moments(len(p), p.mean(), ((p - p.mean()) ** 2).sum(), ((p - p.mean()) ** 3).sum(), p.min(), p.max())
             for p in parts if len(p)), FO.Moments())
    assert m.n == len(whole) and m.lo == whole.min() and m.hi == whole.max()
    assert m.mean == pytest.approx(whole.mean()) and m.std == pytest.approx(whole.std())
    import pandas as pd
    assert m.skew == pytest.approx(pd.Series(whole).skew())
    xs, ys = r.normal(size=300), r.normal(size=300)
    df = spark.createDataFrame([(float(x), float(x + y), k % 3) for k, (x, y) in enumerate(zip(xs, ys))],
                               "x double, y double, fold int")
    pairs = FO.comoments(df, ["x"], "y", "fold")["x"]
    keep = np.arange(300) % 3 != 1
    c = FO.others(pairs, 1, FO.CoMoments())
    assert c.corr == pytest.approx(np.corrcoef(xs[keep], (xs + ys)[keep])[0, 1])
    assert c.slope == pytest.approx(np.polyfit(xs[keep], (xs + ys)[keep], 1)[0])


def test_energy_ordinal(spark):
    df = spark.createDataFrame([("G",), ("A++++",), (None,), ("N/A",), ("0",), ("B",)], "e string")
    got = [r[0] for r in df.select(FE.energy_ordinal("e")).collect()]
    assert got == [0.0, 10.0, 0.0, 0.0, 0.0, 5.0]
    bad = spark.createDataFrame([("Z",)], "e string")
    assert bad.select(FE.energy_ordinal("e", on_unknown="null")).first()[0] is None
    with pytest.raises(Exception):
        bad.select(FE.energy_ordinal("e")).collect()


def test_luxury_requires_order(spark):
    df = spark.createDataFrame([(1, 2.0, 80)], "has_lift int, nr_rooms double, size_num long")
    with pytest.raises(ValueError):
        FE.luxury_interactions(df)
    r = FE.luxury_features(df).first()
    assert r["luxury_score"] == 1.0 and r["luxury_density"] == 0.5
    assert r["size_per_luxury"] == 40.0 and r["has_high_end_facilities"] == 0


def test_expansion_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0, None)],
                               "size_num long, nr_rooms double, bathrooms double, toilets double, "
                               "inhabitants_in_neighborhood long")
    r = FE.expansion_features(df).first()
    assert r["room_utilization_ratio"] == 0.0 and r["floor_to_size"] == 0.0
    assert r["building_age"] == 0.0 and r["lease_ratio"] == 0.0


def test_transform_looks_amenity_counts_up(spark, monkeypatch):
    """Counts stand next to the state's places: a transform joins no amenities, and its counts are
    those of the radius join around the same places."""
    base, _, geo = base_listings(spark, SF_SMALL)
    rows = ML.materialize(base.limit(200).withColumns({
        "address": F.when(F.col("listing_id") % 5 == 0, F.lit("nowhere 0")).otherwise(F.col("address")),
        "neighborhood": F.when(F.col("listing_id") % 10 == 0, F.lit(None)).otherwise(F.col("neighborhood")),
        "postal_code_clean": F.when(F.col("listing_id") % 5 == 0, F.lit(None)).otherwise(F.col("postal_code_clean"))}))
    meta = FE.fit_features(rows.where(F.col("listing_id") % 2 == 0), geo=geo, amenities=amenity_points(spark, SF_SMALL))
    counts = meta.count_columns
    with monkeypatch.context() as m:
        m.setattr(FE.GJ, "amenity_counts", None)
        same = FE.FeatureMeta.from_json(meta.to_json())
        X = FE.transform_features(rows, same, keep=["listing_id", *counts]).collect()
    places = spark.createDataFrame([(r["listing_id"], r["lat"], r["lon"]) for r in X],
                                   "listing_id long, lat double, lon double")
    want = {r["listing_id"]: r for r in GJ.radius_counts(places, amenity_points(spark, SF_SMALL)).collect()}
    assert len(X) == 200 and any(r[c] for r in X for c in counts)
    assert sum((r["lat"], r["lon"]) == G.CITY_CENTER for r in X) > 0
    for r in X:
        assert [r[c] for c in counts] == [want[r["listing_id"]][c] for c in counts]
        assert [r[f"{c}_bin_encoded"] for c in counts] == [want[r["listing_id"]][f"{c}_bin_encoded"] for c in counts]
