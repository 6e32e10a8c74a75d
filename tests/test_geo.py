"""Radius join vs brute force, geocode dedup, fallback chain, distance bins."""

import math
import random

from pyspark.sql import functions as F

from parcel.functions import geo as G
from parcel.operators import geo_join as GJ


def _hav_m(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    dp, dl = math.radians(c - a), math.radians(d - b)
    h = math.sin(dp / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 6371000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_radius_counts_equal_brute_force(spark):
    rnd = random.Random(5)
    pts = [(i, 52.3 + rnd.random() * 0.15, 4.8 + rnd.random() * 0.2) for i in range(400)]
    pts.append((9999, None, None))
    types = ["school", "park", "hospital"]
    am = [(types[i % 3], 52.3 + rnd.random() * 0.15, 4.8 + rnd.random() * 0.2) for i in range(300)]
    radius = {"school": [0.5, 1.0], "park": [0.5, 1.0], "hospital": [1.0, 2.0], "tram_stop": [0.5]}
    pdf = spark.createDataFrame(pts, "listing_id long, lat double, lon double")
    adf = spark.createDataFrame(am, "amenity_type string, lat double, lon double")
    got = {r["listing_id"]: r for r in GJ.radius_counts(pdf, adf, radius).collect()}
    for pid, la, lo in pts:
        for t, rs in radius.items():
            for r in rs:
                want = 0 if la is None else sum(
                    1 for ty, a, b in am if ty == t and _hav_m(la, lo, a, b) / 1000.0 <= r)
                assert got[pid][GJ.count_column(t, r)] == want
    assert got[9999][GJ.count_column("school", 1.0) + "_bin_encoded"] == 0


def test_radius_counts_split_hot_cells_equal_brute_force(spark):
    # A third of the points and amenities in one cell; hot_rows=7 forces both sides to split.
    rnd = random.Random(11)
    pts = [(i, 52.3 + rnd.random() * 0.1, 4.8 + rnd.random() * 0.1) for i in range(200)]
    pts += [(1000 + i, 52.35 + rnd.random() * 0.002, 4.85 + rnd.random() * 0.002)
            for i in range(100)]
    am = [("school", 52.3 + rnd.random() * 0.1, 4.8 + rnd.random() * 0.1) for _ in range(100)]
    am += [("park", 52.35 + rnd.random() * 0.002, 4.85 + rnd.random() * 0.002)
           for _ in range(60)]
    am += [am[-1], am[-1]]  # duplicate amenities count with their multiplicity
    radius = {"school": [0.5, 1.0], "park": [0.5, 1.0]}
    pdf = spark.createDataFrame(pts, "listing_id long, lat double, lon double")
    adf = spark.createDataFrame(am, "amenity_type string, lat double, lon double")
    out = GJ.radius_counts(pdf, adf, radius, bins=False, hot_rows=7, chunk=5)
    got = {r["listing_id"]: r for r in out.collect()}
    assert len(got) == len(pts)
    for pid, la, lo in pts:
        for t, rs in radius.items():
            for r in rs:
                want = sum(1 for ty, a, b in am if ty == t and _hav_m(la, lo, a, b) / 1000.0 <= r)
                assert got[pid][GJ.count_column(t, r)] == want


def test_dedupe_prefers_smallest_lat_nulls_last(spark):
    rows = [("a", None, None), ("a", 52.5, 4.9), ("a", 52.4, None), ("b", None, None),
            ("c", 52.1, 4.1), ("c", 52.1, 4.0)]
    geo = spark.createDataFrame(rows, "address string, lat double, lon double")
    got = {r["address"]: (r["lat"], r["lon"]) for r in GJ.dedupe_geo_dim(geo).collect()}
    # 'a': first after sorting (lat, lon) nulls last is (52.4, None) -> dropped entirely.
    assert got == {"c": (52.1, 4.0)}


def test_fallback_chain_and_missing_flag(spark):
    rows = [(1, "1000AB", "N1", 52.30, 4.80), (2, "1000AB", "N1", None, None),
            (3, "9999ZZ", "N1", None, None), (4, "9999ZZ", "N9", None, None)]
    df = spark.createDataFrame(rows, "id long, postal_code_clean string, neighborhood string, "
                                     "lat double, lon double")
    out = GJ.fill_coordinates(df, GJ.centroids(df, "postal_code_clean"),
                              GJ.centroids(df, "neighborhood"))
    got = {r["id"]: (r["lat"], r["lon"], r["lat_lon_missing"]) for r in out.collect()}
    assert got[1] == (52.30, 4.80, 0) and got[2] == (52.30, 4.80, 1)
    assert got[3] == (52.30, 4.80, 1) and got[4] == (G.CITY_CENTER[0], G.CITY_CENTER[1], 1)


def test_distance_bins(spark):
    df = spark.createDataFrame([(G.CITY_CENTER[0], G.CITY_CENTER[1]), (52.39, 4.8923),
                                (52.6, 4.8923)], "lat double, lon double")
    assert [r[0] for r in df.select(G.distance_to_center_bin("lat", "lon")).collect()] == [0, 1, 5]
    bins = spark.createDataFrame([(0,), (1,), (2,), (3,), (6,), (11,)], "n int")
    assert [r[0] for r in bins.select(G.count_bin(F.col("n"))).collect()] == [0, 1, 1, 2, 3, 4]


def test_amenity_index_is_shared_by_batches(spark):
    """One index, built once, gives every batch the counts of a join of its own; chunks of dense
    cells hold about as many points as asked for."""
    rnd = random.Random(3)
    pts = [(i, 52.3 + rnd.random() * 0.1, 4.8 + rnd.random() * 0.1) for i in range(90)]
    am = [("school", 52.35 + rnd.random() * 0.01, 4.85 + rnd.random() * 0.01) for _ in range(300)]
    radius = {"school": [0.5, 1.0], "hospital": [2.0]}
    pdf = spark.createDataFrame(pts, "listing_id long, lat double, lon double")
    adf = spark.createDataFrame(am, "amenity_type string, lat double, lon double")
    index, spec = GJ.build_amenity_index(adf, radius, chunk=40)
    index = index.cache()
    assert index.count() > 9 and index.agg(F.max(F.size("points"))).first()[0] < 120
    whole = {r["listing_id"]: r for r in GJ.radius_counts(pdf, adf, radius).collect()}
    for b in range(3):
        for r in GJ.amenity_counts(pdf.where(F.col("listing_id") % 3 == b), index, spec).collect():
            assert r == whole[r["listing_id"]]
    assert GJ.amenity_counts(pdf.where("false"), index, spec).count() == 0
    none, spec = GJ.build_amenity_index(adf.where("false"), radius)
    assert all(r["count_school_within_1000m"] == 0 for r in GJ.amenity_counts(pdf, none, spec).collect())


def test_fold_centroids_are_those_of_the_other_folds(spark):
    rows = [(k, k % 4, f"p{k % 3}", 50.0 + k, float(k)) for k in range(30)] + [(99, 0, "p0", None, None)]
    df = spark.createDataFrame(rows, "id long, fold int, pc string, lat double, lon double")
    got = {(r["target"], r["pc"]): (r["pc_lat"], r["pc_lon"])
           for r in GJ.fold_centroids(df, "pc", "fold", [0, 1, 2, 3]).collect()}
    for f in range(4):
        want = {r["pc"]: (r["pc_lat"], r["pc_lon"]) for r in GJ.centroids(df.where(F.col("fold") != f), "pc").collect()}
        assert {p: v for (t, p), v in got.items() if t == f} == want
