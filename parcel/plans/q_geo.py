"""Catalogue: geo lookups, fallbacks, distance bins, radius join, area tables, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcel.functions import geo as G
from parcel.functions import parse as P
from parcel.operators import geo_join as GJ
from parcel.operators import split as SP
from parcel.plans.common import clean_listings, r2, r6
from parcel.plans.oracle_base import with_listing
from parcel.plans.oracle_features import geo_ctes, hav
from parcel.sources.listings import AMENITY_TYPES, amenity_points, geo_dimension, listing_view
from parcel.sources.store import scratch_table
from parcel.sources.tables import table


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    # The listings are derived once; everything below reads the narrow written columns.
    base = scratch_table(clean_listings(spark, sf).select(
        "listing_id", "address", "postal_code_clean", "neighborhood", "lat", "lon", "price", "size"))
    geo = GJ.dedupe_geo_dim(geo_dimension(base))
    att = scratch_table(SP.with_split(GJ.attach_coordinates(base.select(
        "listing_id", "address", "postal_code_clean", "neighborhood"), geo), "listing_id", 0.2, 0.1))
    train = att.where(F.col("split") == "train")
    return GJ.fill_coordinates(att, GJ.centroids(train, "postal_code_clean"),
                               GJ.centroids(train, "neighborhood"))


def geo_lookup_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """WN-1 dedup, JN-1 lookup, AG-1 centroids of the training split, JN-2 fallback chain, GE-2 bin."""
    f = _filled(spark, sf)
    return f.select("listing_id", r6("lat").alias("lat"), r6("lon").alias("lon"),
                    "lat_lon_missing",
                    G.distance_to_center_bin("lat", "lon").alias("dist_to_center_bin_encoded"))


def centre_distance_bins(spark: SparkSession, sf: str) -> DataFrame:
    """GE-1 haversine + GE-2 right-closed bins on raw coordinates."""
    raw = listing_view(spark, sf)
    d = G.haversine_m("lat", "lon", G.CITY_CENTER[0], G.CITY_CENTER[1])
    return raw.select("listing_id", F.round(d, 3).alias("dist_to_center_m"),
                      G.cut(d, G.DISTANCE_BIN_EDGES).alias("dist_bin"))


def distance_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """GE-4: distance bin one-hot, missing coordinates in bin 0 ('missing')."""
    raw = listing_view(spark, sf)
    code = F.coalesce(G.distance_to_center_bin("lat", "lon"), F.lit(0))
    return raw.select("listing_id", *[(code == i).cast("int").alias(f"dist_bin_{i}")
                                      for i in range(len(G.DISTANCE_BIN_LABELS))])


def amenity_radius_counts(spark: SparkSession, sf: str) -> DataFrame:
    """JN-3 grid-cell radius join + GE-3 count bins."""
    pts = listing_view(spark, sf).select("listing_id", "lat", "lon")
    out = GJ.radius_counts(pts, amenity_points(spark, sf))
    return out.drop("lat", "lon")


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    clean = clean_listings(spark, sf)
    lat = F.col("lat")
    return (clean.groupBy(P.prefix("postal_code_clean", 4).alias("pc4"))
            .agg(F.count("price_num").alias("n_listings"),
                 r2(F.avg("price_num")).alias("avg_price"),
                 r6(F.avg("size_num")).alias("avg_size"),
                 r6(F.avg(P.safe_ratio("price_num", "size_num"))).alias("avg_price_m2"),
                 r6(F.avg("year_of_construction_num")).alias("avg_year"),
                 F.avg(lat).alias("c_lat"), F.avg("lon").alias("c_lon"),
                 G.box_km2(F.min(lat), F.max(lat), F.min("lon"), F.max("lon")).alias("area_km2")))


def area_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AG-2 multi-aggregate per PC4 area + GE-5 planar centroid distance and listings per km2 (of the
    box around the area's listings)."""
    a = _areas(spark, sf)
    return a.select("pc4", "n_listings", "avg_price", "avg_size", "avg_price_m2", "avg_year",
                    r6("c_lat").alias("centroid_lat"), r6("c_lon").alias("centroid_lon"),
                    r6(G.planar_km("c_lat", "c_lon", G.CITY_CENTER[0], G.CITY_CENTER[1]))
                    .alias("centre_km"),
                    r6(P.safe_ratio("n_listings", "area_km2")).alias("listings_per_km2"))


def address_having(spark: SparkSession, sf: str) -> DataFrame:
    """AG-3: per-address aggregates kept when the address has >= 3 priced listings."""
    clean = clean_listings(spark, sf)
    return (clean.groupBy("address")
            .agg(F.count("price_num").alias("n_listings"), r2(F.avg("price_num")).alias("avg_price"))
            .where(F.col("n_listings") >= 3))


def area_left_merge(spark: SparkSession, sf: str) -> DataFrame:
    """JN-4: area table left join cluster labels, missing cluster -> -1."""
    a = _areas(spark, sf)
    # areas without a numeric code have no cluster
    clusters = (a.where(F.col("pc4").try_cast("int").isNotNull())
                .select("pc4", (F.col("pc4").try_cast("int") % 4).alias("cluster")))
    return (a.select("pc4", "n_listings").join(clusters, "pc4", "left")
            .na.fill(-1, ["cluster"]))


def listings_without_details(spark: SparkSession, sf: str) -> DataFrame:
    """JN-6: dimension keys with no facts (listings without line items; left anti join)."""
    listings = listing_view(spark, sf).select("listing_id", "address")
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("listing_id"))
    return listings.join(items, "listing_id", "left_anti")


def key_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    """ST-2: set difference of keys (EXCEPT DISTINCT)."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    return orders.subtract(items)


def failed_lookup_semi(spark: SparkSession, sf: str) -> DataFrame:
    """JN-7: listings whose address lookup failed (left semi against the failed keys)."""
    raw = listing_view(spark, sf)
    failed = raw.where(F.col("lat").isNull()).select("address")
    return raw.select("listing_id", "address").join(failed, "address", "left_semi")


def split_feature_merge(spark: SparkSession, sf: str) -> DataFrame:
    """JN-5: a separately computed feature frame merged onto each split by id."""
    raw = SP.with_split(listing_view(spark, sf).select("listing_id", "lat", "lon"),
                        "listing_id", 0.2, 0.1)
    feats = raw.select("listing_id",
                       G.distance_to_center_bin("lat", "lon").alias("dist_bin"))
    return raw.select("listing_id", "split").join(feats, "listing_id", "left")


def cluster_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """AG-13: min / max per cluster (postal district as the cluster)."""
    clean = clean_listings(spark, sf)
    return (clean.groupBy(P.prefix("postal_code_clean", 3).alias("cluster"))
            .agg(F.min("price_num").alias("min_price"), F.max("price_num").alias("max_price"),
                 F.min("size_num").alias("min_size"), F.max("size_num").alias("max_size")))


QUERIES = {
    "geo_lookup_fallback": geo_lookup_fallback,
    "centre_distance_bins": centre_distance_bins,
    "distance_one_hot": distance_one_hot,
    "amenity_radius_counts": amenity_radius_counts,
    "area_stats": area_stats,
    "address_having": address_having,
    "area_left_merge": area_left_merge,
    "listings_without_details": listings_without_details,
    "key_set_difference": key_set_difference,
    "failed_lookup_semi": failed_lookup_semi,
    "split_feature_merge": split_feature_merge,
    "cluster_ranges": cluster_ranges,
}


def dist_bin(d: str) -> str:
    return (f"CASE WHEN {d} > -1 AND {d} <= 0 THEN 0 WHEN {d} > 0 AND {d} <= 2000 THEN 1 "
            f"WHEN {d} > 2000 AND {d} <= 5000 THEN 2 WHEN {d} > 5000 AND {d} <= 10000 THEN 3 "
            f"WHEN {d} > 10000 AND {d} <= 20000 THEN 4 WHEN {d} > 20000 THEN 5 END")


def count_bin(c: str) -> str:
    return (f"CASE WHEN {c} > -1 AND {c} <= 0 THEN 0 WHEN {c} > 0 AND {c} <= 2 THEN 1 "
            f"WHEN {c} > 2 AND {c} <= 5 THEN 2 WHEN {c} > 5 AND {c} <= 10 THEN 3 "
            f"WHEN {c} > 10 THEN 4 END")


CENTER = "52.3730", "4.8923"
HAV_CENTER = hav("lat", "lon", CENTER[0], CENTER[1])

_AMEN = ("A AS (SELECT s_suppkey AS amenity_id, CASE s_suppkey % 8 "
         + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(AMENITY_TYPES))
         + " END AS amenity_type, 52.3e0 + CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 10000e0 AS a_lat,"
         " 4.77e0 + CAST((s_suppkey * 53) % 1000 AS DOUBLE) / 5555e0 AS a_lon FROM supplier)")


def _radius_oracle() -> str:
    cols, outs = [], []
    for t, rs in GJ.AMENITY_RADIUS_KM.items():
        for r in rs:
            name = GJ.count_column(t, r)
            cols.append(f"CAST(coalesce(sum(CASE WHEN amenity_type = '{t}' AND d_km <= {r} "
                        f"THEN 1 ELSE 0 END), 0) AS BIGINT) AS {name}")
            outs.append(f"{name}, {count_bin(name)} AS {name}_bin_encoded")
    d = hav("P.lat", "P.lon", "A.a_lat", "A.a_lon")
    return with_listing(f""",
{_AMEN},
D AS (SELECT L.listing_id, A.amenity_type, {hav('L.lat', 'L.lon', 'A.a_lat', 'A.a_lon')} / 1000.0
      AS d_km FROM L JOIN A ON TRUE WHERE L.lat IS NOT NULL AND L.lon IS NOT NULL),
CNT AS (SELECT L.listing_id, {", ".join(cols)} FROM L LEFT JOIN D USING (listing_id)
        GROUP BY L.listing_id)
SELECT listing_id, {", ".join(outs)} FROM CNT""".replace(d, d)).replace("\n),\n", "\n),\n")


_AREAS = """
, AR AS (SELECT substr(postal_code_clean, 1, 4) AS pc4, count(price_num) AS n_listings,
    round(avg(price_num), 2) AS avg_price, round(avg(size_num), 6) AS avg_size,
    round(avg(CAST(price_num AS DOUBLE) / nullif(CAST(size_num AS DOUBLE), 0)), 6) AS avg_price_m2,
    round(avg(year_of_construction_num), 6) AS avg_year, avg(lat) AS c_lat, avg(lon) AS c_lon,
    (max(lat) - min(lat)) * 111.0 * (max(lon) - min(lon)) * 111.0 AS area_km2
  FROM C GROUP BY 1)
"""


def _fix(sql: str) -> str:
    return sql.replace("\n)\n, ", "\n),\n").replace("\n)\n,\n", "\n),\n")


ORACLE = {
    "geo_lookup_fallback": _fix(with_listing(f"""
, {geo_ctes("C", counts=False)}
SELECT listing_id, round(lat, 6) AS lat, round(lon, 6) AS lon, lat_lon_missing,
  {dist_bin(HAV_CENTER)} AS dist_to_center_bin_encoded FROM FL""", clean=True)),
    "centre_distance_bins": with_listing(f"""
SELECT listing_id, round({HAV_CENTER}, 3) AS dist_to_center_m, {dist_bin(HAV_CENTER)} AS dist_bin
FROM L"""),
    "distance_one_hot": with_listing(
        ", B AS (SELECT listing_id, coalesce(" + dist_bin(HAV_CENTER) + ", 0) AS code FROM L)\n"
        "SELECT listing_id, " + ", ".join(f"CAST(code = {i} AS INTEGER) AS dist_bin_{i}"
                                          for i in range(6)) + " FROM B").replace(
        "\n), B AS", "\n),\nB AS"),
    "amenity_radius_counts": _radius_oracle(),
    "area_stats": _fix(with_listing(_AREAS + """
SELECT pc4, n_listings, avg_price, avg_size, avg_price_m2, avg_year, round(c_lat, 6) AS centroid_lat,
  round(c_lon, 6) AS centroid_lon,
  round(sqrt((c_lat - 52.3730) * (c_lat - 52.3730) + (c_lon - 4.8923) * (c_lon - 4.8923)) * 111.0, 6)
    AS centre_km, round(n_listings / nullif(area_km2, 0), 6) AS listings_per_km2 FROM AR""", clean=True)),
    "address_having": with_listing("""
SELECT address, count(price_num) AS n_listings, round(avg(price_num), 2) AS avg_price FROM C
GROUP BY address HAVING count(price_num) >= 3""", clean=True),
    "area_left_merge": _fix(with_listing(_AREAS + """
, CL AS (SELECT pc4, TRY_CAST(pc4 AS INTEGER) % 4 AS cluster FROM AR WHERE TRY_CAST(pc4 AS INTEGER) IS NOT NULL)
SELECT pc4, n_listings, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster
FROM AR LEFT JOIN CL USING (pc4)""", clean=True)),
    "listings_without_details": with_listing("""
SELECT listing_id, address FROM L
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = listing_id)"""),
    "key_set_difference": """
SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey AS key FROM lineitem""",
    "failed_lookup_semi": with_listing("""
SELECT listing_id, address FROM L WHERE address IN (SELECT address FROM L WHERE lat IS NULL)"""),
    "split_feature_merge": with_listing(f"""
SELECT listing_id,
  CASE WHEN {'(CAST((' + "'0x'" + ' || substr(md5(CAST(listing_id AS VARCHAR) || ' + "':42'" + '), 1, 8)) AS BIGINT) / 4294967296.0)'} < 0.2 THEN 'test'
       WHEN {'(CAST((' + "'0x'" + ' || substr(md5(CAST(listing_id AS VARCHAR) || ' + "':42'" + '), 1, 8)) AS BIGINT) / 4294967296.0)'} < 0.3 THEN 'val'
       ELSE 'train' END AS split,
  {dist_bin(HAV_CENTER)} AS dist_bin FROM L"""),
    "cluster_ranges": with_listing("""
SELECT substr(postal_code_clean, 1, 3) AS cluster, min(price_num) AS min_price,
  max(price_num) AS max_price, min(size_num) AS min_size, max(size_num) AS max_size
FROM C GROUP BY 1""", clean=True),
}
