"""Catalogue: ingest, parsing and nested flattening over the listing view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcel.functions import parse as P
from parcel.operators.fit import apply_impute, fit_impute, fit_vocabulary
from parcel.operators.levels import most_frequent
from parcel.operators.preprocess import facility_indicators
from parcel.plans.common import IMPUTE_DEFAULT, clean_listings, r2, r6
from parcel.plans.oracle_base import with_listing
from parcel.sources.listings import listing_view


def district_price_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: parse -> facilities -> impute (IM-1) -> drop missing target -> per district."""
    clean = clean_listings(spark, sf)
    filled = apply_impute(clean, fit_impute(clean, IMPUTE_DEFAULT))
    return (filled.where(F.col("price_num").isNotNull())
            .groupBy(P.prefix("postal_code_clean", 3).alias("postal_district"))
            .agg(F.count(F.lit(1)).alias("n_listings"),
                 r2(F.avg("price_num")).alias("avg_price"),
                 r6(F.avg("size_num")).alias("avg_size"),
                 F.sum("num_facilities").cast("bigint").alias("total_facilities"),
                 r6(F.avg("year_of_construction")).alias("avg_year")))


def parse_numeric_fields(spark: SparkSession, sf: str) -> DataFrame:
    """SC-1..6, SC-8, SC-16, SC-17 per listing."""
    raw = listing_view(spark, sf)
    return raw.select(
        "listing_id",
        P.parse_price("price").alias("price_num"),
        P.parse_price("contribution_vve").alias("contribution_vve_num"),
        P.parse_size("size").alias("size_num"),
        P.parse_size("external_storage").alias("external_storage_num"),
        P.parse_year("year_of_construction").alias("year_num"),
        P.to_int("nr_rooms").alias("rooms_int"),
        P.to_float_currency("price").alias("price_currency"),
        P.to_float("external_storage").alias("storage_float"),
        P.coerce_numeric("bathrooms").alias("bathrooms_num"),
        r6(P.to_float_pct(F.col("nr_rooms"))).alias("rooms_pct"),
    )


def parse_postal_city(spark: SparkSession, sf: str) -> DataFrame:
    """SC-7, SC-14."""
    raw = listing_view(spark, sf)
    code = P.postal_code_clean("postal_code")
    return raw.select("listing_id", code.alias("postal_code_clean"),
                      P.postal_city("postal_code").alias("city"),
                      P.prefix(code, 3).alias("postal_district"),
                      P.prefix(code, 4).alias("pc4"))


def floor_and_lease(spark: SparkSession, sf: str) -> DataFrame:
    """SC-9, SC-10 (current year fixed at 2025)."""
    raw = listing_view(spark, sf)
    own = F.get(F.col("ownership_situations"), 0)
    return raw.select("listing_id", P.extract_floor("located_on").alias("floor_level"),
                      P.extract_lease_years(own, 2025).alias("lease_years"))


def simplify_categories(spark: SparkSession, sf: str) -> DataFrame:
    """SC-11..13 on roof, ownership and outdoor location."""
    clean = clean_listings(spark, sf)
    return clean.select("listing_id", P.simplify_roof("roof_type").alias("roof"),
                        P.simplify_ownership("ownership_type").alias("ownership"),
                        P.simplify_location("location").alias("location_cat"))


def balcony_flag(spark: SparkSession, sf: str) -> DataFrame:
    """SC-15, SC-18."""
    raw = listing_view(spark, sf)
    return raw.select("listing_id", P.presence_flag("balcony").alias("balcony_flag"),
                      P.nullify_sentinels("contribution_vve").alias("contribution_clean"))


def facility_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """NE-1, NE-2: item frequencies over all listings."""
    clean = clean_listings(spark, sf)
    return (clean.select(F.explode("facilities_list").alias("facility"))
            .groupBy("facility").agg(F.count(F.lit(1)).alias("n_listings")))


def facility_indicators_q(spark: SparkSession, sf: str) -> DataFrame:
    """NE-2 fit -> NE-3 indicators -> NE-4 count, summed per district."""
    clean = clean_listings(spark, sf)
    vocab = most_frequent(fit_vocabulary(clean, "facilities_list"), 50)     # as many columns as asked for
    ind = facility_indicators(clean, vocab)
    cols = [c for c in ind.columns if c.startswith("has_")]
    return (ind.groupBy(P.prefix("postal_code_clean", 3).alias("postal_district"))
            .agg(*[F.sum(F.col(c).cast("int")).cast("bigint").alias(c) for c in cols],
                 F.sum("num_facilities").cast("bigint").alias("num_facilities")))


def outdoor_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """NE-5."""
    return clean_listings(spark, sf).select("listing_id", "location", "garden", "backyard",
                                            "garden_location")


def cadastral_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """NE-6, NE-7, NE-8."""
    return clean_listings(spark, sf).select("listing_id", "num_parcels", "parcels_concat",
                                            "ownership_type", "charges_summary")


def neighborhood_stats(spark: SparkSession, sf: str) -> DataFrame:
    """NE-9."""
    return clean_listings(spark, sf).select(
        "listing_id", "inhabitants_in_neighborhood",
        r6("families_with_children_pct").alias("families_with_children_pct"),
        r6("price_per_m2_neighborhood").alias("price_per_m2_neighborhood"))


QUERIES = {
    "district_price_summary": district_price_summary,
    "parse_numeric_fields": parse_numeric_fields,
    "parse_postal_city": parse_postal_city,
    "floor_and_lease": floor_and_lease,
    "simplify_categories": simplify_categories,
    "balcony_flag": balcony_flag,
    "facility_vocabulary": facility_vocabulary,
    "facility_indicators": facility_indicators_q,
    "outdoor_flatten": outdoor_flatten,
    "cadastral_flatten": cadastral_flatten,
    "neighborhood_stats": neighborhood_stats,
}

_MED = "(SELECT median(CAST({c} AS DOUBLE)) FROM C)"

ORACLE = {
    "district_price_summary": with_listing(f"""
SELECT substr(postal_code_clean, 1, 3) AS postal_district, count(*) AS n_listings,
  round(avg(price_num), 2) AS avg_price,
  round(avg(coalesce(CAST(size_num AS DOUBLE), {_MED.format(c='size_num')})), 6) AS avg_size,
  CAST(sum(len(facilities_list)) AS BIGINT) AS total_facilities,
  round(avg(coalesce(year_of_construction_d, {_MED.format(c='year_of_construction_d')})), 6)
    AS avg_year
FROM C WHERE price_num IS NOT NULL GROUP BY 1""", clean=True),
    "parse_numeric_fields": with_listing("""
SELECT listing_id, price_num, contribution_vve_num, size_num, external_storage_num,
  year_of_construction_num AS year_num,
  TRY_CAST(regexp_replace(nr_rooms, '[^0-9]', '', 'g') AS BIGINT) AS rooms_int,
  TRY_CAST(CASE WHEN strpos(regexp_replace(trim(price), '[^0-9.]', '', 'g'), '.') > 0
       THEN split_part(regexp_replace(trim(price), '[^0-9.]', '', 'g'), '.', 1) || '.' ||
            replace(substr(regexp_replace(trim(price), '[^0-9.]', '', 'g'),
                           strpos(regexp_replace(trim(price), '[^0-9.]', '', 'g'), '.') + 1),
                    '.', '')
       ELSE regexp_replace(trim(price), '[^0-9.]', '', 'g') END AS DOUBLE) AS price_currency,
  TRY_CAST(regexp_replace(external_storage, '[^0-9.]', '', 'g') AS DOUBLE) AS storage_float,
  bathrooms_d AS bathrooms_num,
  round(TRY_CAST(regexp_replace(nr_rooms, '[^0-9]', '', 'g') AS DOUBLE) / 100.0, 6) AS rooms_pct
FROM C""", clean=True),
    "parse_postal_city": with_listing("""
SELECT listing_id, postal_code_clean, city, substr(postal_code_clean, 1, 3) AS postal_district,
  substr(postal_code_clean, 1, 4) AS pc4 FROM C""", clean=True),
    "floor_and_lease": with_listing("""
SELECT listing_id,
  CASE WHEN located_on IS NULL OR located_on IN ('N/A', 'Begane grond') THEN 0
       ELSE coalesce(TRY_CAST(nullif(regexp_extract(located_on, '([0-9]+)', 1), '') AS INTEGER), 0)
       END AS floor_level,
  CASE WHEN ownership IS NULL OR trim(ownership) = '' OR ownership LIKE '%Volle eigendom%' THEN NULL
       WHEN regexp_extract(ownership, 'einddatum erfpacht: ([0-9]{2})-([0-9]{2})-([0-9]{4})', 3) = ''
         THEN NULL
       ELSE greatest(TRY_CAST(regexp_extract(ownership,
              'einddatum erfpacht: ([0-9]{2})-([0-9]{2})-([0-9]{4})', 3) AS INTEGER) - 2025, 0)
       END AS lease_years
FROM L"""),
    "simplify_categories": with_listing("""
SELECT listing_id,
  CASE WHEN roof_type IS NULL OR roof_type = 'N/A' THEN 'Unknown'
       WHEN roof_type LIKE '%Plat dak%' THEN 'Flat' WHEN roof_type LIKE '%Zadeldak%' THEN 'Saddle'
       WHEN roof_type LIKE '%Samengesteld dak%' THEN 'Composite'
       WHEN roof_type LIKE '%Mansarde%' THEN 'Mansard' ELSE 'Other' END AS roof,
  CASE WHEN trim(ownership_type) = '' THEN 'Unknown'
       WHEN ownership_type LIKE '%Volle eigendom%' THEN 'Full'
       WHEN ownership_type LIKE '%Erfpacht%' AND ownership_type LIKE '%Gemeentelijk%' THEN 'Municipal'
       WHEN ownership_type LIKE '%Erfpacht%' THEN 'Leasehold' ELSE 'Other' END AS ownership,
  CASE WHEN location IS NULL THEN 'Unknown' WHEN location LIKE '%centrum%' THEN 'Central'
       WHEN location LIKE '%woonwijk%' THEN 'Residential'
       WHEN location LIKE '%vrij uitzicht%' THEN 'OpenView'
       WHEN location LIKE '%park%' THEN 'Park' ELSE 'Other' END AS location_cat
FROM C""", clean=True),
    "balcony_flag": with_listing("""
SELECT listing_id, CASE WHEN balcony IS NULL OR balcony = 'N/A' THEN 0 ELSE 1 END AS balcony_flag,
  CASE WHEN trim(contribution_vve) IN ('N/A', '') THEN NULL ELSE contribution_vve END
    AS contribution_clean
FROM L"""),
    "facility_vocabulary": with_listing("""
SELECT facility, count(*) AS n_listings FROM (SELECT unnest(facilities_list) AS facility FROM C)
GROUP BY facility""", clean=True),
    "facility_indicators": with_listing("""
SELECT substr(postal_code_clean, 1, 3) AS postal_district,
  CAST(sum(CASE WHEN list_contains(facilities_list, 'lift') THEN 1 ELSE 0 END) AS BIGINT) AS has_lift,
  CAST(sum(CASE WHEN list_contains(facilities_list, 'schuifpui') THEN 1 ELSE 0 END) AS BIGINT)
    AS has_schuifpui,
  CAST(sum(CASE WHEN list_contains(facilities_list, 'tv kabel') THEN 1 ELSE 0 END) AS BIGINT)
    AS has_tv_kabel,
  CAST(sum(CASE WHEN list_contains(facilities_list, 'sauna') THEN 1 ELSE 0 END) AS BIGINT) AS has_sauna,
  CAST(sum(CASE WHEN list_contains(facilities_list, 'zonnepanelen') THEN 1 ELSE 0 END) AS BIGINT)
    AS has_zonnepanelen,
  CAST(sum(CASE WHEN list_contains(facilities_list, 'airconditioning') THEN 1 ELSE 0 END) AS BIGINT)
    AS has_airconditioning,
  CAST(sum(len(facilities_list)) AS BIGINT) AS num_facilities
FROM C GROUP BY 1""", clean=True),
    "outdoor_flatten": with_listing(
        "SELECT listing_id, location, garden, backyard, garden_location FROM C", clean=True),
    "cadastral_flatten": with_listing("""
SELECT listing_id, CAST(n_parcels AS INTEGER) AS num_parcels, parcels_joined AS parcels_concat,
  ownership_type, charges_joined AS charges_summary FROM C""", clean=True),
    "neighborhood_stats": with_listing("""
SELECT listing_id, nb_inhabitants AS inhabitants_in_neighborhood,
  round(nb_families, 6) AS families_with_children_pct,
  round(nb_price_m2, 6) AS price_per_m2_neighborhood FROM L"""),
}
