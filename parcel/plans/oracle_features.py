"""DuckDB formulation of the whole feature pipeline (impute -> split -> fit on train ->
transform), in long form so data-dependent columns (log columns, one-hot levels) are rows."""

from parcel.operators.features import DEFAULT_FLAGS
from parcel.operators.geo_join import AMENITY_RADIUS_KM, count_column
from parcel.plans.oracle_base import with_listing

_HASH = ("(CAST(('0x' || substr(md5(CAST(listing_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT)"
         " / 4294967296.0)")
NUMERIC = {  # feature name -> expression over the imputed base row
    "size_num": "size_i", "contribution_vve_num": "contrib_i", "external_storage_num": "storage_i",
    "nr_rooms": "nr_rooms_d", "bathrooms": "bathrooms_d", "toilets": "toilets_d",
    "num_facilities": "CAST(len(facilities_list) AS DOUBLE)",
    "inhabitants_in_neighborhood": "CAST(nb_inhabitants AS DOUBLE)",
    "families_with_children_pct": "nb_families", "price_per_m2_neighborhood": "nb_price_m2"}
PRESENT = {"has_lift": "lift", "has_schuifpui": "schuifpui", "has_tv_kabel": "tv kabel",
           "has_sauna": "sauna", "has_zonnepanelen": "zonnepanelen",
           "has_airconditioning": "airconditioning"}
CATS = {
    "postal_district": "substr(postal_code_clean, 1, 3)",
    "status_cat": "coalesce(status, 'N/A')",
    "roof_cat": """CASE WHEN roof_type IS NULL OR roof_type = 'N/A' THEN 'Unknown'
       WHEN roof_type LIKE '%Plat dak%' THEN 'Flat' WHEN roof_type LIKE '%Zadeldak%' THEN 'Saddle'
       WHEN roof_type LIKE '%Samengesteld dak%' THEN 'Composite'
       WHEN roof_type LIKE '%Mansarde%' THEN 'Mansard' ELSE 'Other' END""",
    "ownership_cat": """CASE WHEN trim(ownership_type) = '' THEN 'Unknown'
       WHEN ownership_type LIKE '%Volle eigendom%' THEN 'Full'
       WHEN ownership_type LIKE '%Erfpacht%' AND ownership_type LIKE '%Gemeentelijk%' THEN 'Municipal'
       WHEN ownership_type LIKE '%Erfpacht%' THEN 'Leasehold' ELSE 'Other' END""",
    "location_cat": """CASE WHEN location IS NULL THEN 'Unknown' WHEN location LIKE '%centrum%' THEN 'Central'
       WHEN location LIKE '%woonwijk%' THEN 'Residential'
       WHEN location LIKE '%vrij uitzicht%' THEN 'OpenView'
       WHEN location LIKE '%park%' THEN 'Park' ELSE 'Other' END""",
    "garden_cat": "coalesce(garden, 'None')",
}


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin(radians({lon2} - {lon1}) / 2), 2)")
    return f"(6371000.0 * 2 * atan2(sqrt({a}), sqrt(1 - ({a}))))"


def geo_ctes(rows: str, train: str = "TRUE", counts: bool = True) -> str:
    """Coordinates of ``rows`` (listing_id, address, postal_code_clean, neighborhood): FL with
    centroids fitted on the training split where ``train`` holds, and CNT with amenity counts (needs A)."""
    out = f"""OB AS (SELECT address, lat + (k % 3) * 0.001e0 AS lat, lon + (k % 2) * 0.002e0 AS lon FROM L
        WHERE lat IS NOT NULL AND cu % 100 NOT IN (7, 57) AND neighborhood <> 'NATION_7' AND k % 5 <> 0),
G AS (SELECT address, lat AS g_lat, lon AS g_lon FROM (SELECT *, row_number() OVER (
        PARTITION BY address ORDER BY lat, lon) AS rn FROM OB) WHERE rn = 1),
ATT AS (SELECT R.listing_id, R.address, R.postal_code_clean, R.neighborhood, G.g_lat, G.g_lon,
          {_HASH} >= 0.3 AND {train} AS fitted FROM {rows} R LEFT JOIN G USING (address)),
PC AS (SELECT postal_code_clean, avg(g_lat) AS p_lat, avg(g_lon) AS p_lon FROM ATT
       WHERE fitted AND g_lat IS NOT NULL AND postal_code_clean IS NOT NULL GROUP BY postal_code_clean),
NB AS (SELECT neighborhood, avg(g_lat) AS n_lat, avg(g_lon) AS n_lon FROM ATT
       WHERE fitted AND g_lat IS NOT NULL AND neighborhood IS NOT NULL GROUP BY neighborhood),
FL AS (SELECT listing_id, CAST(g_lat IS NULL OR g_lon IS NULL AS INTEGER) AS lat_lon_missing,
         CASE WHEN g_lat IS NOT NULL AND g_lon IS NOT NULL THEN g_lat WHEN p_lat IS NOT NULL THEN p_lat
              WHEN n_lat IS NOT NULL THEN n_lat ELSE 52.3730 END AS lat,
         CASE WHEN g_lat IS NOT NULL AND g_lon IS NOT NULL THEN g_lon WHEN p_lat IS NOT NULL THEN p_lon
              WHEN n_lat IS NOT NULL THEN n_lon ELSE 4.8923 END AS lon
       FROM ATT LEFT JOIN PC USING (postal_code_clean) LEFT JOIN NB USING (neighborhood))"""
    if not counts:
        return out
    within = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN amenity_type = '{t}' AND d_km <= {r} THEN 1 ELSE 0 END), 0) AS BIGINT)"
        f" AS {count_column(t, r)}" for t, rs in AMENITY_RADIUS_KM.items() for r in rs)
    # amenities around every place where a listing is, by comparing all of them
    return out + f""",
PL AS (SELECT DISTINCT lat, lon FROM FL),
DP AS (SELECT PL.lat, PL.lon, A.amenity_type, {hav("PL.lat", "PL.lon", "A.a_lat", "A.a_lon")} / 1000.0 AS d_km
       FROM PL JOIN A ON TRUE),
PN AS (SELECT lat, lon, {within} FROM DP GROUP BY lat, lon),
CNT AS (SELECT FL.listing_id, PN.* EXCLUDE (lat, lon) FROM FL JOIN PN ON PN.lat = FL.lat AND PN.lon = FL.lon)"""


def geo_profile_rows() -> dict[str, str]:
    """Feature name -> expression over FL and CNT, for the features from coordinates."""
    from parcel.plans.q_geo import HAV_CENTER, count_bin, dist_bin
    bins = {f"{count_column(t, r)}_bin_encoded": count_bin(count_column(t, r))
            for t, rs in AMENITY_RADIUS_KM.items() for r in rs}
    return {"lat": "lat", "lon": "lon", "lat_lon_missing": "lat_lon_missing",
            "dist_to_center_bin_encoded": dist_bin(HAV_CENTER), **bins}


def geo_rows_sql() -> str:
    """The features from coordinates, per listing with a price."""
    from parcel.plans.q_geo import _AMEN
    exprs = geo_profile_rows()
    exprs |= {"lat": "round(lat, 6)", "lon": "round(lon, 6)"}
    counts = ", ".join(count_column(t, r) for t, rs in AMENITY_RADIUS_KM.items() for r in rs)
    sql = f"""
, {_AMEN},
{geo_ctes("C", "price_num IS NOT NULL")}
SELECT FL.listing_id, CASE WHEN {_HASH} < 0.2 THEN 'test' WHEN {_HASH} < 0.3 THEN 'val' ELSE 'train' END AS split,
  {", ".join(f"{e} AS {n}" for n, e in exprs.items())}, {counts}
FROM FL JOIN CNT USING (listing_id) JOIN C USING (listing_id, lat, lon)"""
    sql = sql.replace("JOIN C USING (listing_id, lat, lon)",
                      "JOIN (SELECT listing_id FROM C WHERE price_num IS NOT NULL) USING (listing_id)")
    return with_listing(sql, clean=True).replace("\n)\n, ", "\n),\n", 1)


def feature_profile_sql() -> str:
    flags = ",\n    ".join(
        (f"CAST(list_contains(facilities_list, '{PRESENT[f]}') AS DOUBLE) AS {f}"
         if f in PRESENT else f"0.0 AS {f}") for f in DEFAULT_FLAGS)
    raw_num = ",\n    ".join(f"{expr} AS r_{name}" for name, expr in NUMERIC.items())
    med = ", ".join(f"median(r_{n}) AS m_{n}" for n in NUMERIC)
    filled = ",\n    ".join(f"coalesce(r_{n}, m_{n}) AS {n}" for n in NUMERIC)
    cats = ",\n    ".join(f"{e} AS {n}" for n, e in CATS.items())
    logsel = "\nUNION ALL\n".join(
        f"SELECT '{n}' AS name, (min({n}) > 0 AND abs(skewness({n})) > 0.5) AS sel FROM T "
        f"WHERE split = 'train'" for n in NUMERIC)
    base_feats = (list(NUMERIC) + DEFAULT_FLAGS +
                  ["floor_level", "lease_years_remaining", "backyard_num", "balcony_flag",
                   "energy_label_encoded", "luxury_score", "num_luxury_facilities",
                   "has_high_end_facilities", "luxury_density", "size_per_luxury",
                   "luxury_x_price_m2", "luxury_x_size", "luxury_x_inhabitants",
                   "room_utilization_ratio", "floor_to_size", "external_storage_ratio",
                   "inhabitants_per_room", "neighborhood_facility_density", "building_age",
                   "old_house_flag", "lease_ratio", "has_outdoor_space", "outdoor_area_ratio"])
    long_base = "\nUNION ALL\n".join(
        f"SELECT split, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM X" for f in base_feats)
    long_log = "\nUNION ALL\n".join(
        f"SELECT split, 'log_{n}' AS feature, ln(1 + {n}) AS v FROM X "
        f"WHERE (SELECT sel FROM LOGSEL WHERE name = '{n}')" for n in NUMERIC)
    from parcel.plans.q_geo import _AMEN
    geo = geo_profile_rows()
    geo_list = ", ".join(f"{e} AS g_{n}" for n, e in geo.items())
    long_geo = "\nUNION ALL\n".join(
        f"SELECT split, '{n}' AS feature, CAST(g_{n} AS DOUBLE) AS v FROM GX" for n in geo)
    sql = f""",
I AS (
  SELECT C.*,
    coalesce(CAST(size_num AS DOUBLE), (SELECT median(CAST(size_num AS DOUBLE)) FROM C)) AS size_i,
    coalesce(CAST(external_storage_num AS DOUBLE), 0.0) AS storage_i,
    coalesce(year_of_construction_d, (SELECT median(year_of_construction_d) FROM C)) AS year_i,
    coalesce(CAST(contribution_vve_num AS DOUBLE), 0.0) AS contrib_i
  FROM C),
B AS (
  SELECT listing_id,
    CASE WHEN {_HASH} < 0.2 THEN 'test' WHEN {_HASH} < 0.3 THEN 'val' ELSE 'train' END AS split,
    {raw_num},
    {flags},
    CAST(CASE WHEN located_on IS NULL OR located_on IN ('N/A', 'Begane grond') THEN 0
         ELSE coalesce(TRY_CAST(nullif(regexp_extract(located_on, '([0-9]+)', 1), '') AS INTEGER), 0)
         END AS DOUBLE) AS floor_level,
    CAST(coalesce(CASE WHEN trim(ownership_type) = '' OR ownership_type LIKE '%Volle eigendom%'
              THEN NULL
         WHEN regexp_extract(ownership_type, 'einddatum erfpacht: ([0-9]{{2}})-([0-9]{{2}})-([0-9]{{4}})', 3) = ''
              THEN NULL
         ELSE greatest(TRY_CAST(regexp_extract(ownership_type,
              'einddatum erfpacht: ([0-9]{{2}})-([0-9]{{2}})-([0-9]{{4}})', 3) AS INTEGER) - 2025, 0)
         END, 0) AS DOUBLE) AS lease_years_remaining,
    coalesce(TRY_CAST(regexp_replace(backyard, '[^0-9.]', '', 'g') AS DOUBLE), 0.0) AS backyard_num,
    CAST(CASE WHEN balcony IS NULL OR balcony = 'N/A' THEN 0 ELSE 1 END AS DOUBLE) AS balcony_flag,
    CAST(CASE coalesce(energy_label, 'G') WHEN 'G' THEN 0 WHEN 'F' THEN 1 WHEN 'E' THEN 2
         WHEN 'D' THEN 3 WHEN 'C' THEN 4 WHEN 'B' THEN 5 WHEN 'A' THEN 6 WHEN 'A+' THEN 7
         WHEN 'A++' THEN 8 WHEN 'A+++' THEN 9 WHEN 'A++++' THEN 10 END AS DOUBLE)
      AS energy_label_encoded,
    year_i,
    {cats}
  FROM I WHERE price_num IS NOT NULL),
M AS (SELECT {med} FROM B WHERE split = 'train'),
T AS (SELECT B.*, {filled} FROM B, M),
LOGSEL AS ({logsel}),
X0 AS (
  SELECT T.*,
    has_lift * 1.0 + has_sauna * 2.0 + has_domotica * 1.5 + has_airconditioning * 1.0
      + has_zwembad * 3.0 AS luxury_score,
    has_lift + has_sauna + has_domotica + has_airconditioning + has_zwembad AS num_luxury_facilities,
    2025.0 - year_i AS age
  FROM T),
X AS (
  SELECT X0.*,
    CAST(num_luxury_facilities >= 3 AS INTEGER) AS has_high_end_facilities,
    luxury_score / CASE WHEN nr_rooms = 0 THEN 1.0 ELSE nr_rooms END AS luxury_density,
    size_num / (luxury_score + 1) AS size_per_luxury,
    luxury_score * price_per_m2_neighborhood AS luxury_x_price_m2,
    luxury_score * size_num AS luxury_x_size,
    luxury_score * inhabitants_in_neighborhood AS luxury_x_inhabitants,
    coalesce((size_num + bathrooms + toilets) / nullif(nr_rooms, 0), 0) AS room_utilization_ratio,
    coalesce(floor_level / nullif(size_num, 0), 0) AS floor_to_size,
    coalesce(external_storage_num / nullif(size_num, 0), 0) AS external_storage_ratio,
    coalesce(inhabitants_in_neighborhood / nullif(nr_rooms, 0), 0) AS inhabitants_per_room,
    coalesce(num_facilities / nullif(inhabitants_in_neighborhood, 0), 0)
      AS neighborhood_facility_density,
    coalesce(age, 0) AS building_age,
    coalesce(CAST(age > 100 AS INTEGER), 0) AS old_house_flag,
    coalesce(lease_years_remaining / nullif(age, 0), 0) AS lease_ratio,
    CAST(balcony_flag > 0 OR backyard_num > 0 AS INTEGER) AS has_outdoor_space,
    coalesce((balcony_flag + backyard_num) / nullif(size_num, 0), 0) AS outdoor_area_ratio
  FROM X0),
XC AS (SELECT listing_id, split, {", ".join(CATS)} FROM X),
U AS (SELECT * FROM XC UNPIVOT INCLUDE NULLS (level FOR name IN ({", ".join(CATS)}))),
LV AS (SELECT name, level, row_number() OVER (PARTITION BY name ORDER BY level) AS rn
       FROM (SELECT DISTINCT name, level FROM U WHERE split = 'train' AND level IS NOT NULL)),
SH AS (SELECT LV.name, LV.level,
         avg(CASE WHEN U.level = LV.level THEN 1.0 ELSE 0.0 END) AS share
       FROM LV JOIN U ON U.name = LV.name WHERE U.split = 'train' AND LV.rn > 1
       GROUP BY LV.name, LV.level),
KEPT AS (SELECT name, level FROM SH WHERE greatest(share, 1 - share) < 0.95),
OH AS (SELECT U.split, KEPT.name || '_' || KEPT.level AS feature,
         CASE WHEN U.level = KEPT.level THEN 1.0 ELSE 0.0 END AS v
       FROM KEPT JOIN U ON U.name = KEPT.name),
{_AMEN},
{geo_ctes("C", "price_num IS NOT NULL")},
GX AS (SELECT split, {geo_list} FROM X JOIN (SELECT * FROM FL JOIN CNT USING (listing_id)) USING (listing_id)),
LONGF AS ({long_base}
UNION ALL
{long_log}
UNION ALL
SELECT split, feature, v FROM OH
UNION ALL
{long_geo}),
NS AS (SELECT split, count(*) AS n FROM X GROUP BY split)
SELECT LONGF.split, max(NS.n) AS n, feature, round(avg(v), 4) AS avg_value
FROM LONGF JOIN NS ON NS.split = LONGF.split GROUP BY LONGF.split, feature"""
    return with_listing(sql, clean=True).replace("\n)\n,\nI AS", "\n),\nI AS")
