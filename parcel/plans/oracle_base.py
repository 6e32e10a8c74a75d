"""DuckDB text of the listing view, shared by the oracle queries.

This is an independent formulation of ``parcel.sources.listings``: nested
fields are not built; their flattened values are computed directly from
the same integer keys, so the oracle checks the Spark flattening logic.
"""

LISTING_CTE = r"""
L AS (
  SELECT
    o_orderkey AS listing_id, o_orderkey AS k, c_custkey AS cu, n_name AS neighborhood,
    o_orderstatus AS status,
    concat('Straat ', c_custkey) AS address,
    CASE WHEN o_orderkey % 29 = 0 THEN 'Prijs op aanvraag'
         ELSE concat('€ ', CAST(floor(o_totalprice) AS BIGINT), ' k.k.') END AS price,
    CASE WHEN o_orderkey % 9 = 0 THEN 'N/A'
         ELSE concat('€ ', 50 + o_orderkey % 400, ' per maand') END AS contribution_vve,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat(20 + o_orderkey % 180, ' m²') END AS size,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat(o_orderkey % 15, ' m²') END AS external_storage,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Voor 1906' WHEN o_orderkey % 13 = 0 THEN 'Na 2020'
         ELSE CAST(1900 + o_orderkey % 120 AS VARCHAR) END AS year_of_construction,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey % 8 AS VARCHAR) END AS nr_rooms,
    CAST(o_orderkey % 3 AS VARCHAR) AS bathrooms,
    CAST(1 + o_orderkey % 2 AS VARCHAR) AS toilets,
    CAST(o_orderkey % 5 AS VARCHAR) AS bedrooms,
    CASE o_orderkey % 5 WHEN 0 THEN 'Lift, schuifpui en TV kabel' WHEN 1 THEN 'N/A'
         WHEN 2 THEN NULL WHEN 3 THEN 'Sauna, lift'
         ELSE 'Zonnepanelen en airconditioning, , Lift' END AS facilities,
    CASE o_orderkey % 12 WHEN 0 THEN 'G' WHEN 1 THEN 'F' WHEN 2 THEN 'E' WHEN 3 THEN 'D'
         WHEN 4 THEN 'C' WHEN 5 THEN 'B' WHEN 6 THEN 'A' WHEN 7 THEN 'A+' WHEN 8 THEN 'A++'
         WHEN 9 THEN 'A+++' WHEN 10 THEN 'A++++' ELSE NULL END AS energy_label,
    CASE WHEN c_custkey % 31 = 0 THEN 'onbekend'
         ELSE concat(1000 + c_custkey % 100, ' AB Amsterdam') END AS postal_code,
    CASE o_orderkey % 6 WHEN 0 THEN 'Begane grond' WHEN 1 THEN 'N/A' WHEN 2 THEN NULL
         ELSE concat(o_orderkey % 6 - 1, 'e woonlaag') END AS located_on,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL
         ELSE CASE o_orderkey % 4 WHEN 0 THEN 'Volle eigendom'
              WHEN 1 THEN concat('Erfpacht en Gemeentelijk eigendom, einddatum erfpacht: 01-09-',
                                 2000 + o_orderkey % 100)
              WHEN 2 THEN concat('Erfpacht, einddatum erfpacht: 15-03-', 2030 + o_orderkey % 70)
              ELSE 'Eigendom onbekend' END END AS ownership,
    CASE o_orderkey % 7 WHEN 0 THEN 'Plat dak' WHEN 1 THEN 'Zadeldak bedekt met pannen'
         WHEN 2 THEN 'Samengesteld dak' WHEN 3 THEN 'Mansarde dak' WHEN 4 THEN 'Lessenaardak'
         WHEN 5 THEN 'N/A' ELSE NULL END AS roof_type,
    CASE o_orderkey % 3 WHEN 0 THEN 'Balkon aanwezig' WHEN 1 THEN 'N/A' ELSE NULL END AS balcony,
    -- outdoor map values (the whole map is NULL when k % 10 = 9)
    CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE
      CASE c_custkey % 7 WHEN 0 THEN 'In centrum' WHEN 1 THEN 'In woonwijk' WHEN 2 THEN 'Aan park'
           WHEN 3 THEN 'Met vrij uitzicht' WHEN 4 THEN 'Aan water' WHEN 5 THEN 'N/A'
           ELSE '' END END AS od_ligging,
    CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE
      CASE o_orderkey % 4 WHEN 0 THEN 'Achtertuin' WHEN 1 THEN 'Voortuin' WHEN 2 THEN 'N/A'
           ELSE NULL END END AS od_tuin,
    CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE
      CASE WHEN o_orderkey % 3 = 0 THEN concat(o_orderkey % 60, ' m²') END END AS od_achtertuin,
    CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE
      CASE WHEN o_orderkey % 2 = 0 THEN concat(' Gelegen op het ',
        CASE o_orderkey % 8 WHEN 0 THEN 'zuiden' WHEN 1 THEN 'noorden' WHEN 2 THEN 'oosten'
             WHEN 3 THEN 'westen' ELSE 'zuidwesten' END) END END AS od_ligging_tuin,
    CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n_parcels,
    CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('AMSTERDAM K ', c_custkey, ' G1')
         ELSE concat('AMSTERDAM K ', c_custkey, ' G1; AMSTERDAM K ', c_custkey, ' G2') END
      AS parcels_joined,
    CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Afkoopsom'
         ELSE concat('Canon; € ', o_orderkey % 500) END AS charges_joined,
    CASE WHEN c_custkey % 13 = 0 THEN NULL
         ELSE CAST((1 + c_custkey % 9) * 1000 + c_custkey % 1000 AS BIGINT) END AS nb_inhabitants,
    CASE WHEN c_custkey % 13 = 0 THEN NULL
         ELSE CAST(c_custkey % 60 AS DOUBLE) / 100.0 END AS nb_families,
    CASE WHEN c_custkey % 13 = 0 THEN NULL
         ELSE CAST((3 + c_custkey % 7) * 1000 + c_custkey % 1000 AS DOUBLE) END AS nb_price_m2,
    CASE WHEN c_custkey % 17 = 0 THEN NULL
         ELSE 52.3e0 + CAST(c_custkey % 997 AS DOUBLE) / 9970e0 END AS lat,
    CASE WHEN c_custkey % 17 = 0 THEN NULL
         ELSE 4.77e0 + CAST(c_custkey % 991 AS DOUBLE) / 5505e0 END AS lon
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

# Parsed listing columns (the clean stage), each an independent DuckDB spelling.
CLEAN_CTE = r"""
C AS (
  SELECT L.*,
    TRY_CAST(regexp_replace(price, '[^0-9]', '', 'g') AS BIGINT) AS price_num,
    TRY_CAST(regexp_replace(contribution_vve, '[^0-9]', '', 'g') AS BIGINT) AS contribution_vve_num,
    TRY_CAST(regexp_replace(size, '[^0-9]', '', 'g') AS BIGINT) AS size_num,
    TRY_CAST(regexp_replace(external_storage, '[^0-9]', '', 'g') AS BIGINT) AS external_storage_num,
    CASE WHEN year_of_construction LIKE 'Voor%'
           THEN TRY_CAST(split_part(year_of_construction, ' ', -1) AS BIGINT) - 1
         WHEN year_of_construction LIKE 'Na%'
           THEN TRY_CAST(split_part(year_of_construction, ' ', -1) AS BIGINT) + 1
         WHEN regexp_full_match(year_of_construction, '[0-9]+')
           THEN TRY_CAST(year_of_construction AS BIGINT) END AS year_of_construction_num,
    TRY_CAST(trim(nr_rooms) AS DOUBLE) AS nr_rooms_d,
    TRY_CAST(trim(bathrooms) AS DOUBLE) AS bathrooms_d,
    TRY_CAST(trim(toilets) AS DOUBLE) AS toilets_d,
    TRY_CAST(trim(bedrooms) AS DOUBLE) AS bedrooms_d,
    TRY_CAST(trim(year_of_construction) AS DOUBLE) AS year_of_construction_d,
    CASE WHEN facilities IS NULL OR trim(facilities) IN ('N/A', '') THEN []::VARCHAR[]
         ELSE list_filter(list_transform(string_split(replace(facilities, ' en ', ', '), ','),
                                         lambda x: lower(trim(x))), lambda x: x <> '') END
      AS facilities_list,
    CASE WHEN regexp_matches(upper(trim(postal_code)), '^[0-9]{4}\s?[A-Z]{2}')
         THEN regexp_extract(upper(trim(postal_code)), '^([0-9]{4}\s?[A-Z]{2})', 1)
         ELSE upper(trim(postal_code)) END AS postal_code_clean,
    CASE WHEN regexp_matches(upper(trim(postal_code)), '^[0-9]{4}\s?[A-Z]{2}')
         THEN nullif(regexp_extract(upper(trim(postal_code)), '^[0-9]{4}\s?[A-Z]{2}\s*(.*)$', 1), '')
         END AS city,
    trim(CASE WHEN trim(od_ligging) IN ('N/A', '') THEN NULL ELSE od_ligging END) AS location,
    trim(CASE WHEN trim(od_tuin) IN ('N/A', '') THEN NULL ELSE od_tuin END) AS garden,
    trim(CASE WHEN trim(od_achtertuin) IN ('N/A', '') THEN NULL ELSE od_achtertuin END) AS backyard,
    trim(CASE WHEN trim(od_ligging_tuin) IN ('N/A', '') THEN NULL ELSE od_ligging_tuin END)
      AS garden_location,
    coalesce(ownership, '') AS ownership_type
  FROM L
)"""


def with_listing(select_sql: str, clean: bool = False) -> str:
    """Prefix a query with the listing CTE (and the clean CTE when asked)."""
    ctes = [LISTING_CTE] + ([CLEAN_CTE] if clean else [])
    return "WITH " + ",\n".join(ctes) + "\n" + select_sql
