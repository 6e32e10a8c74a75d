"""Catalogue: JSON ingest, schema conformance, materialized steps, CSV / text sinks.

Round trips write into the session's shared checkpoint folder (a fresh
sub-folder per call) and read back with an explicit schema.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcel.functions import parse as P
from parcel.operators import errors as ER
from parcel.operators import pages as PG
from parcel.operators import runs as RL
from parcel.operators.preprocess import preprocess_listings
from parcel.plans.common import r2, r6
from parcel.plans.oracle_base import with_listing
from parcel.plans.q_models import _RUNS, runs_from_events
from parcel.session import ensure_checkpoint_dir
from parcel.sources import ingest as IN
from parcel.sources import store as ST
from parcel.sources.listings import geo_dimension, listing_view
from parcel.sources.tables import table


def _scratch(spark: SparkSession, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/parcel_io/{what}_{uuid.uuid4().hex}"


LISTING_KEYS = [n for n, _ in IN.LISTING_FIELDS if n not in
                ("ownership_type", "location", "backyard", "living_area", "contribution")]


def listing_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1 / SRC-3 / SRC-5: envelopes written as JSON lines, read back with the fixed
    schema, unwrapped, conformed and preprocessed."""
    raw = listing_view(spark, sf)
    env = raw.select(F.lit(True).alias("success"),
                     F.concat(F.lit("https://listing.example/"), F.col("listing_id").cast("string"))
                     .alias("url"),
                     F.struct(*[F.col(c) for c in LISTING_KEYS if c in raw.columns]).alias("data"),
                     F.lit(None).cast("string").alias("error"))
    path = _scratch(spark, "envelopes")
    env.write.mode("overwrite").json(path)
    back = IN.read_envelopes_json(spark, path)
    listings = IN.conform_listing(IN.unwrap_envelope(back).withColumn(
        "listing_id", F.regexp_extract("url", r"(\d+)$", 1).cast("bigint")))
    clean = preprocess_listings(listings)
    return clean.select("listing_id", "price_num", "size_num", "postal_code_clean", "city",
                        "num_facilities", "num_parcels", "parcels_concat", "charges_summary",
                        "inhabitants_in_neighborhood", "location", "garden")


def listings_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1 / SRC-2 / SRC-3: listings as JSON lines, read with the fixed schema, conformed and
    parsed, with the fields that could not be parsed."""
    path = _scratch(spark, "listings")
    listing_view(spark, sf).drop("lat", "lon").write.json(path)
    raw = IN.read_listings_json(spark, path, extra=[T.StructField("listing_id", T.LongType())])
    checked = ER.with_errors(IN.conform_listing(raw))
    return checked.select("listing_id", P.parse_price("price").alias("price_num"),
                          P.parse_size("size").alias("size_num"), "facilities",
                          F.array_join(F.transform("errors", lambda e: e["cause"]), ",").alias("errors"))


def ledger_appends(spark: SparkSession, sf: str) -> DataFrame:
    """RL-1 -> RL-2: runs appended in three batches, read back, ranked by name; only logged metrics."""
    runs = runs_from_events(spark, sf).withColumn("metrics", RL.logged_metrics(F.col("metrics")))
    path = _scratch(spark, "ledger")
    for part in range(3):
        RL.append_runs(runs.where(F.col("run_id") % 3 == part), path)
    best = RL.leaderboard(spark.read.parquet(path), "test_rmse")
    return best.groupBy("run_name").agg(
        F.count(F.lit(1)).alias("finished"), r6(F.min("test_rmse")).alias("best_test_rmse"),
        F.max(F.size("metrics")).alias("most_metrics"))


def conform_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-4 / NE-10 / NE-11: manual-input rows with numbers instead of text, a JSON list
    of facilities and a lone ownership string -> the full schema with defaults."""
    raw = listing_view(spark, sf)
    facil = F.to_json(F.split(F.regexp_replace(F.coalesce("facilities", F.lit("")), " en ", ","),
                              r"\s*,\s*"))
    manual = raw.select("listing_id",
                        P.parse_price("price").alias("price"),
                        facil.alias("facilities"),
                        F.get("ownership_situations", 0).alias("ownership_situations"),
                        F.col("postal_code"))
    c = IN.conform_listing(manual)
    return c.select("listing_id", "price", "facilities", "size",
                    F.size("ownership_situations").alias("n_ownership"),
                    F.size("cadastral_parcels").alias("n_parcels"),
                    F.size("outdoor_features").alias("n_outdoor"), "postal_code")


def materialize_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-12 / SRC-13: a config-keyed step output reused through the store."""
    cfg = {"step": "district_counts", "sf": sf, "version": 1}

    def build():
        clean = preprocess_listings(listing_view(spark, sf))
        return (clean.groupBy(P.prefix("postal_code_clean", 3).alias("postal_district"))
                .agg(F.count(F.lit(1)).alias("n"), r2(F.avg("price_num")).alias("avg_price")))
    root = _scratch(spark, "store")
    first = ST.cached_step(spark, "district_counts", cfg, build, root=root)
    assert ST.exists(spark, "district_counts", cfg, root=root)
    again = ST.cached_step(spark, "district_counts", cfg, build, root=root)
    return again if first is not None else first


def csv_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-6 / SRC-7: the geocode dimension written as CSV and read back with a schema,
    keeping only the recognised columns."""
    geo = geo_dimension(listing_view(spark, sf)).where(F.col("lat").isNotNull()) \
        .select("address", "lat", "lon", "price").distinct()
    path = _scratch(spark, "geo_csv")
    IN.write_dimension(geo, path, fmt="csv")
    schema = T.StructType([T.StructField("address", T.StringType()),
                           T.StructField("lat", T.DoubleType()),
                           T.StructField("lon", T.DoubleType()),
                           T.StructField("price", T.StringType())])
    back = IN.read_csv_dimension(spark, path, schema, ["address", "lat", "lon", "neighborhood"])
    return back.select("address", r6("lat").alias("lat"), r6("lon").alias("lon")).distinct()


def url_list_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-9 / SRC-11: URLs written one per line (with blank padding lines), read back
    trimmed with blank lines dropped."""
    p = table(spark, sf, "pages").select(F.concat(F.col("url"), F.lit("\n   ")).alias("url"))
    path = _scratch(spark, "urls")
    IN.write_url_list(p, path)
    return IN.read_url_list(spark, path)


def persist_pages(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-8: parsed records (JSON) and raw html (Parquet) under one load date."""
    pages = table(spark, sf, "pages", spread=True)
    ts = F.lit("2025-01-01 00:00:00").cast("timestamp")
    parsed = PG.extract_listing(pages, keep=["page_id"]).withColumn(
        "record_id", PG.page_id(F.col("url"), ts))
    raw = pages.select(PG.page_id(F.col("url"), ts).alias("record_id"), "url", "html")
    out = _scratch(spark, "pages")
    IN.persist_pages(parsed.select("record_id", "url", "price", "success"), raw, out,
                     "2025-01-01")
    pj = spark.read.json(f"{out}/parsed_json")
    rh = spark.read.parquet(f"{out}/raw_html")
    a = pj.groupBy(F.col("load_date").cast("string").alias("load_date")).agg(
        F.count(F.lit(1)).alias("n_parsed"))
    b = rh.groupBy(F.col("load_date").cast("string").alias("load_date")).agg(
        F.count(F.lit(1)).alias("n_raw"))
    return a.join(b, "load_date")


def _after_errors() -> str:
    return with_listing("""
SELECT listing_id, price_num, size_num, coalesce(facilities, '') AS facilities, concat_ws(',',
  CASE WHEN regexp_replace(price, '[^0-9]', '', 'g') = '' THEN 'price' END,
  CASE WHEN postal_code NOT SIMILAR TO '[0-9]{4}.?[A-Z]{2}.*' THEN 'postal_code' END) AS errors FROM C""", clean=True)


QUERIES = {
    "listing_from_json": listing_from_json,
    "listings_from_files": listings_from_files,
    "ledger_appends": ledger_appends,
    "conform_defaults": conform_defaults,
    "materialize_roundtrip": materialize_roundtrip,
    "csv_dimension": csv_dimension,
    "url_list_roundtrip": url_list_roundtrip,
    "persist_pages": persist_pages,
}

ORACLE = {
    "listings_from_files": _after_errors(),
    "ledger_appends": "WITH " + _RUNS + """
SELECT run_name, count(*) AS finished, round(min(test_rmse), 6) AS best_test_rmse,
  max(CASE WHEN run_name IN ('RandomForest_optuna', 'RF_Feature_Eng_log') THEN 3 ELSE 4 END) AS most_metrics
FROM R WHERE status = 'FINISHED' GROUP BY run_name""",
    "listing_from_json": with_listing("""
SELECT listing_id, price_num, size_num, postal_code_clean, city,
  CAST(len(facilities_list) AS INTEGER) AS num_facilities, CAST(n_parcels AS INTEGER) AS num_parcels,
  parcels_joined AS parcels_concat, charges_joined AS charges_summary,
  nb_inhabitants AS inhabitants_in_neighborhood, location, garden FROM C""", clean=True),
    "conform_defaults": with_listing("""
SELECT listing_id, CAST(TRY_CAST(regexp_replace(price, '[^0-9]', '', 'g') AS BIGINT) AS VARCHAR)
    AS price,
  array_to_string(string_split_regex(replace(coalesce(facilities, ''), ' en ', ','), '\\s*,\\s*'), ', ')
    AS facilities,
  CAST(NULL AS VARCHAR) AS size,
  CAST(CASE WHEN ownership IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_ownership,
  0 AS n_parcels, 0 AS n_outdoor, postal_code FROM L"""),
    "materialize_roundtrip": with_listing("""
SELECT substr(postal_code_clean, 1, 3) AS postal_district, count(*) AS n,
  round(avg(price_num), 2) AS avg_price FROM C GROUP BY 1""", clean=True),
    "csv_dimension": with_listing("""
SELECT DISTINCT address, round(lat + (k % 3) * 0.001e0, 6) AS lat, round(lon + (k % 2) * 0.002e0, 6) AS lon
FROM L WHERE lat IS NOT NULL AND cu % 100 NOT IN (7, 57) AND neighborhood <> 'NATION_7' AND k % 5 <> 0"""),
    "url_list_roundtrip": "SELECT url FROM pages",
    "persist_pages": """
SELECT '2025-01-01' AS load_date, count(*) AS n_parsed, count(*) AS n_raw FROM pages""",
}
