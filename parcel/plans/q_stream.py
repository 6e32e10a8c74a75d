"""Catalogue: stream scoring, isolation forest, user extension points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcel.functions import parse as P
from parcel.operators import models as ML
from parcel.operators import outliers as OD
from parcel.operators.preprocess import apply_parsers, preprocess_listings
from parcel.plans.common import r6
from parcel.plans.oracle_base import with_listing
from parcel.plans.q_ml import build_features
from parcel.sources.listings import listing_view
from parcel.sources.store import scratch_path
from parcel.sources.tables import table
from parcel.streaming import scoring as SS


def fit_scoring_state(spark: SparkSession, sf: str) -> SS.ScoringState:
    """Batch fit of everything the scoring path needs."""
    X, meta, values = build_features(spark, sf)
    model = ML.fit(ML.materialize(X).where(F.col("split") == "train"), meta.feature_columns,
                   "price_num", "linear", {"fit_intercept": True}, log_target=True)
    return SS.ScoringState(values, meta, model)


STREAM_KEEP = ["dist_to_center_bin_encoded", "lat_lon_missing"]


def _streamed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listings land as JSON files, a stream scores them (availableNow): scored, dead letters, counts."""
    base = scratch_path(spark, "parcel_stream")
    state = fit_scoring_state(spark, sf)
    raw = listing_view(spark, sf)
    raw.drop("lat", "lon").write.mode("overwrite").json(f"{base}/incoming")
    stream = SS.listing_stream(spark, f"{base}/incoming", extra=[T.StructField("listing_id", T.LongType())])
    q = SS.start(stream, state, f"{base}/scored", f"{base}/dead_letter", f"{base}/counts",
                 f"{base}/_checkpoint", keep=["listing_id", *STREAM_KEEP, *state.meta.count_columns])
    q.awaitTermination()
    return tuple(spark.read.parquet(f"{base}/{t}") for t in ("scored", "dead_letter", "counts"))


def score_stream(spark: SparkSession, sf: str) -> DataFrame:
    """SM-1..SM-3: a stream scores every listing, with the coordinates, centroids and amenity counts
    of the fitted state joined per micro-batch."""
    scored, _, _ = _streamed(spark, sf)
    return scored.select("listing_id", F.round("prediction", 2).alias("prediction"), *STREAM_KEEP,
                         F.array_join(F.transform("errors", lambda e: e["cause"]), ",").alias("errors"))


def stream_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """SM-1..SM-3 checked: every listing comes out once, scored, with its distance bin, its amenity
    counts and the fields that could not be parsed."""
    scored, _, _ = _streamed(spark, sf)
    counts = [c for c in scored.columns if c.startswith("count_")]
    return scored.select("listing_id", F.col("dist_to_center_bin_encoded").cast("int").alias("dist_bin"),
                         F.col("lat_lon_missing").cast("int").alias("lat_lon_missing"), *counts,
                         F.col("prediction").isNotNull().alias("scored"),
                         F.array_join(F.transform("errors", lambda e: e["cause"]), ",").alias("errors"))


def stream_error_counts(spark: SparkSession, sf: str) -> DataFrame:
    """SM-3: records per cause from the micro-batches' counts, next to the dead letters per cause."""
    _, dead, counts = _streamed(spark, sf)
    letters = dead.groupBy("cause").agg(F.count(F.lit(1)).alias("letters"))
    return counts.groupBy("cause").agg(F.sum("n").alias("records")).join(letters, "cause", "left").select(
        "cause", "records", F.coalesce("letters", F.lit(0)).cast("long").alias("letters"))


def isolation_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """OD-2: isolation forest on line items, top 2 % flagged (rows = flagged items)."""
    li = table(spark, sf, "lineitem", spread=True).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    li = li.withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    flagged, _ = OD.flag_outliers(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                                  "key", contamination=0.02)
    _, removed = OD.split_outliers(flagged)
    return removed.select("l_orderkey", "l_linenumber", F.round("anomaly_score", 6).alias("score"))


def _py_digits(text: str | None) -> int | None:
    """A plain Python parser (UD-1 example): digits of a text, else None."""
    if text is None:
        return None
    d = "".join(ch for ch in text if "0" <= ch <= "9")
    return int(d) if d else None


def python_parser(fn, return_type: str):
    """UD-1: wrap a per-value Python function as a vectorized (Arrow) parser column."""

    @F.pandas_udf(return_type)
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn).astype("Int64" if return_type == "bigint" else object)

    return lambda c: run(c)


def user_parsers(spark: SparkSession, sf: str) -> DataFrame:
    """UD-1: a user registry {column: Column -> Column}, built-in and Python-backed."""
    raw = listing_view(spark, sf)
    parsers = {"address": lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("bigint"),
               "price": python_parser(_py_digits, "bigint"),
               "size": P.parse_size}
    out = apply_parsers(raw, parsers, suffix="_parsed")
    return out.select("listing_id", "address_parsed", "price_parsed", "size_parsed")


def _price_per_m2(df: DataFrame) -> DataFrame:
    return df.withColumn("price_per_m2", r6(P.safe_ratio("price_num", "size_num")))


def _is_central(df: DataFrame) -> DataFrame:
    return df.withColumn("is_central", F.col("location").contains("centrum"))


def pipeline_steps(spark: SparkSession, sf: str) -> DataFrame:
    """UD-3: user DataFrame -> DataFrame steps appended to the preprocessing stage."""
    clean = preprocess_listings(listing_view(spark, sf), extra_steps=[_price_per_m2, _is_central])
    return clean.select("listing_id", "price_per_m2", "is_central")


QUERIES = {
    "score_stream": score_stream,
    "stream_coverage": stream_coverage,
    "stream_error_counts": stream_error_counts,
    "isolation_outliers": isolation_outliers,
    "user_parsers": user_parsers,
    "pipeline_steps": pipeline_steps,
}

_ERRORS = """
ER AS (SELECT L.listing_id, concat_ws(',',
         CASE WHEN regexp_replace(price, '[^0-9]', '', 'g') = '' THEN 'price' END,
         CASE WHEN postal_code NOT SIMILAR TO '[0-9]{4}.?[A-Z]{2}.*' THEN 'postal_code' END) AS errors FROM L)"""


def _stream_oracle() -> str:
    from parcel.operators.geo_join import AMENITY_RADIUS_KM, count_column
    from parcel.plans.oracle_features import geo_ctes
    from parcel.plans.q_geo import _AMEN, HAV_CENTER, _fix, dist_bin
    cols = ", ".join(count_column(t, r) for t, rs in AMENITY_RADIUS_KM.items() for r in rs)
    return _fix(with_listing(f"""
, {_AMEN},
{geo_ctes("C", "price_num IS NOT NULL")},
{_ERRORS}
SELECT FL.listing_id, {dist_bin(HAV_CENTER)} AS dist_bin, lat_lon_missing, {cols}, TRUE AS scored, errors
FROM FL JOIN CNT USING (listing_id) JOIN ER USING (listing_id)""", clean=True))


ORACLE = {
    "stream_coverage": _stream_oracle(),
    "stream_error_counts": with_listing(f""",
{_ERRORS},
EC AS (SELECT unnest(CASE WHEN errors = '' THEN ['none'] ELSE string_split(errors, ',') END) AS cause FROM ER)
SELECT cause, count(*) AS records, CASE WHEN cause = 'none' THEN 0 ELSE count(*) END AS letters
FROM EC GROUP BY cause""").replace("\n),\n", "\n),\n"),
    "user_parsers": with_listing("""
SELECT listing_id, TRY_CAST(nullif(regexp_extract(address, '(\\d+)$', 1), '') AS BIGINT) AS address_parsed,
  TRY_CAST(nullif(regexp_replace(price, '[^0-9]', '', 'g'), '') AS BIGINT) AS price_parsed,
  TRY_CAST(regexp_replace(size, '[^0-9]', '', 'g') AS BIGINT) AS size_parsed FROM L"""),
    "pipeline_steps": with_listing("""
SELECT listing_id, round(CAST(price_num AS DOUBLE) / nullif(CAST(size_num AS DOUBLE), 0), 6)
  AS price_per_m2, contains(location, 'centrum') AS is_central FROM C""", clean=True),
}
