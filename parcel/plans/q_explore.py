"""Catalogue: descriptive analytics, correlations, histograms and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcel.functions import parse as P
from parcel.operators import explore as X
from parcel.operators.fit import quantiles
from parcel.plans.common import clean_listings, r6
from parcel.plans.oracle_base import with_listing
from parcel.sources.listings import listing_view
from parcel.sources.tables import table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rev(li: DataFrame) -> DataFrame:
    return li.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))


def describe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """AG-4 on lineitem (exact quartiles)."""
    d = X.describe(table(spark, sf, "lineitem", spread=True), NUM)
    # 8 decimals: a mean of 2-decimal values can sit exactly on a 7th-decimal tie.
    return d.select("column_name", "count", *[F.round(c, 8).alias(c) for c in
                                              ("mean", "std", "min", "p25", "p50", "p75", "max")])


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AG-5 / AG-12: category counts for energy label, bedrooms and balcony flag."""
    raw = listing_view(spark, sf).withColumn("balcony_flag", P.presence_flag("balcony"))
    return X.value_counts(raw, ["energy_label", "bedrooms", "balcony_flag"])


LISTING_SCALARS = ["price", "contribution_vve", "size", "external_storage",
                   "year_of_construction", "nr_rooms", "facilities", "energy_label",
                   "located_on", "balcony", "roof_type", "lat", "lon"]


def null_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AG-6: NULL count per raw listing column."""
    return X.null_counts(listing_view(spark, sf), LISTING_SCALARS)


def missing_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """AG-7: row counts per NULL pattern."""
    return X.missing_patterns(listing_view(spark, sf),
                              ["size", "external_storage", "nr_rooms", "lat"])


def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    """AG-14: distinct value combinations."""
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


TARGET_COLS = ["size_num", "nr_rooms", "bathrooms", "toilets", "num_facilities",
               "inhabitants_in_neighborhood", "families_with_children_pct",
               "price_per_m2_neighborhood", "year_of_construction_num"]


def corr_target(spark: SparkSession, sf: str) -> DataFrame:
    """AG-8: correlation of listing numerics with price."""
    d = X.corr_with_target(clean_listings(spark, sf), TARGET_COLS, "price_num")
    return d.select("column_name", r6("corr").alias("corr"))


CORR_COLS = NUM + ["revenue"]


def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """AG-9: full correlation matrix (long form)."""
    m = X.corr_matrix(_rev(table(spark, sf, "lineitem")), CORR_COLS)
    return m.select("col_a", "col_b", r6("corr").alias("corr"))


def high_corr_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """AG-10: upper-triangle pairs with |r| > 0.9."""
    m = X.corr_matrix(_rev(table(spark, sf, "lineitem")), CORR_COLS)
    return X.high_corr_pairs(m, CORR_COLS, 0.9).select("col_a", "col_b",
                                                      r6("corr").alias("corr"))


def histogram_equal_width(spark: SparkSession, sf: str) -> DataFrame:
    """AG-11: 20 equal-width bins of the extended price, raw and log1p."""
    li = table(spark, sf, "lineitem")
    raw = X.histogram(li, "l_extendedprice", 20).withColumn("scale", F.lit("raw"))
    log = X.histogram(li, "l_extendedprice", 20, log=True).withColumn("scale", F.lit("log"))
    return raw.unionByName(log).select("scale", "bin", r6("lo_edge").alias("lo_edge"),
                                       r6("hi_edge").alias("hi_edge"), "n")


def quantile_categories(spark: SparkSession, sf: str) -> DataFrame:
    """GE-6: Low / Medium / High from the 0/.33/.66/1 quantiles of the order price."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey",
                    X.quantile_categories(o, "o_totalprice").alias("price_category"))


def iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """OD-1: events whose value lies outside the 1.5 IQR fences."""
    ev = table(spark, sf, "events")
    lo, hi = X.iqr_fences(ev, "value")
    return (ev.where((F.col("value") < lo) | (F.col("value") > hi))
            .select("event_id", r6("value").alias("value")))


def winsorize_upper(spark: SparkSession, sf: str) -> DataFrame:
    """OD-3: cap at the p95 of the IQR inliers; count capped rows, mean after capping."""
    o = table(spark, sf, "orders")
    lo, hi = X.iqr_fences(o, "o_totalprice")
    inliers = o.where(F.col("o_totalprice").between(lo, hi))
    cap = quantiles(inliers, ["o_totalprice"], [0.95])["o_totalprice"][0]
    x = F.col("o_totalprice")
    return o.agg(r6(F.lit(cap)).alias("cap"), F.count_if(x > cap).alias("n_capped"),
                 r6(F.avg(F.least(x, F.lit(cap)))).alias("mean_capped"))


def p99_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """OD-4: p99 threshold, rows above it, and the maximum."""
    li = table(spark, sf, "lineitem", spread=True)
    t = quantiles(li, ["l_extendedprice"], [0.99])["l_extendedprice"][0]
    x = F.col("l_extendedprice")
    return li.agg(r6(F.lit(t)).alias("p99"), F.count_if(x > t).alias("n_above"),
                  r6(F.max(x)).alias("max_value"))


def binned_trend(spark: SparkSession, sf: str) -> DataFrame:
    """OD-6: decile bins of quantity -> mean x, mean y, slope of extended price on quantity."""
    t = X.binned_trend(table(spark, sf, "lineitem", spread=True), "l_quantity",
                       "l_extendedprice", 10)
    return t.select("bin", "n", r6("mean_x").alias("mean_x"), r6("mean_y").alias("mean_y"),
                    r6("slope").alias("slope"))


QUERIES = {
    "describe_numeric": describe_numeric,
    "value_counts": value_counts,
    "null_counts": null_counts,
    "missing_patterns": missing_patterns,
    "distinct_values": distinct_values,
    "corr_target": corr_target,
    "corr_matrix": corr_matrix,
    "high_corr_pairs": high_corr_pairs,
    "histogram_equal_width": histogram_equal_width,
    "quantile_categories": quantile_categories,
    "iqr_outliers": iqr_outliers,
    "winsorize_upper": winsorize_upper,
    "p99_extremes": p99_extremes,
    "binned_trend": binned_trend,
}


def _describe_oracle() -> str:
    parts = [f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 8) AS mean,
  round(stddev_samp({c}), 8) AS std, round(min({c}), 8) AS min,
  round(quantile_cont({c}, 0.25), 8) AS p25, round(quantile_cont({c}, 0.5), 8) AS p50,
  round(quantile_cont({c}, 0.75), 8) AS p75, round(max({c}), 8) AS max FROM lineitem"""
             for c in NUM]
    return "\nUNION ALL\n".join(parts)


def _corr_pairs(upper: bool) -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j, b in enumerate(CORR_COLS):
            if upper and i >= j:
                continue
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr "
                         "FROM LI")
    body = "\nUNION ALL\n".join(parts)
    sql = ("WITH LI AS (SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)\n"
           + body)
    if upper:
        sql = f"SELECT * FROM ({sql}) WHERE abs(corr) > 0.9"
    return sql


def _hist_oracle() -> str:
    def one(scale: str, x: str) -> str:
        return f"""SELECT '{scale}' AS scale, b.bin,
  round(lo + (hi - lo) / 20 * b.bin, 6) AS lo_edge, round(lo + (hi - lo) / 20 * (b.bin + 1), 6) AS hi_edge,
  CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b
CROSS JOIN (SELECT min({x}) AS lo, max({x}) AS hi FROM lineitem) m
LEFT JOIN (SELECT CAST(least(floor(({x} - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin,
           count(*) AS n
           FROM lineitem, (SELECT min({x}) AS lo, max({x}) AS hi FROM lineitem) GROUP BY 1) c
  ON c.bin = b.bin"""
    return one("raw", "l_extendedprice") + "\nUNION ALL\n" + one("log", "ln(1 + l_extendedprice)")


ORACLE = {
    "describe_numeric": _describe_oracle(),
    "value_counts": with_listing("""
, V AS (SELECT energy_label, bedrooms,
          CAST(CASE WHEN balcony IS NULL OR balcony = 'N/A' THEN 0 ELSE 1 END AS VARCHAR)
            AS balcony_flag FROM L)
SELECT column_name, value, count(*) AS n FROM (
  SELECT 'energy_label' AS column_name, energy_label AS value FROM V
  UNION ALL SELECT 'bedrooms', bedrooms FROM V
  UNION ALL SELECT 'balcony_flag', balcony_flag FROM V) WHERE value IS NOT NULL
GROUP BY column_name, value""").replace("\n)\n, V AS", "\n),\nV AS"),
    "null_counts": with_listing("\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM L"
        for c in LISTING_SCALARS)),
    "missing_patterns": with_listing("""
SELECT size IS NULL AS size_missing, external_storage IS NULL AS external_storage_missing,
  nr_rooms IS NULL AS nr_rooms_missing, lat IS NULL AS lat_missing, count(*) AS n_rows
FROM L GROUP BY ALL"""),
    "distinct_values": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "corr_target": with_listing("\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, round(corr({src}, price_num), 6) AS corr FROM C"
        for c, src in [("size_num", "size_num"), ("nr_rooms", "nr_rooms_d"),
                       ("bathrooms", "bathrooms_d"), ("toilets", "toilets_d"),
                       ("num_facilities", "len(facilities_list)"),
                       ("inhabitants_in_neighborhood", "nb_inhabitants"),
                       ("families_with_children_pct", "nb_families"),
                       ("price_per_m2_neighborhood", "nb_price_m2"),
                       ("year_of_construction_num", "year_of_construction_num")]),
        clean=True),
    "corr_matrix": _corr_pairs(False),
    "high_corr_pairs": _corr_pairs(True),
    "histogram_equal_width": _hist_oracle(),
    "quantile_categories": """
WITH Q AS (SELECT quantile_cont(o_totalprice, 0.0) AS q0, quantile_cont(o_totalprice, 0.33) AS q1,
                  quantile_cont(o_totalprice, 0.66) AS q2, quantile_cont(o_totalprice, 1.0) AS q3
           FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice >= q0 AND o_totalprice < q1 THEN 'Low'
                        WHEN o_totalprice >= q1 AND o_totalprice < q2 THEN 'Medium'
                        WHEN o_totalprice >= q2 AND o_totalprice <= q3 THEN 'High' END
  AS price_category FROM orders, Q""",
    "iqr_outliers": """
WITH Q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round(value, 6) AS value FROM events, Q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    "winsorize_upper": """
WITH Q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3
           FROM orders),
CAP AS (SELECT quantile_cont(o_totalprice, 0.95) AS cap FROM orders, Q
        WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
SELECT round(max(cap), 6) AS cap, count(CASE WHEN o_totalprice > cap THEN 1 END) AS n_capped,
  round(avg(least(o_totalprice, cap)), 6) AS mean_capped FROM orders, CAP""",
    "p99_extremes": """
WITH T AS (SELECT quantile_cont(l_extendedprice, 0.99) AS t FROM lineitem)
SELECT round(max(t), 6) AS p99, count(CASE WHEN l_extendedprice > t THEN 1 END) AS n_above,
  round(max(l_extendedprice), 6) AS max_value FROM lineitem, T""",
    "binned_trend": "WITH E AS (SELECT " + ", ".join(
        f"quantile_cont(l_quantity, {i / 10}) AS e{i}" for i in range(1, 10)) + """ FROM lineitem)
SELECT (""" + " + ".join(f"CASE WHEN l_quantity > e{i} THEN 1 ELSE 0 END" for i in range(1, 10))
    + """) AS bin, count(*) AS n, round(avg(l_quantity), 6) AS mean_x,
  round(avg(l_extendedprice), 6) AS mean_y, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope
FROM lineitem, E GROUP BY 1""",
}
