"""Catalogue: fitted statistics, encoders, engineered features, splits, schema ops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcel.functions import parse as P
from parcel.operators import features as FE
from parcel.operators import fit as FIT
from parcel.operators import levels as LV
from parcel.operators import schema_ops as S
from parcel.operators import split as SP
from parcel.operators.folds import fold_profile
from parcel.operators.preprocess import facility_flags
from parcel.plans.common import clean_listings, r6
from parcel.plans.oracle_base import with_listing
from parcel.sources.listings import listing_view
from parcel.sources.store import scratch_table
from parcel.sources.tables import table

LUX = list(FE.LUXURY_WEIGHTS)
HASH_U = ("(CAST(('0x' || substr(md5(CAST({k} AS VARCHAR) || ':42'), 1, 8)) AS BIGINT)"
          " / 4294967296.0)")


def _r4(c):
    return F.round(c, 4)


def impute_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """IM-1 with all three strategy kinds."""
    clean = clean_listings(spark, sf)
    strategies = {"size_num": "median", "nr_rooms": "mean",
                  "external_storage_num": "constant:0", "year_of_construction": "median"}
    filled = FIT.apply_impute(clean, FIT.fit_impute(clean, strategies))
    return filled.select("listing_id", *[r6(c).alias(c) for c in strategies])


def impute_train_only(spark: SparkSession, sf: str) -> DataFrame:
    """IM-2 + SP-1: medians fitted on the train split, applied to every split."""
    clean = SP.with_split(clean_listings(spark, sf), "listing_id", test_size=0.2)
    med = FIT.medians(clean.where(F.col("split") == "train"), ["size_num", "nr_rooms"])
    filled = FIT.apply_impute(clean, med)
    return filled.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("size_num")).alias("avg_size"),
        r6(F.avg("nr_rooms")).alias("avg_rooms"),
        r6(F.lit(med["size_num"])).alias("median_size"),
        r6(F.lit(med["nr_rooms"])).alias("median_rooms"))


LOG_CANDIDATES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def auto_log_columns(spark: SparkSession, sf: str) -> DataFrame:
    """IM-3 selection + IM-4 application on lineitem."""
    li = table(spark, sf, "lineitem").select(*LOG_CANDIDATES)
    chosen = FIT.fit_log_columns(li, LOG_CANDIDATES, 0.5)
    logged = FIT.apply_log(li, chosen)
    n = F.count(F.lit(1)).cast("double")
    rows = []
    for c in LOG_CANDIDATES:
        lc = f"log_{c}"
        rows.append(F.struct(
            F.lit(c).alias("column_name"),
            r6(FIT.skew_g1(F.col(c), n)).alias("g1"),
            F.lit(lc in chosen).alias("selected"),
            (r6(F.avg(lc)) if lc in chosen else F.lit(None).cast("double")).alias("avg_log")))
    return logged.agg(F.array(*rows).alias("r")).select(F.inline("r"))


CATS = list(FE.CATEGORICALS)


def one_hot_fixed_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """FE-3 (levels fitted on train, first dropped) + IM-5 low-variance flag: one row per
    indicator, from the table of levels; no list of levels and no column per level."""
    base = SP.with_split(FE.categorical_columns(clean_listings(spark, sf)), "listing_id")
    counts = scratch_table(LV.count_levels(base, CATS, by="split"))
    rows = scratch_table(base.groupBy("split").agg(F.count(F.lit(1)).alias("n")))
    n_train = F.broadcast(rows.where(F.col("split") == "train").select(F.col("n").alias("n_train")))  # one row
    train = F.sum(F.when(F.col("split") == "train", F.col("n")))
    levels = counts.groupBy("name", "level").agg(F.sum("n").alias("n_ones"), train.alias("n_in_train")).where(
        F.col("n_in_train").isNotNull())
    first = levels.groupBy("name").agg(F.min("level").alias("first"))     # one row per column
    share = F.col("n_in_train") / F.col("n_train")
    return (levels.join(F.broadcast(first), "name").where(F.col("level") != F.col("first")).join(n_train)
            .select(F.concat_ws("_", "name", "level").alias("dummy"), "n_ones", r6(share).alias("train_share"),
                    (F.greatest(share, 1 - share) >= 0.95).alias("dropped")))


CODED = ["address", "roof_cat", "garden_cat"]


def level_codes(spark: SparkSession, sf: str) -> DataFrame:
    """FE-3 / NE-2 without a ceiling: dense codes of every address, roof and garden level by falling
    frequency, joined to every listing."""
    base = FE.categorical_columns(clean_listings(spark, sf)).select("listing_id", *CODED)
    levels = scratch_table(LV.dictionary(LV.count_levels(base, CODED)))
    return LV.encode(base, ["listing_id"], levels, CODED).select("listing_id", *[f"{c}_code" for c in CODED])


SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _scale(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        li = table(spark, sf, "lineitem", spread=kind == "robust").select(
            "l_orderkey", "l_linenumber", *SCALE_COLS)
        state = FIT.fit_scaler(li, SCALE_COLS, kind)
        out = FIT.apply_scaler(li, state)
        return out.select("l_orderkey", "l_linenumber", *[_r4(F.col(c)).alias(c)
                                                         for c in SCALE_COLS])
    run.__doc__ = f"IM-6 {kind} scaler fitted and applied on lineitem."
    return run


def energy_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """FE-1 / FE-2."""
    return listing_view(spark, sf).select(
        "listing_id", FE.energy_ordinal("energy_label").alias("energy_label_encoded"))


def _flagged(spark, sf):
    clean = clean_listings(spark, sf)
    return FE.binary_flags(facility_flags(clean, LUX), LUX)


LUX_OUT = ["luxury_score", "num_luxury_facilities", "has_high_end_facilities", "luxury_density",
           "size_per_luxury", "luxury_x_price_m2", "luxury_x_size", "luxury_x_inhabitants"]


def luxury_features(spark: SparkSession, sf: str) -> DataFrame:
    """FE-6 + FE-7."""
    df = FE.luxury_interactions(FE.luxury_features(_flagged(spark, sf)))
    return df.select("listing_id", *[r6(F.col(c).cast("double")).alias(c) for c in LUX_OUT])


def luxury_contribution(spark: SparkSession, sf: str) -> DataFrame:
    """FE-16: average weighted contribution per luxury feature (long form)."""
    df = _flagged(spark, sf)
    rows = [F.struct(F.lit(f).alias("feature"), r6(F.avg(F.col(f) * F.lit(w))).alias("avg_weighted"))
            for f, w in FE.LUXURY_WEIGHTS.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


EXP_OUT = FE.EXPANSION_FEATURES


def expansion_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """FE-11..15 with the final NULL/NaN/inf -> 0 cleanup (SC-19)."""
    df = FE.expansion_features(FE.extra_numeric(clean_listings(spark, sf)))
    return df.select("listing_id", *[r6(F.col(c)).alias(c) for c in EXP_OUT])


def split_hash(spark: SparkSession, sf: str) -> DataFrame:
    """SP-1 / SP-2 / SP-3 on orders: split label and fold per key."""
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.select("o_orderkey",
                    SP.split_column("o_orderkey", 0.2, 0.1, 42).alias("split"),
                    SP.fold_column("o_orderkey", 5, 42).alias("fold"))


FOLD_STATS = ("cv_fold int, column_name string, n long, mean double, std double, min double, max double, "
              "median double")


def fold_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """FE-10: statistics of every numeric feature over the training rows of every fold; the
    folds' own summaries are added up, no row is copied."""
    clean = SP.with_folds(clean_listings(spark, sf), "listing_id", 5)
    parsed = scratch_table(clean.select("fold", *[P.to_float(F.col(c), numeric=FE._is_numeric(clean, c)).alias(c)
                                                  for c in FE.DEFAULT_NUMERIC]))
    rows = list(fold_profile(parsed, FE.DEFAULT_NUMERIC, "fold", 5))     # folds x columns
    return spark.createDataFrame(rows, FOLD_STATS).select("cv_fold", "column_name", "n", *[
        r6(c).alias(c) for c in ("mean", "std", "min", "max", "median")])


FOLD_META = ("cv_fold int, n_levels long, levels string, log_columns string, size_median double, "
             "price_m2_median double")


def fold_feature_state(spark: SparkSession, sf: str) -> DataFrame:
    """FE-10 / ML-9: what every fold's feature fit keeps: one-hot levels, log columns, medians."""
    metas = FE.fit_fold_features(SP.with_folds(clean_listings(spark, sf), "listing_id", 5), "fold", 5)
    return spark.createDataFrame(
        [(f, len(m.ohe_columns), ",".join(sorted(m.ohe_columns)), ",".join(sorted(m.log_cols)),
          m.train_medians["size_num"], m.train_medians["price_per_m2_neighborhood"])
         for f, m in enumerate(metas)], FOLD_META)


def schema_align(spark: SparkSession, sf: str) -> DataFrame:
    """PR-4 / PR-5 / PR-8: conform to an expected list (missing, extra, order, log rebuild)."""
    clean = clean_listings(spark, sf)
    flagged = facility_flags(clean, ["has_lift", "has_schuifpui"])
    expected = ["listing_id", "size_num", "has_lift", "has_zwembad", "log_size_num",
                "missing_feature"]
    out = S.conform(flagged, expected, log_base={"log_size_num": "size_num"},
                    types={"size_num": "double", "has_lift": "int", "has_zwembad": "int"})
    return out.withColumn("log_size_num", r6("log_size_num"))


def model_vector(spark: SparkSession, sf: str) -> DataFrame:
    """PR-7: keep numeric / boolean columns only."""
    clean = clean_listings(spark, sf)
    mixed = clean.select("listing_id", "price", "size_num", "city",
                         F.array_contains("facilities_list", "lift").alias("has_lift"),
                         r6("families_with_children_pct").alias("families_with_children_pct"))
    return S.numeric_only(mixed)


def schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    """PR-9: missing / extra features of per-row feature maps, counted."""
    clean = clean_listings(spark, sf)
    fmap = F.map_filter(F.create_map(
        F.lit("size_num"), F.col("size_num").cast("double"),
        F.lit("price_num"), F.col("price_num").cast("double"),
        F.lit("nr_rooms"), F.col("nr_rooms")), lambda k, v: v.isNotNull())
    feats = clean.select("listing_id", fmap.alias("features"))
    return S.schema_diff_report(feats, ["size_num", "nr_rooms", "energy_label_encoded"])


def price_per_m2(spark: SparkSession, sf: str) -> DataFrame:
    """PR-12."""
    clean = clean_listings(spark, sf)
    return clean.select("listing_id",
                        r6(P.safe_ratio("price_num", "size_num")).alias("price_per_m2"))


def mask_filters(spark: SparkSession, sf: str) -> DataFrame:
    """PR-10: isin + timestamp threshold + numeric mask, pushed to the scan."""
    o = table(spark, sf, "orders")
    return (o.where(F.col("o_orderstatus").isin("F", "O")
                    & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"))
                    & (F.col("o_totalprice") > 100000))
            .select("o_orderkey", "o_orderstatus", "o_totalprice"))


NESTED = ["outdoor_features", "cadastral_parcels", "ownership_situations", "charges",
          "neighborhood_details"]


def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    """PR-11: drop listed columns if present (absent names ignored)."""
    return S.drop_if_present(listing_view(spark, sf), NESTED + ["not_a_column", "lat", "lon"])


QUERIES = {
    "impute_strategies": impute_strategies,
    "impute_train_only": impute_train_only,
    "auto_log_columns": auto_log_columns,
    "one_hot_fixed_vocab": one_hot_fixed_vocab,
    "scale_standard": _scale("standard"),
    "scale_minmax": _scale("minmax"),
    "scale_robust": _scale("robust"),
    "energy_ordinal": energy_ordinal,
    "luxury_features": luxury_features,
    "luxury_contribution": luxury_contribution,
    "expansion_ratios": expansion_ratios,
    "split_hash": split_hash,
    "fold_statistics": fold_statistics,
    "fold_feature_state": fold_feature_state,
    "level_codes": level_codes,
    "schema_align": schema_align,
    "model_vector": model_vector,
    "schema_diff": schema_diff,
    "price_per_m2": price_per_m2,
    "mask_filters": mask_filters,
    "drop_columns": drop_columns,
}

_SPLIT = f"""CASE WHEN {HASH_U.format(k='listing_id')} < 0.2 THEN 'test' ELSE 'train' END"""

_LUX_CTE = """
X AS (
  SELECT listing_id, size_num, nr_rooms_d, nb_inhabitants, nb_price_m2,
    CAST(list_contains(facilities_list, 'lift') AS INTEGER) AS f_lift,
    CAST(list_contains(facilities_list, 'sauna') AS INTEGER) AS f_sauna,
    CAST(list_contains(facilities_list, 'airconditioning') AS INTEGER) AS f_air
  FROM C),
Y AS (
  SELECT *, f_lift * 1.0 + f_sauna * 2.0 + f_air * 1.0 AS score,
    CAST(f_lift + f_sauna + f_air AS DOUBLE) AS cnt FROM X)
"""

_scale_sql = {
    "standard": ("avg({c})", "CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END"),
    "minmax": ("min({c})", "CASE WHEN max({c}) - min({c}) = 0 THEN 1 ELSE max({c}) - min({c}) END"),
    "robust": ("quantile_cont({c}, 0.5)",
               "CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1 "
               "ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END"),
}


def _scale_oracle(kind: str) -> str:
    center, scale = _scale_sql[kind]
    stats = ", ".join(f"{center.format(c=c)} AS a_{c}, {scale.format(c=c)} AS s_{c}"
                      for c in SCALE_COLS)
    cols = ", ".join(f"round((CAST({c} AS DOUBLE) - a_{c}) / s_{c}, 4) AS {c}" for c in SCALE_COLS)
    return (f"WITH S AS (SELECT {stats} FROM lineitem) "
            f"SELECT l_orderkey, l_linenumber, {cols} FROM lineitem, S")


def _log_oracle() -> str:
    parts = []
    for c in LOG_CANDIDATES:
        parts.append(f"""SELECT '{c}' AS column_name, round(skewness({c}), 6) AS g1,
  (min({c}) > 0 AND abs(skewness({c})) > 0.5) AS selected,
  CASE WHEN min({c}) > 0 AND abs(skewness({c})) > 0.5 THEN round(avg(ln(1 + {c})), 6) END
    AS avg_log FROM lineitem""")
    return "\nUNION ALL\n".join(parts)


_ONEHOT_ORACLE = with_listing(f"""
, B AS (
  SELECT listing_id, {_SPLIT} AS split,
    substr(postal_code_clean, 1, 3) AS postal_district,
    coalesce(status, 'N/A') AS status_cat,
    CASE WHEN roof_type IS NULL OR roof_type = 'N/A' THEN 'Unknown'
       WHEN roof_type LIKE '%Plat dak%' THEN 'Flat' WHEN roof_type LIKE '%Zadeldak%' THEN 'Saddle'
       WHEN roof_type LIKE '%Samengesteld dak%' THEN 'Composite'
       WHEN roof_type LIKE '%Mansarde%' THEN 'Mansard' ELSE 'Other' END AS roof_cat,
    CASE WHEN trim(ownership_type) = '' THEN 'Unknown'
       WHEN ownership_type LIKE '%Volle eigendom%' THEN 'Full'
       WHEN ownership_type LIKE '%Erfpacht%' AND ownership_type LIKE '%Gemeentelijk%' THEN 'Municipal'
       WHEN ownership_type LIKE '%Erfpacht%' THEN 'Leasehold' ELSE 'Other' END AS ownership_cat,
    CASE WHEN location IS NULL THEN 'Unknown' WHEN location LIKE '%centrum%' THEN 'Central'
       WHEN location LIKE '%woonwijk%' THEN 'Residential'
       WHEN location LIKE '%vrij uitzicht%' THEN 'OpenView'
       WHEN location LIKE '%park%' THEN 'Park' ELSE 'Other' END AS location_cat,
    coalesce(garden, 'None') AS garden_cat
  FROM C),
U AS (UNPIVOT B ON postal_district, status_cat, roof_cat, ownership_cat, location_cat, garden_cat
      INTO NAME name VALUE level),
LV AS (
  SELECT name, level, row_number() OVER (PARTITION BY name ORDER BY level) AS rn
  FROM (SELECT DISTINCT name, level FROM U WHERE split = 'train')),
NTRAIN AS (SELECT count(*) AS nt FROM B WHERE split = 'train'),
AGG AS (
  SELECT LV.name, LV.level, count(U.listing_id) AS n_ones,
    CAST(count(CASE WHEN U.split = 'train' THEN 1 END) AS DOUBLE) / max(nt) AS share
  FROM LV CROSS JOIN NTRAIN LEFT JOIN U ON U.name = LV.name AND U.level = LV.level
  WHERE LV.rn > 1 GROUP BY LV.name, LV.level)
SELECT name || '_' || level AS dummy, CAST(n_ones AS BIGINT) AS n_ones,
  round(share, 6) AS train_share, greatest(share, 1 - share) >= 0.95 AS dropped FROM AGG""",
    clean=True).replace("\n)\n, B AS", "\n),\nB AS")


def _numeric_long() -> str:
    """(listing_id, fold, column_name, v): the numeric features as parsed, in long form."""
    from parcel.plans.oracle_features import NUMERIC
    raw = {"size_i": "CAST(size_num AS DOUBLE)", "contrib_i": "CAST(contribution_vve_num AS DOUBLE)",
           "storage_i": "CAST(external_storage_num AS DOUBLE)"}
    fold = f"CAST(floor({HASH_U.format(k='listing_id')} * 5) AS INTEGER)"
    return "\nUNION ALL\n".join(
        f"SELECT listing_id, {fold} AS fold, '{n}' AS column_name, {raw.get(e, e)} AS v FROM C"
        for n, e in NUMERIC.items())


def _after(sql: str) -> str:
    return with_listing(sql, clean=True).replace("\n)\n, ", "\n),\n", 1)


def _fold_oracle() -> str:
    return _after(f"""
, NL AS ({_numeric_long()})
SELECT CAST(f AS INTEGER) AS cv_fold, column_name, count(v) AS n, round(avg(v), 6) AS mean,
  round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(median(v), 6) AS median
FROM NL, range(5) t(f) WHERE fold <> f GROUP BY f, column_name""")


def _fold_state_oracle() -> str:
    from parcel.plans.oracle_features import CATS
    cats = "\nUNION ALL\n".join(
        f"SELECT listing_id, '{n}' AS name, CAST({e} AS VARCHAR) AS level FROM C" for n, e in CATS.items())
    return _after(f"""
, NL AS ({_numeric_long()}),
FD AS (SELECT listing_id, CAST(floor({HASH_U.format(k='listing_id')} * 5) AS INTEGER) AS fold FROM C),
TR AS (SELECT FD.listing_id, f FROM FD, range(5) t(f) WHERE fold <> f),
N AS (SELECT f, count(*) AS n FROM TR GROUP BY f),
M AS (SELECT f, column_name, median(v) AS m FROM NL JOIN TR USING (listing_id) GROUP BY f, column_name),
LG AS (SELECT f, string_agg('log_' || column_name, ',' ORDER BY 'log_' || column_name) AS cols FROM (
       SELECT f, column_name, min(coalesce(v, m)) AS lo, skewness(coalesce(v, m)) AS s
       FROM NL JOIN TR USING (listing_id) JOIN M USING (f, column_name) GROUP BY f, column_name)
       WHERE lo > 0 AND abs(s) > 0.5 GROUP BY f),
CT AS ({cats}),
LV AS (SELECT f, name, level, count(*) AS n_ones, row_number() OVER (PARTITION BY f, name ORDER BY level) AS rn
       FROM CT JOIN TR USING (listing_id) WHERE level IS NOT NULL GROUP BY f, name, level),
KP AS (SELECT f, count(*) AS n_levels, string_agg(name || '_' || level, ',' ORDER BY name || '_' || level) AS levels
       FROM LV JOIN N USING (f) WHERE rn > 1 AND greatest(n_ones / n, 1 - n_ones / n) < 0.95 GROUP BY f)
SELECT CAST(N.f AS INTEGER) AS cv_fold, coalesce(n_levels, 0) AS n_levels, coalesce(levels, '') AS levels,
  coalesce(LG.cols, '') AS log_columns,
  (SELECT m FROM M WHERE M.f = N.f AND column_name = 'size_num') AS size_median,
  (SELECT m FROM M WHERE M.f = N.f AND column_name = 'price_per_m2_neighborhood') AS price_m2_median
FROM N LEFT JOIN KP USING (f) LEFT JOIN LG USING (f)""")


def _codes_oracle() -> str:
    from parcel.plans.oracle_features import CATS
    own = {"address": "address", **{c: CATS[c] for c in ("roof_cat", "garden_cat")}}
    parts = ", ".join(f"""{n}_d AS (SELECT {e} AS level, row_number() OVER (ORDER BY count(*) DESC, {e}) - 1 AS code
      FROM C WHERE {e} IS NOT NULL GROUP BY 1)""" for n, e in own.items())
    return _after(f"""
, {parts}
SELECT listing_id, {", ".join(f"{n}_d.code AS {n}_code" for n in own)} FROM C
{" ".join(f"LEFT JOIN {n}_d ON {n}_d.level = ({e})" for n, e in own.items())}""")


ORACLE = {
    "impute_strategies": with_listing("""
SELECT listing_id,
  round(coalesce(CAST(size_num AS DOUBLE), (SELECT median(CAST(size_num AS DOUBLE)) FROM C)), 6)
    AS size_num,
  round(coalesce(nr_rooms_d, (SELECT avg(nr_rooms_d) FROM C)), 6) AS nr_rooms,
  round(coalesce(CAST(external_storage_num AS DOUBLE), 0.0), 6) AS external_storage_num,
  round(coalesce(year_of_construction_d, (SELECT median(year_of_construction_d) FROM C)), 6)
    AS year_of_construction
FROM C""", clean=True),
    "impute_train_only": with_listing(f"""
, S AS (SELECT *, {_SPLIT} AS split FROM C),
M AS (SELECT median(CAST(size_num AS DOUBLE)) AS ms, median(nr_rooms_d) AS mr FROM S
      WHERE split = 'train')
SELECT split, count(*) AS n, round(avg(coalesce(CAST(size_num AS DOUBLE), ms)), 6) AS avg_size,
  round(avg(coalesce(nr_rooms_d, mr)), 6) AS avg_rooms, round(max(ms), 6) AS median_size,
  round(max(mr), 6) AS median_rooms
FROM S, M GROUP BY split""", clean=True).replace("\n)\n, S AS", "\n),\nS AS"),
    "auto_log_columns": _log_oracle(),
    "one_hot_fixed_vocab": _ONEHOT_ORACLE,
    "scale_standard": _scale_oracle("standard"),
    "scale_minmax": _scale_oracle("minmax"),
    "scale_robust": _scale_oracle("robust"),
    "energy_ordinal": with_listing("""
SELECT listing_id, CAST(CASE coalesce(energy_label, 'G') WHEN 'G' THEN 0 WHEN 'F' THEN 1
  WHEN 'E' THEN 2 WHEN 'D' THEN 3 WHEN 'C' THEN 4 WHEN 'B' THEN 5 WHEN 'A' THEN 6 WHEN 'A+' THEN 7
  WHEN 'A++' THEN 8 WHEN 'A+++' THEN 9 WHEN 'A++++' THEN 10 END AS DOUBLE) AS energy_label_encoded
FROM L"""),
    "luxury_features": with_listing(f""", {_LUX_CTE}
SELECT listing_id, round(score, 6) AS luxury_score, round(cnt, 6) AS num_luxury_facilities,
  CAST(CAST(cnt >= 3 AS INTEGER) AS DOUBLE) AS has_high_end_facilities,
  round(score / CASE WHEN nr_rooms_d = 0 THEN 1.0 ELSE nr_rooms_d END, 6) AS luxury_density,
  round(size_num / (score + 1), 6) AS size_per_luxury,
  round(score * nb_price_m2, 6) AS luxury_x_price_m2,
  round(score * size_num, 6) AS luxury_x_size,
  round(score * nb_inhabitants, 6) AS luxury_x_inhabitants
FROM Y""", clean=True).replace("\n)\n, \nX AS", "\n),\nX AS"),
    "luxury_contribution": with_listing(f""", {_LUX_CTE}
SELECT 'has_lift' AS feature, round(avg(f_lift * 1.0), 6) AS avg_weighted FROM Y
UNION ALL SELECT 'has_sauna', round(avg(f_sauna * 2.0), 6) FROM Y
UNION ALL SELECT 'has_domotica', round(avg(0 * 1.5), 6) FROM Y
UNION ALL SELECT 'has_airconditioning', round(avg(f_air * 1.0), 6) FROM Y
UNION ALL SELECT 'has_zwembad', round(avg(0 * 3.0), 6) FROM Y""",
        clean=True).replace("\n)\n, \nX AS", "\n),\nX AS"),
    "expansion_ratios": with_listing("""
, E AS (
  SELECT listing_id,
    CAST(size_num AS DOUBLE) AS size, nr_rooms_d AS rooms, CAST(nb_inhabitants AS DOUBLE) AS inh,
    CASE WHEN located_on IS NULL OR located_on IN ('N/A', 'Begane grond') THEN 0
         ELSE coalesce(TRY_CAST(nullif(regexp_extract(located_on, '([0-9]+)', 1), '') AS INTEGER), 0)
         END AS floor_level,
    coalesce(CASE WHEN trim(ownership_type) = '' OR ownership_type LIKE '%Volle eigendom%' THEN NULL
         ELSE greatest(TRY_CAST(nullif(regexp_extract(ownership_type,
              'einddatum erfpacht: ([0-9]{2})-([0-9]{2})-([0-9]{4})', 3), '') AS INTEGER) - 2025, 0)
         END, 0) AS lease,
    coalesce(TRY_CAST(regexp_replace(backyard, '[^0-9.]', '', 'g') AS DOUBLE), 0.0) AS backyard_num,
    CASE WHEN balcony IS NULL OR balcony = 'N/A' THEN 0 ELSE 1 END AS balcony_flag,
    CAST(external_storage_num AS DOUBLE) AS storage, bathrooms_d, toilets_d,
    CAST(len(facilities_list) AS DOUBLE) AS nfac,
    2025.0 - year_of_construction_d AS age
  FROM C),
R AS (
  SELECT listing_id,
    (size + bathrooms_d + toilets_d) / nullif(rooms, 0) AS room_utilization_ratio,
    floor_level / nullif(size, 0) AS floor_to_size,
    storage / nullif(size, 0) AS external_storage_ratio,
    inh / nullif(rooms, 0) AS inhabitants_per_room,
    nfac / nullif(inh, 0) AS neighborhood_facility_density,
    age AS building_age, CAST(age > 100 AS INTEGER) AS old_house_flag,
    lease / nullif(age, 0) AS lease_ratio,
    CAST(balcony_flag > 0 OR backyard_num > 0 AS INTEGER) AS has_outdoor_space,
    (balcony_flag + backyard_num) / nullif(size, 0) AS outdoor_area_ratio
  FROM E)
SELECT listing_id,
  round(coalesce(room_utilization_ratio, 0), 6) AS room_utilization_ratio,
  round(coalesce(floor_to_size, 0), 6) AS floor_to_size,
  round(coalesce(external_storage_ratio, 0), 6) AS external_storage_ratio,
  round(coalesce(inhabitants_per_room, 0), 6) AS inhabitants_per_room,
  round(coalesce(neighborhood_facility_density, 0), 6) AS neighborhood_facility_density,
  round(coalesce(building_age, 0), 6) AS building_age,
  round(CAST(coalesce(old_house_flag, 0) AS DOUBLE), 6) AS old_house_flag,
  round(coalesce(lease_ratio, 0), 6) AS lease_ratio,
  round(CAST(coalesce(has_outdoor_space, 0) AS DOUBLE), 6) AS has_outdoor_space,
  round(coalesce(outdoor_area_ratio, 0), 6) AS outdoor_area_ratio
FROM R""", clean=True).replace("\n)\n, E AS", "\n),\nE AS"),
    "split_hash": f"""
SELECT o_orderkey,
  CASE WHEN {HASH_U.format(k='o_orderkey')} < 0.2 THEN 'test'
       WHEN {HASH_U.format(k='o_orderkey')} < 0.2 + 0.1 THEN 'val' ELSE 'train' END AS split,
  CAST(floor({HASH_U.format(k='o_orderkey')} * 5) AS INTEGER) AS fold
FROM orders""",
    "fold_statistics": _fold_oracle(),
    "fold_feature_state": _fold_state_oracle(),
    "level_codes": _codes_oracle(),
    "schema_align": with_listing("""
SELECT listing_id, CAST(size_num AS DOUBLE) AS size_num,
  CAST(list_contains(facilities_list, 'lift') AS INTEGER) AS has_lift, 0 AS has_zwembad,
  round(ln(1 + coalesce(CAST(size_num AS DOUBLE), 0)), 6) AS log_size_num,
  CAST(NULL AS DOUBLE) AS missing_feature
FROM C""", clean=True),
    "model_vector": with_listing("""
SELECT listing_id, size_num, CAST(list_contains(facilities_list, 'lift') AS INTEGER) AS has_lift,
  round(nb_families, 6) AS families_with_children_pct FROM C""", clean=True),
    "schema_diff": with_listing("""
SELECT 'missing' AS kind, 'energy_label_encoded' AS feature, count(*) AS n_rows FROM C
UNION ALL SELECT 'missing', 'size_num', count(*) FROM C WHERE size_num IS NULL HAVING count(*) > 0
UNION ALL SELECT 'missing', 'nr_rooms', count(*) FROM C WHERE nr_rooms_d IS NULL HAVING count(*) > 0
UNION ALL SELECT 'extra', 'price_num', count(*) FROM C WHERE price_num IS NOT NULL
  HAVING count(*) > 0""", clean=True),
    "price_per_m2": with_listing("""
SELECT listing_id, round(CAST(price_num AS DOUBLE) / nullif(CAST(size_num AS DOUBLE), 0), 6)
  AS price_per_m2 FROM C""", clean=True),
    "mask_filters": """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1995-01-01'
  AND o_totalprice > 100000""",
    "drop_columns": with_listing("""
SELECT listing_id, address, price, contribution_vve, size, external_storage, year_of_construction,
  nr_rooms, bathrooms, toilets, bedrooms, facilities, postal_code, roof_type, status, energy_label,
  located_on, balcony, neighborhood FROM L"""),
}
