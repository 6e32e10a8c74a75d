"""Engineered features (FE-*) and the fit/transform feature pipeline (FE-8/9/10).

``fit_features`` runs a handful of aggregation jobs on the training rows and
returns a JSON-serialisable ``FeatureMeta``; ``transform_features`` applies the
same meta to any split, a batch to score, or a micro-batch. There is no pivot at
transform time: every data-dependent column set (one-hot levels, log columns) is
fixed in the meta. ``fit_fold_features`` fits one meta per fold in the same jobs.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcel.functions import geo as G
from parcel.functions import parse as P
from parcel.operators import fit as FIT
from parcel.operators import folds as FO
from parcel.operators import geo_join as GJ
from parcel.operators import quantiles as Q
from parcel.sources.store import delete, scratch, scratch_path

# Fixed values that must match the reference's results.
ENERGY_ORDER = ["G", "F", "E", "D", "C", "B", "A", "A+", "A++", "A+++", "A++++"]
LUXURY_WEIGHTS = {"has_lift": 1.0, "has_sauna": 2.0, "has_domotica": 1.5,
                  "has_airconditioning": 1.0, "has_zwembad": 3.0}
DEFAULT_NUMERIC = ["size_num", "contribution_vve_num", "external_storage_num", "nr_rooms",
                   "bathrooms", "toilets", "num_facilities", "inhabitants_in_neighborhood",
                   "families_with_children_pct", "price_per_m2_neighborhood"]
DEFAULT_FLAGS = ["has_mechanische_ventilatie", "has_tv_kabel", "has_lift",
                 "has_natuurlijke_ventilatie", "has_schuifpui", "has_glasvezelkabel",
                 "has_frans_balkon", "has_buitenzonwering", "has_zonnepanelen",
                 "has_airconditioning", "has_domotica", "has_sauna", "has_zwembad"]
FOLD_FLAGS = DEFAULT_FLAGS + ["has_balansventilatie", "has_dakraam", "has_alarminstallatie",
                              "has_rookkanaal", "has_elektra", "has_cctv", "has_rolluiken",
                              "has_stromend_water", "has_satellietschotel"]
EXTRA_FEATURES = ["floor_level", "lease_years_remaining", "backyard_num", "balcony_flag",
                  "energy_label_encoded", "luxury_score", "num_luxury_facilities",
                  "has_high_end_facilities", "luxury_density", "size_per_luxury",
                  "luxury_x_price_m2", "luxury_x_size", "luxury_x_inhabitants"]
EXPANSION_FEATURES = ["room_utilization_ratio", "floor_to_size", "external_storage_ratio",
                      "inhabitants_per_room", "neighborhood_facility_density", "building_age",
                      "old_house_flag", "lease_ratio", "has_outdoor_space",
                      "outdoor_area_ratio"]
CURRENT_YEAR = 2025


def _c(name) -> Column:
    return F.col(name) if isinstance(name, str) else name


def _num(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """A numeric column, or a constant when the column is absent (plan-time check)."""
    return F.col(name).cast("double") if name in df.columns else F.lit(default)


# ---------------------------------------------------------------------------- FE-1
def energy_ordinal(c, on_unknown: str = "error") -> Column:
    """FE-1: G..A++++ -> 0..10; NULL, 'N/A' and '0' -> G; unknown -> error (or NULL)."""
    c = _c(c).cast("string")
    label = F.when(c.isNull() | c.isin("N/A", "0"), F.lit("G")).otherwise(c)
    mapping = F.create_map(*[x for i, lv in enumerate(ENERGY_ORDER)
                             for x in (F.lit(lv), F.lit(float(i)))])
    code = mapping[label]
    if on_unknown == "error":
        return F.when(code.isNull(), F.raise_error(
            F.concat(F.lit("unknown energy label: "), label)).cast("double")).otherwise(code)
    return code


# ---------------------------------------------------------------------------- FE-4/5
def binary_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """FE-4: flags as int, a missing column or NULL -> 0."""
    return df.withColumns({f: (F.coalesce(F.col(f).cast("int"), F.lit(0)) if f in df.columns
                               else F.lit(0)) for f in flags})


def extra_numeric(df: DataFrame, current_year: int = CURRENT_YEAR) -> DataFrame:
    """FE-5: floor level, lease years (NULL -> 0), backyard number, balcony flag."""
    return df.withColumns({
        "floor_level": P.extract_floor("located_on"),
        "lease_years_remaining": F.coalesce(
            P.extract_lease_years("ownership_type", current_year), F.lit(0)),
        "backyard_num": F.coalesce(P.to_float("backyard"), F.lit(0.0)),
        "balcony_flag": P.presence_flag("balcony"),
    })


# ---------------------------------------------------------------------------- FE-6/7
def luxury_features(df: DataFrame) -> DataFrame:
    """FE-6: weighted luxury score, count, >=3 flag, density per room, size per score."""
    flag = {f: _num(df, f) for f in LUXURY_WEIGHTS}
    score = sum((flag[f] * F.lit(w) for f, w in LUXURY_WEIGHTS.items()), F.lit(0.0))
    count = sum((flag[f] for f in LUXURY_WEIGHTS), F.lit(0.0))
    rooms = F.col("nr_rooms").cast("double")
    df = df.withColumns({"luxury_score": score, "num_luxury_facilities": count})
    return df.withColumns({
        "has_high_end_facilities": (F.col("num_luxury_facilities") >= 3).cast("int"),
        "luxury_density": F.col("luxury_score") / F.when(rooms == 0, F.lit(1.0)).otherwise(rooms),
        "size_per_luxury": F.col("size_num").cast("double") / (F.col("luxury_score") + 1),
    })


def luxury_interactions(df: DataFrame) -> DataFrame:
    """FE-7: luxury score x price/m², x size, x inhabitants (needs FE-6 first)."""
    if "luxury_score" not in df.columns:
        raise ValueError("luxury_interactions builds on the columns of luxury_features")
    s = F.col("luxury_score")
    return df.withColumns({
        "luxury_x_price_m2": s * F.col("price_per_m2_neighborhood").cast("double"),
        "luxury_x_size": s * F.col("size_num").cast("double"),
        "luxury_x_inhabitants": s * F.col("inhabitants_in_neighborhood").cast("double"),
    })


# ---------------------------------------------------------------------------- FE-11..15
def expansion_features(df: DataFrame, current_year: int = CURRENT_YEAR,
                       fill: bool = True) -> DataFrame:
    """FE-11..15: row ratios, neighbourhood ratios, building age, outdoor ratios.

    A zero or NULL denominator gives NULL, and (``fill``) every produced
    value that is NULL, NaN or infinite becomes 0, as in the reference.
    """
    size = _num(df, "size_num", 1.0)
    rooms = _num(df, "nr_rooms", 1.0)
    inh = F.col("inhabitants_in_neighborhood").cast("double") \
        if "inhabitants_in_neighborhood" in df.columns else None
    age = F.lit(float(current_year)) - _num(df, "year_of_construction", float(current_year))
    balcony = _num(df, "balcony_flag")
    backyard = _num(df, "backyard_num")
    out = {
        "room_utilization_ratio": P.safe_ratio(
            _num(df, "size_num") + _num(df, "bathrooms") + _num(df, "toilets"), rooms),
        "floor_to_size": P.safe_ratio(_num(df, "floor_level"), size),
        "external_storage_ratio": P.safe_ratio(_num(df, "external_storage_num"), size),
        "inhabitants_per_room": P.safe_ratio(inh, rooms) if inh is not None else F.lit(0.0),
        "neighborhood_facility_density": (P.safe_ratio(_num(df, "num_facilities"), inh)
                                          if inh is not None else F.lit(0.0)),
        "building_age": age,
        "old_house_flag": (age > 100).cast("int"),
        "lease_ratio": P.safe_ratio(_num(df, "lease_years_remaining"), age),
        "has_outdoor_space": ((balcony > 0) | (backyard > 0)).cast("int"),
        "outdoor_area_ratio": P.safe_ratio(balcony + backyard, size),
    }
    if fill:
        out = {k: zero_fill(v) for k, v in out.items()}
    return df.withColumns(out)


def zero_fill(c: Column) -> Column:
    """SC-19: NULL, NaN and +-inf -> 0."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(0.0)) \
        .otherwise(d)


# ---------------------------------------------------------------------------- categoricals
def categorical_columns(df: DataFrame) -> DataFrame:
    """FE-3 inputs: district, status, simplified roof/ownership/location, garden."""
    return df.withColumns({
        "postal_district": P.prefix("postal_code_clean", 3),
        "status_cat": F.coalesce(F.col("status"), F.lit("N/A")),
        "roof_cat": P.simplify_roof("roof_type"),
        "ownership_cat": P.simplify_ownership("ownership_type"),
        "location_cat": P.simplify_location("location"),
        "garden_cat": F.coalesce(F.col("garden"), F.lit("None")),
    })


CATEGORICALS = {"postal_district": "postal_district", "status_cat": "status",
                "roof_cat": "roof_type", "ownership_cat": "ownership_type",
                "location_cat": "location", "garden_cat": "garden"}


# ---------------------------------------------------------------------------- pipeline
GEO_FEATURES = ["lat", "lon", "lat_lon_missing", "dist_to_center_bin_encoded"]
CENTROID_KEYS = ["postal_code_clean", "neighborhood"]


@dataclass
class FeatureMeta:
    """Everything ``transform_features`` needs; JSON-serialisable. Scalars and short lists are in
    the meta itself; state that grows with the data (coordinates and centroids with their amenity counts, the index) is
    in written tables that it names, so batches, streams and single rows join the same ones."""
    numeric_features: list[str]
    binary_flags: list[str]
    train_medians: dict[str, float | None]
    log_cols: list[str]
    ohe_levels: dict[str, list[str]]
    current_year: int = CURRENT_YEAR
    extended: bool = True
    tables: dict[str, str] = field(default_factory=dict)
    amenities: dict | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "FeatureMeta":
        return FeatureMeta(**json.loads(text))

    @property
    def ohe_columns(self) -> list[str]:
        return [FIT.one_hot_name(c, lv) for c, lvs in self.ohe_levels.items() for lv in lvs]

    @property
    def count_columns(self) -> list[str]:
        """Amenity counts; ``keep`` may name them, the features are their bins."""
        radius = self.amenities["radius_km"] if self.amenities else {}
        return [GJ.count_column(t, r) for t, rs in radius.items() for r in rs]

    @property
    def expanded_features(self) -> list[str]:
        if not self.extended:
            return []
        return (EXPANSION_FEATURES + (GEO_FEATURES if self.tables else [])
                + [f"{c}_bin_encoded" for c in self.count_columns])

    @property
    def feature_columns(self) -> list[str]:
        return (self.numeric_features + self.log_cols + self.binary_flags + EXTRA_FEATURES
                + self.ohe_columns + self.expanded_features)


def _base_features(df: DataFrame, numeric: Sequence[str], flags: Sequence[str],
                   medians: dict, current_year: int) -> DataFrame:
    df = df.withColumns({c: P.to_float(F.col(c), numeric=_is_numeric(df, c)) for c in numeric})
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(medians.get(c)).cast("double"))
                         for c in numeric})
    df = binary_flags(df, flags)
    df = extra_numeric(df, current_year)
    df = luxury_interactions(luxury_features(df))
    df = df.withColumn("energy_label_encoded", energy_ordinal("energy_label"))
    return categorical_columns(df)


def _is_numeric(df: DataFrame, c: str) -> bool:
    t = df.schema[c].dataType.simpleString()
    return t in ("bigint", "int", "double", "float", "smallint", "tinyint")


def fit_features(train: DataFrame, numeric: Sequence[str] = DEFAULT_NUMERIC,
                 flags: Sequence[str] = DEFAULT_FLAGS, **options) -> FeatureMeta:
    """FE-8: fit medians, log columns, one-hot levels without constant ones and, given
    ``geo``, coordinate centroids on the training rows."""
    return _fit(train, None, [None], numeric, flags, **options)[None]


def fit_fold_features(df: DataFrame, fold: str, k: int, numeric: Sequence[str] = DEFAULT_NUMERIC,
                      flags: Sequence[str] = FOLD_FLAGS, **options) -> list[FeatureMeta]:
    """FE-10: one meta per fold, fitted on the rows of the other folds, by the same number of
    jobs as one fit: every statistic is summarised per fold and added up over the others."""
    metas = _fit(df, fold, list(range(k)), numeric, flags, **options)
    return [metas[f] for f in range(k)]


def _fit(df: DataFrame, fold: str | None, targets: list, numeric: Sequence[str], flags: Sequence[str],
         threshold_skew: float = 0.5, low_variance: float = 0.95, current_year: int = CURRENT_YEAR,
         extended: bool = True, geo: DataFrame | None = None, amenities: DataFrame | None = None,
         radius_km: dict[str, Sequence[float]] = GJ.AMENITY_RADIUS_KM, state_dir: str | None = None
         ) -> dict:
    """``geo``: address -> coordinate observations (the distance features); ``amenities``: points of
    interest (their counts; they need ``geo``). ``state_dir`` names the folder of the state's tables."""
    numeric, flags = list(numeric), list(flags)
    with_geo = extended and geo is not None
    if amenities is not None and extended and not with_geo:
        raise ValueError("amenity counts need coordinates: give geo as well")
    state = state_dir or scratch_path(df.sparkSession, "parcel_feature_state")
    parsed = {c: P.to_float(F.col(c), numeric=_is_numeric(df, c)) for c in numeric}
    # the fitted columns are parsed and written once; every job below reads that narrow table
    places = [c for c in ("address", *CENTROID_KEYS) if with_geo]
    narrow = categorical_columns(df).select(
        (F.lit(0) if fold is None else F.col(fold).cast("int")).alias("_part"),
        *[parsed[c].alias(c) for c in numeric], *CATEGORICALS, *places)
    with scratch(narrow) as rows:
        medians = Q.exact(rows, numeric, [0.5], None if fold is None else "_part", len(targets))
        stats, count = FO.moments(rows, numeric, "_part")
        levels = FIT.one_hot_levels(rows, list(CATEGORICALS), targets, count, low_variance)
        tables, spec = {}, None
        if with_geo:
            tables, spec = _geo_state(rows, geo, amenities, radius_km, targets, state)
    metas = {}
    for t in targets:
        middle = {c: medians[t][c][0] for c in numeric}
        rows_of = sum(n for p, n in count.items() if p != t)
        logs = [f"log_{c}" for c in numeric
                if _log_helps(FO.others(stats[c], t, FO.Moments()), middle[c], rows_of, threshold_skew)]
        own = {k: f"{v}/target={-1 if t is None else t}" if k in CENTROID_KEYS else v for k, v in tables.items()}
        metas[t] = FeatureMeta(numeric, flags, middle, logs, levels[t], current_year, extended, own, spec)
    return metas


def _geo_state(rows: DataFrame, geo: DataFrame, amenities: DataFrame | None, radius_km: dict[str, Sequence[float]],
               targets: list, state: str) -> tuple[dict[str, str], dict | None]:
    """The tables of coordinates and centroids. A row's place is always one of theirs or the city
    centre, so the amenities are counted here, once for each place: the counts stand next to the
    coordinates, and transforming a row takes no further join."""
    read = rows.sparkSession.read.parquet
    tables, spec = {key: f"{state}/{key}" for key in ("coordinates", *CENTROID_KEYS)}, None
    plain = {key: path if amenities is None else f"{path}_places" for key, path in tables.items()}
    GJ.dedupe_geo_dim(geo).write.parquet(plain["coordinates"])
    known = GJ.attach_coordinates(rows, read(plain["coordinates"]))
    for key in CENTROID_KEYS:
        GJ.fold_centroids(known, key, "_part", targets).write.partitionBy("target").parquet(plain[key])
    if amenities is None:
        return tables, spec
    index, spec = GJ.build_amenity_index(amenities, radius_km)
    tables["amenity_index"] = f"{state}/amenity_index"
    index.write.parquet(tables["amenity_index"])
    names = {"coordinates": "", **{key: f"{key}_" for key in CENTROID_KEYS}}
    places = rows.sparkSession.createDataFrame([G.CITY_CENTER], "lat double, lon double")
    for key, own in names.items():
        places = places.union(read(plain[key]).select(f"{own}lat", f"{own}lon"))
    with scratch(GJ.counted_places(places, read(tables["amenity_index"]), spec)) as counted:
        center = counted.where((F.col("lat") == G.CITY_CENTER[0]) & (F.col("lon") == G.CITY_CENTER[1])).first()
        counts = counted.columns[2:]
        spec["center"] = {c: center[c] for c in counts}
        for key, own in names.items():
            table = read(plain[key])
            table = table.join(counted.toDF(*[f"{own}{c}" for c in counted.columns]),
                               [f"{own}lat", f"{own}lon"], "left").select(
                                   *table.columns, *[f"{own}{c}" for c in counts])
            w = table.write if key == "coordinates" else table.write.partitionBy("target")
            w.parquet(tables[key])
    for path in plain.values():
        delete(rows.sparkSession, path)
    return tables, spec


def _log_helps(known: "FO.Moments", median: float | None, rows: int, threshold: float) -> bool:
    """IM-3 on the imputed column: its known values and the median in place of the others."""
    filled = known + FO.Moments.repeated(median, rows - known.n)
    return filled.n == rows and filled.lo > 0 and filled.skew is not None and abs(filled.skew) > threshold


def attach_geo(df: DataFrame, meta: FeatureMeta) -> DataFrame:
    """FE-15: coordinates by address, the state's centroids where there are none, the distance bin,
    the amenity counts of that place and their bins."""
    read = df.sparkSession.read.parquet
    more = {c: F.lit(meta.amenities["center"][c]).cast("bigint") for c in meta.count_columns}
    out = GJ.attach_coordinates(df, read(meta.tables["coordinates"]), more=list(more))
    out = GJ.fill_coordinates(out, *(read(meta.tables[k]) for k in CENTROID_KEYS), more=more)
    out = out.withColumn("dist_to_center_bin_encoded", G.distance_to_center_bin("lat", "lon"))
    return out.withColumns({f"{c}_bin_encoded": G.count_bin(F.col(c)) for c in meta.count_columns})


def transform_features(df: DataFrame, meta: FeatureMeta, keep: Sequence[str] = ()) -> DataFrame:
    """FE-9: apply a fitted meta to any split, batch or micro-batch: a projection, and joins with
    the state's tables where the meta has some."""
    out = _base_features(df, meta.numeric_features, meta.binary_flags, meta.train_medians,
                         meta.current_year)
    out = FIT.apply_log(out, meta.log_cols)
    out = FIT.apply_one_hot(out, meta.ohe_levels)
    if meta.extended:
        out = expansion_features(out.withColumn("year_of_construction",
                                                _num(out, "year_of_construction",
                                                     float(meta.current_year))),
                                 meta.current_year)
        if meta.tables:
            out = attach_geo(out, meta)
    cols = [F.col(c).cast("double").alias(c) for c in meta.feature_columns]
    return out.select(*[F.col(k) for k in keep if k not in meta.feature_columns], *cols)
