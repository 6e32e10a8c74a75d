"""Raw listing -> clean listing (the `preprocess_df` stage) as one projection.

Every step is a column expression, so the whole stage compiles into a single
whole-stage-codegen projection over the scan; nothing here runs a job. The
only data-dependent part, the facility vocabulary behind the ``has_*``
indicators, is fitted state passed in (see ``parcel.operators.fit``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcel.functions import nested as N
from parcel.functions import parse as P

# Fixed values that must match the reference's results.
DEFAULT_NUMERIC_COLS = ["bedrooms", "nr_rooms", "bathrooms", "toilets", "year_of_construction"]
RAW_DROP = ["price", "contribution_vve", "size", "external_storage"]

Parser = Callable[[Column], Column]

DEFAULT_PARSERS: dict[str, Parser] = {
    "price": P.parse_price,
    "contribution_vve": P.parse_price,
    "size": P.parse_size,
    "external_storage": P.parse_size,
    "year_of_construction": P.parse_year,
}


def apply_parsers(df: DataFrame, parsers: dict[str, Parser], suffix: str = "_num") -> DataFrame:
    """SC-17 / UD-1: ``{column: Column -> Column}`` -> ``<column><suffix>`` columns."""
    present = {c: fn for c, fn in parsers.items() if c in df.columns}
    return df.withColumns({c + suffix: fn(F.col(c)) for c, fn in present.items()})


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SC-16: listed columns -> double, unparseable text -> NULL."""
    return df.withColumns({c: P.coerce_numeric(F.col(c)) for c in cols if c in df.columns})


def standardize_names(df: DataFrame) -> DataFrame:
    """SC-22: the legacy ``contribution`` key feeds ``contribution_vve``."""
    if "contribution" in df.columns:
        if "contribution_vve" in df.columns:
            df = df.withColumn("contribution_vve",
                               F.coalesce(F.col("contribution_vve"), F.col("contribution")))
            return df.drop("contribution")
        return df.withColumnRenamed("contribution", "contribution_vve")
    return df


def flatten_outdoor(df: DataFrame, col: str = "outdoor_features") -> DataFrame:
    """NE-5: outdoor map -> location, garden, backyard, garden_location."""
    if col not in df.columns:
        return df
    out = {name: N.outdoor_field(F.col(col), key) for key, name in N.OUTDOOR_KEYS.items()}
    # A raw column of the same name (strict schema duplicate, A-16) wins when present.
    for name in list(out):
        if name in df.columns:
            out[name] = N.first_non_null(P.nullify_sentinels(F.col(name)), out[name])
    return df.withColumns(out).drop(col)


def facility_indicators(df: DataFrame, vocabulary: Sequence[str],
                        list_col: str = "facilities_list") -> DataFrame:
    """NE-3 / NE-11: one boolean per fitted vocabulary item (static schema)."""
    return df.withColumns({N.indicator_name(v): F.array_contains(F.col(list_col), v)
                           for v in vocabulary})


def facility_flags(df: DataFrame, flags: Sequence[str], list_col: str = "facilities_list") -> DataFrame:
    """NE-11: the indicators a model asks for by column name, whatever items occur."""
    return facility_indicators(df, [N.indicator_item(f) for f in flags], list_col)


def expand_facilities(df: DataFrame, vocabulary: Sequence[str] | None) -> DataFrame:
    """NE-1 / NE-3 / NE-4: facilities text -> list, indicators, count."""
    df = df.withColumn("facilities_list", N.facilities_list(F.col("facilities")))
    if vocabulary:
        df = facility_indicators(df, vocabulary)
    return df.withColumn("num_facilities", F.size("facilities_list"))


def expand_cadastral(df: DataFrame) -> DataFrame:
    """NE-6 / NE-7 / NE-8: parcels, first ownership situation, charges."""
    out = {}
    if "cadastral_parcels" in df.columns:
        out["num_parcels"] = N.parcels_count(F.col("cadastral_parcels"))
        out["parcels_concat"] = N.parcels_concat(F.col("cadastral_parcels"))
    if "ownership_situations" in df.columns:
        first = N.first_or_empty(F.col("ownership_situations"))
        if "ownership_type" in df.columns:
            first = N.first_non_null(F.col("ownership_type"), first)
        out["ownership_type"] = first
    if "charges" in df.columns:
        out["charges_summary"] = N.join_or_empty(F.col("charges"))
    return df.withColumns(out).drop("cadastral_parcels", "ownership_situations", "charges")


def split_postal(df: DataFrame, col: str = "postal_code") -> DataFrame:
    """SC-7: postal text -> postal_code_clean, city."""
    return df.withColumns({"postal_code_clean": P.postal_code_clean(F.col(col)),
                           "city": P.postal_city(F.col(col))}).drop(col)


def expand_neighborhood(df: DataFrame, col: str = "neighborhood_details") -> DataFrame:
    """NE-9: neighbourhood map -> inhabitants, families share, price per m²."""
    if col not in df.columns:
        return df
    m = F.col(col)
    return df.withColumns({
        "inhabitants_in_neighborhood": N.neighborhood_inhabitants(m),
        "families_with_children_pct": N.neighborhood_families(m),
        "price_per_m2_neighborhood": N.neighborhood_price_m2(m),
    }).drop(col)


def preprocess_listings(df: DataFrame, vocabulary: Sequence[str] | None = None,
                        numeric_cols: Sequence[str] | None = DEFAULT_NUMERIC_COLS,
                        drop_raw: bool = False,
                        parsers: dict[str, Parser] | None = None,
                        extra_steps: Sequence[Callable[[DataFrame], DataFrame]] = ()
                        ) -> DataFrame:
    """Raw listings -> clean listings (one projection, no job).

    ``vocabulary`` is the fitted facility vocabulary (NE-2); ``extra_steps``
    are user ``DataFrame -> DataFrame`` steps run after the built-in ones (UD-3).
    """
    df = standardize_names(df)
    df = apply_parsers(df, parsers or DEFAULT_PARSERS)
    if numeric_cols:
        df = coerce_numeric(df, numeric_cols)
    for step in (flatten_outdoor,
                 lambda d: expand_facilities(d, vocabulary),
                 expand_cadastral, split_postal, expand_neighborhood, *extra_steps):
        df = step(df)
    if drop_raw:
        df = df.drop(*RAW_DROP)
    return df.drop("has_n/a")
