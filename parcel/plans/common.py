"""Shared building blocks for the query catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcel.operators.preprocess import preprocess_listings
from parcel.sources.listings import listing_view

# Fixed values that must match the reference's results (preprocessing config).
IMPUTE_DEFAULT = {
    "size_num": "median",
    "external_storage_num": "constant:0",
    "year_of_construction": "median",
    "contribution_vve_num": "constant:0",
}


def clean_listings(spark: SparkSession, sf_dir: str, vocabulary=None) -> DataFrame:
    """Listing view -> preprocess (one projection over the join)."""
    return preprocess_listings(listing_view(spark, sf_dir), vocabulary=vocabulary)


def r6(c) -> Column:
    """Round a double to 6 decimals (both engines round half away from zero)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r2(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 2)
