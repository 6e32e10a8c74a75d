"""Registry of every catalogued query and its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcel.session import configure

from parcel.plans import (q_explore, q_features, q_geo, q_listing, q_ml, q_models, q_pages,
                          q_sources, q_stream)

_MODULES = [q_listing, q_features, q_geo, q_explore, q_models, q_ml, q_pages, q_sources,
            q_stream]


def _configured(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query, wrapped so any session gets the library's SQL settings first."""
    out: dict = {}
    for m in _MODULES:
        out.update({k: _configured(v) for k, v in m.QUERIES.items()})
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _MODULES:
        out.update(getattr(m, "ORACLE", {}))
    return out
