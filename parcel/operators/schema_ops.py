"""Schema enforcement and projection operators (PR-*, SRC-3/4/5 conform).

All decisions are taken at plan time from ``df.schema``; the result is a
single projection, so aligning a stream or a one-row batch costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DefaultRule = Callable[[str], Column]


def indicator_default(name: str) -> Column:
    """PR-4 default: ``has_*`` indicators -> 0, everything else NULL."""
    return F.lit(0) if name.startswith("has_") else F.lit(None).cast("double")


def zero_default(name: str) -> Column:
    return F.lit(0.0)


def conform(df: DataFrame, expected: Sequence[str], default: DefaultRule = indicator_default,
            types: dict[str, str] | None = None, log_base: dict[str, str] | None = None
            ) -> DataFrame:
    """PR-4 / PR-5 / PR-6 / PR-8 / NE-11: exact column list and order.

    Missing columns get ``default(name)`` (or ``log1p(base)`` for a missing
    ``log_<base>`` when ``log_base`` names the base); extra columns are
    dropped; NULLs in present columns are kept (use ``fill`` for 0).
    """
    present = set(df.columns)
    cols = []
    for name in expected:
        if name in present:
            c = F.col(name)
        elif log_base and name in log_base and log_base[name] in present:
            c = F.log1p(F.coalesce(F.col(log_base[name]).cast("double"), F.lit(0.0)))
        else:
            c = default(name)
        if types and name in types:
            c = c.cast(types[name])
        cols.append(c.alias(name))
    return df.select(*cols)


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """PR-2 / PR-3: NULLs -> 0 on numeric columns only (typed fill, App. A-6)."""
    numeric = [f.name for f in df.schema.fields
               if isinstance(f.dataType, T.NumericType) and (cols is None or f.name in cols)]
    return df.na.fill(0, subset=numeric) if numeric else df


def numeric_only(df: DataFrame) -> DataFrame:
    """PR-7: keep numeric and boolean columns (booleans as int)."""
    keep = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            keep.append(F.col(f.name).cast("int").alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            keep.append(F.col(f.name))
    return df.select(*keep)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """PR-3: fail at plan time when a required feature is absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required features: {missing}")
    return df


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PR-11: drop listed columns that exist (absent names are ignored)."""
    return df.drop(*[c for c in cols if c in df.columns])


def schema_diff(features: DataFrame, expected: Sequence[str], map_col: str = "features"
                ) -> DataFrame:
    """PR-9: per-row missing / extra feature names of a ``map<string,*>`` column."""
    exp = F.array(*[F.lit(c) for c in expected])
    keys = F.map_keys(F.col(map_col))
    return features.withColumns({"missing": F.array_sort(F.array_except(exp, keys)),
                                 "extra": F.array_sort(F.array_except(keys, exp))})


def schema_diff_report(features: DataFrame, expected: Sequence[str],
                       map_col: str = "features") -> DataFrame:
    """PR-9 report: (kind, feature, n_rows) over all rows."""
    d = schema_diff(features, expected, map_col)
    miss = d.select(F.lit("missing").alias("kind"), F.explode("missing").alias("feature"))
    extra = d.select(F.lit("extra").alias("kind"), F.explode("extra").alias("feature"))
    return (miss.unionByName(extra).groupBy("kind", "feature")
            .agg(F.count(F.lit(1)).alias("n_rows")))
