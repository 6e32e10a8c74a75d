"""Record errors (SRC-3, SM-3): every parser's failure next to its value, never a failed job.

A check names a cause, a raw field and the parser whose result must be there when the field holds
text. ``with_errors`` gathers the failures of a record into one array column; a record whose JSON
text could not be read has the single error ``corrupt_json`` with that text. ``dead_letters`` has
one row per record and error, ``error_counts`` one per cause.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcel.functions import parse as P
from parcel.operators.features import energy_ordinal

CORRUPT = "_corrupt_record"
CORRUPT_CAUSE = "corrupt_json"
ERROR_TYPE = "array<struct<cause:string,detail:string>>"

Check = tuple[str, str, Callable[[Column], Column]]

#: (cause, raw field, parser whose NULL is a failure when the field is there)
CHECKS: list[Check] = [
    ("price", "price", P.parse_price),
    ("size", "size", P.parse_size),
    ("year_of_construction", "year_of_construction", P.parse_year),
    ("rooms", "nr_rooms", P.coerce_numeric),
    ("postal_code", "postal_code", lambda c: F.when(F.upper(F.trim(c)).rlike(P.POSTAL_RE), c)),
    ("energy_label", "energy_label", lambda c: energy_ordinal(c, on_unknown="null")),
]


def with_errors(df: DataFrame, checks: Sequence[Check] = CHECKS, out: str = "errors") -> DataFrame:
    """``df`` (raw, conformed records) plus ``out``: the record's failures, empty when there are none."""
    failed = [F.when(P.nullify_sentinels(F.col(field)).isNotNull() & parse(F.col(field)).isNull(),
                     F.struct(F.lit(cause).alias("cause"), F.col(field).cast("string").alias("detail")))
              for cause, field, parse in checks if field in df.columns]
    fields = F.filter(F.array(*failed), lambda e: e.isNotNull()) if failed else F.array()
    errors = fields.cast(ERROR_TYPE)
    if CORRUPT in df.columns:
        whole = F.array(F.struct(F.lit(CORRUPT_CAUSE).alias("cause"), F.col(CORRUPT).alias("detail")))
        errors = F.when(F.col(CORRUPT).isNotNull(), whole).otherwise(errors)
    return df.withColumn(out, errors)


def is_readable(errors: str = "errors") -> Column:
    """Whether there is a record to score."""
    return ~F.exists(errors, lambda e: e["cause"] == CORRUPT_CAUSE)


def dead_letters(df: DataFrame, keep: Sequence[str], errors: str = "errors") -> DataFrame:
    """(keep..., cause, detail): one row per record and error."""
    return df.select(*keep, F.inline(errors))


def error_counts(df: DataFrame, errors: str = "errors") -> DataFrame:
    """(cause, n): records per cause, records without errors under ``none``."""
    clean = F.array(F.struct(F.lit("none").alias("cause"), F.lit(None).cast("string").alias("detail")))
    every = F.when(F.size(errors) == 0, clean).otherwise(F.col(errors))
    return df.select(F.inline(every)).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
