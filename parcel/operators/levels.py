"""Levels of categorical columns and items of lists (NE-2, FE-3) as tables without a ceiling.

``count_levels`` is one grouped aggregation; ``dictionary`` gives every level a dense code by
falling frequency (ties by level), numbered over ranges of the table, so no level list reaches the
driver. ``encode`` joins the codes to the rows; a level that very many rows hold is joined in
slices. ``one_hot`` turns codes into sparse vectors in the JVM, one place per level and none for
nulls and unknown levels. Named indicator columns exist for lists a caller gives, and for levels
whose share lies strictly between 1 - t and t, of which a column has fewer than 1 / (1 - t).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcel.operators.ordered import SLICE_ROWS, numbered

HOT_ROWS = 200_000      # rows of one level that one task joins
MAX_HOT = 10_000        # levels over the threshold, at most: what is broadcast


def count_levels(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """(name, level, n) of the non-null values of several columns, per value of ``by`` if given."""
    group = [] if by is None else [by]
    long = df.select(*group, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        group, list(cols), "name", "level").where(F.col("level").isNotNull())
    return long.groupBy(*group, "name", "level").agg(F.count(F.lit(1)).alias("n"))


def count_items(df: DataFrame, list_col: str) -> DataFrame:
    """(name, level, n) of the items of a list column."""
    return df.select(F.lit(list_col).alias("name"), F.explode(list_col).alias("level")).where(
        F.col("level").isNotNull()).groupBy("name", "level").agg(F.count(F.lit(1)).alias("n"))


def dictionary(counts: DataFrame, min_count: int = 1, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(name, level, n, code): codes 0, 1, ... per name by falling n, then by level."""
    kept = counts.where(F.col("n") >= min_count).select("name", "level", "n", (-F.col("n")).alias("_rank"))
    return numbered(kept, ["_rank", "level"], ["name"], "code", slice_rows).drop("_rank")


def sizes(levels: DataFrame) -> dict[str, int]:
    """Number of levels per name (one row per encoded column)."""
    return {r["name"]: r["size"] for r in levels.groupBy("name").agg(
        F.count(F.lit(1)).alias("size")).collect()}


def most_frequent(levels: DataFrame, k: int) -> list[str]:
    """The k most frequent levels of a dictionary of one name: a list of the caller's length."""
    return [r["level"] for r in levels.where(F.col("code") < k).orderBy("code").collect()]


def encode(df: DataFrame, key: Sequence[str], levels: DataFrame, cols: Sequence[str],
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` plus ``<col>_code``; null where the value is null or not in the dictionary. The
    columns of ``key`` tell rows apart."""
    key, cols = list(key), list(cols)
    total = levels.agg(F.sum("n")).first()[0] or 0
    limit = max(hot_rows, math.ceil(total / MAX_HOT))
    sliced = levels.select("name", "level", "code", F.ceil(F.col("n") / limit).cast("int").alias("_slices"))
    hot = sliced.where("_slices > 1").select("name", "level", "_slices")
    places = sliced.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    long = df.select(F.struct(*key).alias("_key"), *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        ["_key"], cols, "name", "level").where(F.col("level").isNotNull())
    long = long.join(F.broadcast(hot), ["name", "level"], "left").withColumn("_slice", F.pmod(
        F.xxhash64("_key"), F.coalesce("_slices", F.lit(1))).cast("int"))
    codes = long.join(places, ["name", "level", "_slice"]).groupBy("_key").agg(*[
        F.max(F.when(F.col("name") == c, F.col("code"))).alias(f"{c}_code") for c in cols])
    same = F.struct(*key).eqNullSafe(F.col("_key"))
    return df.join(codes, same, "left").drop("_key")


def one_hot(df: DataFrame, size: dict[str, int], cols: Sequence[str], out: str = "levels") -> DataFrame:
    """Sparse vector column ``out`` of the one-hot places of ``<col>_code``, column after column."""
    spark, cols = df.sparkSession, [c for c in cols if size.get(c)]
    doubles = {f"_{c}_d": F.coalesce(F.col(f"{c}_code").cast("double"), F.lit(float(size[c]))) for c in cols}
    last = spark.createDataFrame([tuple(float(size[c] - 1) for c in cols)], ", ".join(
        f"`_{c}_d` double" for c in cols))
    # the encoder's own place for unknown values is the last one, which it leaves out
    encoder = OneHotEncoder(inputCols=list(doubles), outputCols=[f"_{c}_v" for c in cols],
                            handleInvalid="keep", dropLast=True).fit(last)
    wide = encoder.transform(df.withColumns(doubles))
    joined = VectorAssembler(inputCols=[f"_{c}_v" for c in cols], outputCol=out).transform(wide)
    return joined.drop(*doubles, *[f"_{c}_v" for c in cols])
