"""Deterministic hash splits and folds (SP-1..SP-3).

The split of a row depends only on its key and the seed, never on
partitioning or row order, so re-running, repartitioning or losing an
executor cannot move a row between train and test (``randomSplit`` can).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_unit(key, seed: int = 42) -> Column:
    """Uniform value in [0, 1) from md5(key ':' seed) (first 32 bits)."""
    key = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(2.0 ** 32)


def split_column(key, test_size: float = 0.2, val_size: float | None = None,
                 seed: int = 42) -> Column:
    """SP-1 / SP-2: 'test' for u < test, 'val' for the next ``val_size`` share, else 'train'.

    As in the reference, ``val_size`` is a share of the whole table (the
    reference takes ``val/(1-test)`` of the remainder, which is the same share).
    """
    u = hash_unit(key, seed)
    expr = F.when(u < F.lit(test_size), F.lit("test"))
    if val_size:
        expr = expr.when(u < F.lit(test_size + val_size), F.lit("val"))
    return expr.otherwise(F.lit("train"))


def with_split(df: DataFrame, key: str, test_size: float = 0.2, val_size: float | None = None,
               seed: int = 42, name: str = "split") -> DataFrame:
    return df.withColumn(name, split_column(key, test_size, val_size, seed))


#: Folds of one split's rows need draws of their own: by the split's seed they would be uneven.
FOLD_SEED = 43


def fold_column(key, k: int = 5, seed: int = 42) -> Column:
    """SP-3: fold id in 0..k-1 from the same hash (shuffled K-fold)."""
    return F.floor(hash_unit(key, seed) * F.lit(k)).cast("int")


def with_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42,
               name: str = "fold") -> DataFrame:
    return df.withColumn(name, fold_column(key, k, seed))
