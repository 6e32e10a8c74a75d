"""Work along an order that spans the whole table, without a task that sees all of it.

``in_slices`` writes the rows once as ranges of the order (Spark samples the range boundaries, of
whatever type the columns have) and names each row's range. What one range adds to the next is a
small table of one row per group and range, so a running value is the value inside the range
combined with what the earlier ranges of its group carry in. There are about as many ranges as a
range has rows, at most (the square root of the table's rows each, from ``slice_rows`` on), which
bounds both windows however large a group is.

Nulls come first, as Spark sorts them. Rows with equal keys stay together: give a unique last key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcel.sources.store import scratch_table

SLICE_ROWS = 100_000
SLICE, CARRY = "_slice", "_carry"


def in_slices(df: DataFrame, order: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` plus ``_slice``, the number of the row's range of ``order``; written once, so that
    every use (and every retry) sees the same ranges."""
    rows = df.count()
    slices = max(1, math.ceil(rows / max(slice_rows, math.isqrt(rows))))
    return scratch_table(df.repartitionByRange(slices, *order).withColumn(
        SLICE, F.spark_partition_id()))


def carried(parts: DataFrame, group: Sequence[str], total: Column,
            combine: Callable[[str], Column]) -> DataFrame:
    """(group, _slice, _carry): ``total`` of the group's earlier slices, combined; null where
    there are none."""
    group = list(group)
    summary = parts.groupBy(*group, SLICE).agg(total.alias("_total"))
    earlier = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*group, SLICE, combine("_total").over(earlier).alias(CARRY))


def with_carry(parts: DataFrame, carry: DataFrame, group: Sequence[str]) -> DataFrame:
    """``parts`` plus ``_carry`` (group columns may be null)."""
    names = {c: f"_g_{c}" for c in [*group, SLICE]}
    side = carry.withColumnsRenamed(names)
    same = F.lit(True)
    for c, g in names.items():
        same &= F.col(c).eqNullSafe(F.col(g))
    return parts.join(side, same, "left").drop(*names.values())


def running_min(df: DataFrame, value: str, order: Sequence[str], group: str,
                out: str = "best_value", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """WN-2: the smallest value of the group up to and including the row. A group that holds a
    third of all rows is spread over many tasks."""
    order = list(order)
    parts = in_slices(df, order, slice_rows)
    inside = F.min(value).over(Window.partitionBy(group, SLICE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    carry = carried(parts, [group], F.min(value), F.min)
    return with_carry(parts.withColumn("_inside", inside), carry, [group]).withColumn(
        out, F.least("_inside", CARRY)).drop("_inside", CARRY, SLICE)


def numbered(df: DataFrame, order: Sequence[str], group: Sequence[str], out: str = "code",
             slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` plus the row's place in its group (from 0) along ``order``: column names, ascending,
    which together tell the group's rows apart. The table is ranged by the group and the order."""
    group, order = list(group), list(order)
    parts = in_slices(df, [*group, *order], slice_rows)
    place = F.row_number().over(Window.partitionBy(*group, SLICE).orderBy(*order))
    carry = carried(parts, group, F.count(F.lit(1)), F.sum)
    return with_carry(parts.withColumn("_place", place), carry, group).withColumn(
        out, (F.col("_place") - 1 + F.coalesce(CARRY, F.lit(0))).cast("bigint")).drop(
            "_place", CARRY, SLICE)
