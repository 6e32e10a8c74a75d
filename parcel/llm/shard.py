"""Sharding by sampled splitters.

Records are ordered by (md5 of the text, doc_id), so equal texts are neighbours. A sample in
which a record's chance grows with its size gives the quantile boundaries of SPLITS ranges of
about equal bytes; a range with more than ``range_rows`` records is subdivided by splitters
sampled inside it, until none is overfull. A hot text is no obstacle: boundaries within it fall
on doc_id. Every range is then sorted by one task, exact totals of the ranges before it give
each record its place in the whole order, and a shard takes the records whose middle byte falls
into its share. Shard sizes differ from an equal share by one record's size at most.

Null text has size 1 and checksum 0. Null doc_ids come first among equal texts. Repeated rows
each get a place of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcel.llm.common import cut

SPLITS = 128
SAMPLES = 64              # sampled records per range, per level
RANGE_ROWS = 200_000      # records of a range that one task sorts
NO_ID = -(1 << 63)


def range_of(key: Column, doc_id: Column, bounds: list[tuple[str, int]], first: int = 0) -> Column:
    """Number of bounds at or below (key, doc_id), by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    k, d = bounds[mid]
    below = (key < F.lit(k)) | ((key == F.lit(k)) & (doc_id < F.lit(d)))
    return F.when(below, range_of(key, doc_id, bounds[:mid], first)).otherwise(
        range_of(key, doc_id, bounds[mid + 1:], first + mid + 1))


def sampled(rows: DataFrame, chance: Column, seed: int) -> DataFrame:
    """Rows kept with probability ``chance``, the same ones in every run."""
    u = F.pmod(F.xxhash64("_key", "_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(u < chance)


def quantiles(sample: list[tuple], splits: int) -> list[tuple]:
    """Up to splits - 1 boundaries of equal shares of a sorted sample (its rows were drawn by
    size, so each stands for as many bytes)."""
    at = [sample[len(sample) * k // splits] for k in range(1, splits)] if sample else []
    return sorted(set(at))


def ranges(rows: DataFrame, range_rows: int = RANGE_ROWS, splits: int = SPLITS) -> DataFrame:
    """``rows`` (_key, _id, size, ...) plus _range: numbers of ranges in the records' order."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    chance = F.col("size") * F.lit(SAMPLES * splits / max(total, 1))
    first = sorted((r[0], r[1]) for r in sampled(rows, chance, 0).select("_key", "_id").collect())
    out = rows.withColumn("_range", range_of(F.col("_key"), F.col("_id"),
                                             quantiles(first, splits)).cast("decimal(38,0)"))
    for level in range(1, 16):
        sums = out.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
        over = sums.where(F.col("n") > range_rows)
        if over.isEmpty():
            return out
        out = cut(out)
        over = cut(over.select(F.col("_range").alias("_over"), "b"))
        inside = out.join(over, F.col("_range") == F.col("_over"))
        drawn = sampled(inside, F.col("size") * SAMPLES * splits / F.col("b"), level)
        # at most SAMPLES * splits or so keys a range, whatever its rows
        bounds = drawn.groupBy("_over").agg(F.sort_array(F.collect_list(
            F.struct("_key", "_id"))).alias("s")).select("_over", F.expr(
                f"transform(sequence(1, {splits - 1}), k -> s[int(size(s) * k / {splits})])"
            ).alias("_bounds"))
        sub = F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(F.size(F.filter(
            "_bounds", lambda b: b <= F.struct("_key", "_id"))))
        out = out.join(bounds, F.col("_range") == F.col("_over"), "left").withColumn(
            "_range", (F.col("_range") * splits + sub).cast("decimal(38,0)")).drop("_over", "_bounds")
    return out


def shard(docs: DataFrame, shards: int = 16, range_rows: int = RANGE_ROWS,
          splits: int = SPLITS) -> DataFrame:
    """Per record: doc_id, size, text_crc32, shard, slot (place in the shard) and byte_start
    (bytes before it in the whole order)."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("_key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id")))
    rows = cut(ranges(rows, range_rows, splits))

    # totals of the ranges before each range: first over groups of ranges, then inside a group
    sums = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    sums = cut(sums.withColumn("_group", F.floor(F.col("_range") / splits)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = prefix_of_groups(sums)
    inner = before(Window.partitionBy("_group").orderBy("_range"))
    starts = sums.join(groups, "_group").select(
        F.col("_range").alias("_r"),
        (F.col("gn") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("n0"),
        (F.col("gb") + F.coalesce(F.sum("b").over(inner), F.lit(0))).alias("b0"))
    total = rows.agg(F.sum("size")).first()[0] or 1

    order = Window.partitionBy("_range").orderBy("_key", "_id", "text_crc32", "size")
    placed = rows.withColumn("_n", F.row_number().over(order)).withColumn(
        "_b", F.coalesce(F.sum("size").over(before(order)), F.lit(0))
    ).join(starts, F.col("_range") == F.col("_r")).select(
        "doc_id", "size", "text_crc32", (F.col("n0") + F.col("_n") - 1).alias("_row"),
        (F.col("b0") + F.col("_b")).alias("byte_start"))
    placed = cut(placed.withColumn("shard", F.expr(
        f"(2 * byte_start + size) * {shards} div {2 * total}").cast("int")))
    firsts = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("_row")).collect()}
    first = F.element_at(F.create_map(*[F.lit(x) for k in sorted(firsts) for x in (k, firsts[k])])
                         if firsts else F.lit(None).cast("map<int,bigint>"), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", "shard",
                         (F.col("_row") - first).alias("slot"), "byte_start")


def prefix_of_groups(sums: DataFrame) -> DataFrame:
    """Totals before each group of ranges. One row per group, a range_rows * splits-th part of
    the records, is what the single task of this window sees."""
    w = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    return sums.groupBy("_group").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).select(
        "_group", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("gn"),
        F.coalesce(F.sum("b").over(w), F.lit(0)).alias("gb"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """The records themselves as Parquet, one folder a shard. (doc_id, checksum, size) says
    which record gets which place; rows repeated in full are interchangeable."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    placed = shard(docs, shards).select(
        F.col("doc_id").alias("_d"), F.col("text_crc32").alias("_c"), F.col("size").alias("_s"),
        "shard", "slot").dropDuplicates(["_d", "_c", "_s"])
    docs.join(placed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.crc32(text) == F.col("_c"))
              ).drop("_d", "_c", "_s").write.partitionBy("shard").parquet(path)
