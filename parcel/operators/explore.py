"""Descriptive analytics, outliers and trends (AG-*, OD-*, GE-6).

Every profile is one aggregation over the input (algebraic aggregates with
partial combine), reshaped with ``inline`` into long form. Quantiles go
through ``fit.exact_quantiles`` (bounded memory) unless ``exact=False``.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcel.functions.geo import cut
from parcel.operators.fit import quantiles


def _long(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One aggregation row -> long form (one row per struct)."""
    return df.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """AG-4: count, mean, std (sample), min, quartiles, max per column (long form)."""
    qs = quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
    rows = []
    for c in cols:
        x = F.col(c).cast("double")
        q = qs[c]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("count"),
                             F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                             F.min(x).alias("min"), F.lit(q[0]).cast("double").alias("p25"),
                             F.lit(q[1]).cast("double").alias("p50"),
                             F.lit(q[2]).cast("double").alias("p75"), F.max(x).alias("max")))
    return _long(df, rows)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG-5 / AG-12: (column, value, n) for non-NULL values of several columns, one shuffle."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column_name", "value")
    return (long.where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AG-6: NULL count per column (one aggregation)."""
    cols = list(cols or df.columns)
    return _long(df, [F.struct(F.lit(c).alias("column_name"),
                               F.count_if(F.col(c).isNull()).alias("n_null")) for c in cols])


def missing_patterns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG-7: count of rows per combination of NULL flags."""
    return (df.groupBy(*[F.col(c).isNull().alias(f"{c}_missing") for c in cols])
            .agg(F.count(F.lit(1)).alias("n_rows")))


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """AG-8: Pearson correlation of each column with the target (pairwise complete)."""
    return _long(df, [F.struct(F.lit(c).alias("column_name"),
                               F.corr(F.col(c).cast("double"), F.col(target).cast("double"))
                               .alias("corr")) for c in cols])


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG-9: all ordered pairs (a, b, r) from one aggregation over the upper triangle
    (r is symmetric; the diagonal is computed, not assumed)."""
    cols = list(cols)
    stats, rows = {}, []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            stats[(a, b)] = f"c_{len(stats)}"
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(n)
                   for (a, b), n in stats.items()])
    for a, b in itertools.product(cols, cols):
        key = (a, b) if (a, b) in stats else (b, a)
        rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                             F.col(stats[key]).alias("corr")))
    return agg.select(F.inline(F.array(*rows)))


def high_corr_pairs(matrix: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """AG-10: upper-triangle pairs with |r| > threshold."""
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return matrix.where((order[F.col("col_a")] < order[F.col("col_b")])
                        & (F.abs("corr") > threshold))


def histogram(df: DataFrame, col: str, bins: int = 10, log: bool = False) -> DataFrame:
    """AG-11: equal-width histogram between min and max; the max falls in the last bin.

    The limits are fitted first (one small job), so the binning is a plain
    projection + partial aggregation; empty bins come from the bin domain.
    """
    x = F.col(col).cast("double")
    if log:
        x = F.log1p(x)
    v = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    lim = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi = lim["lo"], lim["hi"]
    if lo is None:
        lo = hi = 0.0
    width = (hi - lo) / bins
    b = (F.lit(0) if hi == lo else
         F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))).cast("int")
    counted = v.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    domain = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (domain.join(counted, "bin", "left")
            .select("bin", (F.lit(lo) + F.lit(width) * F.col("bin")).alias("lo_edge"),
                    (F.lit(lo) + F.lit(width) * (F.col("bin") + 1)).alias("hi_edge"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def quantile_categories(df: DataFrame, col: str, labels=("Low", "Medium", "High"),
                        probs=(0.0, 0.33, 0.66, 1.0), exact: bool = True) -> Column:
    """GE-6: category from quantile edges, left-closed bins, the maximum in the last bin."""
    q = quantiles(df, [col], list(probs), exact=exact)[col]
    x = F.col(col).cast("double")
    expr = None
    for i, lab in enumerate(labels):
        cond = x < F.lit(q[i + 1]) if i < len(labels) - 1 else x <= F.lit(q[-1])
        cond = cond & (x >= F.lit(q[i]))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def iqr_fences(df: DataFrame, col: str, k: float = 1.5, exact: bool = True
               ) -> tuple[float, float]:
    """OD-1: (q1 - k*IQR, q3 + k*IQR)."""
    q1, q3 = quantiles(df, [col], [0.25, 0.75], exact=exact)[col]
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def binned_trend(df: DataFrame, x: str, y: str, n_bins: int = 10, exact: bool = True
                 ) -> DataFrame:
    """OD-6: quantile bins of x -> mean x, mean y, slope of y on x per bin."""
    probs = [i / n_bins for i in range(1, n_bins)]
    edges = quantiles(df, [x], probs, exact=exact)[x]
    xv = F.col(x).cast("double")
    b = sum((F.when(xv > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return (df.where(xv.isNotNull() & F.col(y).isNotNull())
            .groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(xv).alias("mean_x"),
                 F.avg(F.col(y).cast("double")).alias("mean_y"),
                 F.regr_slope(F.col(y).cast("double"), xv).alias("slope")))


def equal_bins(col, edges: Sequence[float]) -> Column:
    """Right-closed bin codes for fixed edges (alias of ``geo.cut``)."""
    return cut(col, list(edges))
