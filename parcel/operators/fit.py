"""Fitted statistics (IM-*, NE-2, FE-3 vocabularies): the only code that runs jobs.

Each ``fit_*`` returns small, JSON-serialisable state (numbers, short lists);
each ``apply_*`` is a pure column transform. Statistics for many columns are
folded into one ``agg`` so a fit costs one scan, not one scan per column.

Exact quantiles (``quantiles.exact``) never buffer a whole column in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcel.functions.nested import indicator_name
from parcel.operators import levels as LV
from parcel.operators import quantiles as Q
from parcel.sources.store import scratch


# ----------------------------------------------------------------------------
# quantiles
# ----------------------------------------------------------------------------

def exact_quantiles(df: DataFrame, col: str | Column, probs: Sequence[float],
                    **options) -> list[float | None]:
    """Exact linear-interpolation quantiles (same as ``percentile`` / ``quantile_cont``).

    NULL and NaN are ignored. Returns one value per probability (None when
    the column has no values). ``options`` as in ``quantiles.exact``.
    """
    src = F.col(col) if isinstance(col, str) else col
    name = col if isinstance(col, str) else "_q"
    return exact_quantiles_multi(df.select(src.alias(name)), [name], probs, **options)[name]


def exact_quantiles_multi(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                          **options) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, all refined together (``quantiles.exact``)."""
    return Q.exact(df, cols, probs, **options)[None]


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              exact: bool = True, accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Quantiles for several columns: exact (default) or one approximate job."""
    if exact:
        return exact_quantiles_multi(df, cols, probs)
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy).alias(c)
                   for c in cols]).first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}


def medians(df: DataFrame, cols: Sequence[str], exact: bool = True) -> dict[str, float | None]:
    return {c: q[0] for c, q in quantiles(df, cols, [0.5], exact=exact).items()}


# ----------------------------------------------------------------------------
# imputation (IM-1, IM-2)
# ----------------------------------------------------------------------------

def fit_impute(df: DataFrame, strategies: dict[str, str], exact: bool = True) -> dict[str, float]:
    """IM-1: ``{col: 'median' | 'mean' | 'constant:x'}`` -> fill values (one mean job)."""
    values: dict[str, float] = {}
    mean_cols, median_cols = [], []
    for c, s in strategies.items():
        if s == "median":
            median_cols.append(c)
        elif s == "mean":
            mean_cols.append(c)
        elif s.startswith("constant:"):
            values[c] = float(s.split(":", 1)[1])
        else:
            raise ValueError(f"{c}: {s!r} is no way to impute (median, mean or constant:<number>)")
    if mean_cols:
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in mean_cols]).first()
        values.update({c: row[c] for c in mean_cols})
    values.update(medians(df, median_cols, exact=exact))
    return values


def apply_impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Fill NULLs with fitted values; filled columns become double."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"),
                                         F.lit(v).cast("double"))
                           for c, v in values.items() if c in df.columns})


# ----------------------------------------------------------------------------
# log selection (IM-3, IM-4), low variance (IM-5)
# ----------------------------------------------------------------------------

def skew_g1(col: Column, n: Column) -> Column:
    """Bias-corrected sample skewness (pandas ``skew``) from Spark's population skewness."""
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


def fit_log_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> list[str]:
    """IM-3: columns whose values are all > 0 and |G1 skew| > threshold -> ``log_<col>``."""
    if not cols:
        return []
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count_if(~F.coalesce(x > 0, F.lit(False))).alias(f"np{i}"),
                 skew_g1(x, F.count(x).cast("double")).alias(f"sk{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        sk = row[f"sk{i}"]
        if row[f"np{i}"] == 0 and sk is not None and not math.isnan(sk) and abs(sk) > threshold:
            out.append(f"log_{c}")
    return out


def apply_log(df: DataFrame, log_cols: Sequence[str]) -> DataFrame:
    """IM-4: ``log_<c> = log1p(c)`` (original kept)."""
    return df.withColumns({lc: F.log1p(F.col(lc[4:]).cast("double")) for lc in log_cols})


def fit_low_variance(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> list[str]:
    """IM-5: 0/1 columns whose modal share is >= threshold (one agg job)."""
    if not cols:
        return []
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}")
                   for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        mean = row[f"m{i}"]
        if mean is None or max(mean, 1.0 - mean) >= threshold:
            out.append(c)
    return out


# ----------------------------------------------------------------------------
# scalers (IM-6)
# ----------------------------------------------------------------------------

# Columns of one standard-scaler job: with more, the fused loop is too long for the JVM to compile
# (70 columns: 6.3 s in one job, 2.3 s in four, 2.7 million rows). Each column of a written table is read once.
SCALER_COLUMNS = 20


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "standard",
               exact: bool = True) -> dict[str, tuple[float, float]]:
    """IM-6: ``{col: (center, scale)}``; a zero scale becomes 1 (as scikit-learn)."""
    def fix(s):
        return 1.0 if s is None or s == 0 or (isinstance(s, float) and math.isnan(s)) else s
    if kind == "standard":
        out = {}
        for k in range(0, len(cols), SCALER_COLUMNS):
            some = cols[k:k + SCALER_COLUMNS]
            row = df.agg(*[f(F.col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(some)
                           for p, f in (("a", F.avg), ("s", F.stddev_pop))]).first()
            out.update({c: (row[f"a{i}"], fix(row[f"s{i}"])) for i, c in enumerate(some)})
        return out
    if kind == "minmax":
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(cols)
                       for p, f in (("lo", F.min), ("hi", F.max))]).first()
        return {c: (row[f"lo{i}"], fix(row[f"hi{i}"] - row[f"lo{i}"])) for i, c in enumerate(cols)}
    if kind == "robust":
        qs = quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
        return {c: (q[1], fix(q[2] - q[0])) for c, q in qs.items()}
    raise ValueError(f"unknown scaler {kind!r}")


def apply_scaler(df: DataFrame, state: dict[str, tuple[float, float]],
                 suffix: str = "") -> DataFrame:
    """(x - center) / scale as a column expression."""
    return df.withColumns({c + suffix: (F.col(c).cast("double") - F.lit(a)) / F.lit(s)
                           for c, (a, s) in state.items()})


# ----------------------------------------------------------------------------
# vocabularies (NE-2, FE-3)
# ----------------------------------------------------------------------------

def fit_vocabulary(df: DataFrame, list_col: str, min_count: int = 1) -> DataFrame:
    """NE-2: items of an array column as a table (name, level, n, code), codes by descending
    frequency (ties by item). ``levels.most_frequent`` names as many as a caller asks for."""
    return LV.dictionary(LV.count_items(df, list_col), min_count)


def fit_one_hot(df: DataFrame, cols: Sequence[str], low_variance: float = 0.95,
                drop_first: bool = True) -> dict[str, list[str]]:
    """FE-3 + IM-5: sorted levels per column that get an indicator: not the first level, and
    not one whose indicator would be constant in ``low_variance`` of the rows."""
    return one_hot_levels(df.withColumn("_part", F.lit(0)), cols, [None], {0: df.count()}, low_variance,
                          drop_first)[None] if cols else {}


def one_hot_levels(rows: DataFrame, cols: Sequence[str], targets: Sequence, count: dict[int, int],
                   low_variance: float, drop_first: bool = True) -> dict:
    """``fit_one_hot`` for the rows of all parts but one, for every part in ``targets`` (None: no part
    left out), from one count of (part, level). Only levels whose share lies within the bounds in some
    target reach the driver: fewer than 1 / (1 - low_variance) a column and target."""
    n = F.col("n")
    own = [n if t is None else F.when(F.col("_part") != t, n) for t in targets]
    wide = LV.count_levels(rows, cols, by="_part").groupBy("name", "level").agg(*[
        F.coalesce(F.sum(o), F.lit(0)).alias(f"n{j}") for j, o in enumerate(own)])
    total = [sum(v for p, v in count.items() if p != t) for t in targets]
    share = lambda j: F.col(f"n{j}") / F.lit(float(max(total[j], 1)))
    kept = lambda x: (x < low_variance) & (1.0 - x < low_variance)
    any_kept = reduce(lambda a, b: a | b, [kept(share(j)) for j in range(len(targets))])
    out = {t: {c: [] for c in cols} for t in targets}
    with scratch(wide) as table:
        first = {r["name"]: r for r in table.groupBy("name").agg(*[F.min(F.when(
            F.col(f"n{j}") > 0, F.col("level"))).alias(f"f{j}") for j in range(len(targets))]).collect()}
        for r in table.where(any_kept).orderBy("name", "level").collect():
            for j, t in enumerate(targets):
                if kept(r[f"n{j}"] / max(total[j], 1)) and not (
                        drop_first and r["level"] == first[r["name"]][f"f{j}"]):
                    out[t][r["name"]].append(r["level"])
    return {t: {c: sorted(v) for c, v in by.items()} for t, by in out.items()}


def one_hot_name(col: str, level: str) -> str:
    return f"{col}_{level}"


def apply_one_hot(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """FE-3 transform: ``<col>_<level>`` = 1 when equal else 0 (static schema)."""
    return df.withColumns({one_hot_name(c, lv): F.coalesce((F.col(c) == lv).cast("int"),
                                                           F.lit(0))
                           for c, lvs in levels.items() for lv in lvs})


__all__ = ["exact_quantiles", "quantiles", "medians", "fit_impute", "apply_impute",
           "fit_log_columns", "apply_log", "fit_low_variance", "fit_scaler", "apply_scaler",
           "fit_vocabulary", "fit_one_hot", "apply_one_hot", "one_hot_name", "skew_g1",
           "indicator_name"]
