"""Mergeable statistics per fold (FE-10, ML-9): a fold's fitted state is what the other folds add up to.

One grouped job summarises each fold's rows (``moments``, ``comoments``); the k small summaries
meet on the driver, where any set of folds is merged by the parallel-variance formulas. Rows are
neither copied to the folds they train nor scanned once per fold.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Count, mean, second and third central moment sums, extremes."""
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    m3: float = 0.0
    lo: float = math.inf
    hi: float = -math.inf

    def __add__(self, o: "Moments") -> "Moments":
        if not self.n or not o.n:
            return self if self.n else o
        n, d = self.n + o.n, o.mean - self.mean
        return Moments(
            n, self.mean + d * o.n / n, self.m2 + o.m2 + d * d * self.n * o.n / n,
            self.m3 + o.m3 + d ** 3 * self.n * o.n * (self.n - o.n) / n ** 2
            + 3 * d * (self.n * o.m2 - o.n * self.m2) / n, min(self.lo, o.lo), max(self.hi, o.hi))

    @staticmethod
    def repeated(value: float | None, n: int) -> "Moments":
        """n times the same value (imputed rows)."""
        return Moments() if value is None or not n else Moments(n, value, 0.0, 0.0, value, value)

    @property
    def std(self) -> float | None:
        return math.sqrt(self.m2 / self.n) if self.n else None

    @property
    def skew(self) -> float | None:
        """Bias-corrected sample skewness; None below three values or without variance."""
        if self.n < 3 or self.m2 <= 0:
            return None
        g = (self.m3 / self.n) / (self.m2 / self.n) ** 1.5
        return g * math.sqrt(self.n * (self.n - 1)) / (self.n - 2)


@dataclass
class CoMoments:
    """Count, means and central second moment sums of a pair."""
    n: int = 0
    mx: float = 0.0
    my: float = 0.0
    xx: float = 0.0
    yy: float = 0.0
    xy: float = 0.0

    def __add__(self, o: "CoMoments") -> "CoMoments":
        if not self.n or not o.n:
            return self if self.n else o
        n, dx, dy = self.n + o.n, o.mx - self.mx, o.my - self.my
        w = self.n * o.n / n
        return CoMoments(n, self.mx + dx * o.n / n, self.my + dy * o.n / n, self.xx + o.xx + dx * dx * w,
                         self.yy + o.yy + dy * dy * w, self.xy + o.xy + dx * dy * w)

    @property
    def slope(self) -> float | None:
        return self.xy / self.xx if self.xx else None

    @property
    def corr(self) -> float | None:
        return self.xy / math.sqrt(self.xx * self.yy) if self.xx and self.yy else None


def others(parts: dict, fold: int | None, zero):
    """Sum of the summaries of all folds but ``fold`` (None: of all)."""
    return reduce(lambda a, b: a + b, (m for p, m in sorted(parts.items()) if p != fold), zero)


def moments(df: DataFrame, cols: Sequence[str], part: str) -> tuple[dict[str, dict[int, Moments]], dict[int, int]]:
    """Per column and fold the moments of its values (NULL and NaN ignored); rows per fold."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.var_pop(v).alias(f"v{i}"),
                 F.skewness(v).alias(f"s{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    out: dict[str, dict[int, Moments]] = {c: {} for c in cols}
    rows = {}
    for r in df.groupBy(part).agg(*aggs).collect():
        rows[r[part]] = r["rows"]
        for i, c in enumerate(cols):
            if n := r[f"n{i}"]:
                var, skew = r[f"v{i}"], r[f"s{i}"]
                m3 = 0.0 if skew is None or math.isnan(skew) else skew * n * var ** 1.5
                out[c][r[part]] = Moments(n, r[f"a{i}"], var * n, m3, r[f"l{i}"], r[f"h{i}"])
    return out, rows


def comoments(df: DataFrame, xs: Sequence[str], y: str, part: str) -> dict[str, dict[int, CoMoments]]:
    """Per x column and fold the co-moments with ``y`` over rows that have both."""
    aggs = []
    for i, c in enumerate(xs):
        both = F.col(c).isNotNull() & F.col(y).isNotNull()
        a, b = (F.when(both, F.col(v).cast("double")) for v in (c, y))
        aggs += [F.count(a).alias(f"n{i}"), F.avg(a).alias(f"x{i}"), F.avg(b).alias(f"y{i}"),
                 F.var_pop(a).alias(f"xx{i}"), F.var_pop(b).alias(f"yy{i}"), F.covar_pop(a, b).alias(f"xy{i}")]
    out: dict[str, dict[int, CoMoments]] = {c: {} for c in xs}
    for r in df.groupBy(part).agg(*aggs).collect():
        for i, c in enumerate(xs):
            if n := r[f"n{i}"]:
                out[c][r[part]] = CoMoments(n, r[f"x{i}"], r[f"y{i}"], r[f"xx{i}"] * n, r[f"yy{i}"] * n,
                                            r[f"xy{i}"] * n)
    return out


def fold_profile(df: DataFrame, cols: Sequence[str], part: str, k: int) -> Iterable[tuple]:
    """(fold, column, n, mean, std, min, max, median) of every fold's training rows: two kinds of
    jobs for all folds and columns together, and k * len(cols) rows on the driver."""
    from parcel.operators import quantiles as Q
    stats, _ = moments(df, cols, part)
    middle = Q.exact(df, cols, [0.5], part, k)
    for f in range(k):
        for c in cols:
            m = others(stats[c], f, Moments())
            yield (f, c, m.n, *((m.mean, m.std, m.lo, m.hi) if m.n else (None,) * 4), middle[f][c][0])
