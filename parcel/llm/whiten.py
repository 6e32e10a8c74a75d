"""Embedding whitening by shifted CholeskyQR.

The fit list (each distinct integer vector once) is centred exactly and factored A = Q R without
ever forming the covariance's eigenproblem: a distributed pass gives the Gram matrix of the rows
as they stand, its Cholesky factor (the first one of the shifted matrix, so that it always
exists) goes to all tasks, and the next pass sees the rows after a triangular solve with it. Passes
repeat until the rows are orthonormal; the product of the factors is R. The singular values and
right vectors of R are those of A: components and variances of the whitening. What Spark moves
per pass is one triangle of dims * dims numbers from every task, added up before it reaches the
driver; rows stay where they are, and are read from a checkpoint in every pass.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped. A
shorter vector counts as ending in zeros (``dims`` is the longest length). Components with no
variance (beyond rounding: a singular value below 1e-10 of the largest) are not returned, so a
table of equal vectors, one vector, or none gives no rows. Repeated rows each get their rows.
``deviation`` is null where it does not fit a long. Extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcel.llm.common import cut

PASSES = 12            # at most; two or three are the rule
ORTHONORMAL = 1e-12    # largest entry of G G - G once the rows are orthonormal
NO_VARIANCE = 1e-10    # of the largest singular value
EPS = float(np.finfo(np.float64).eps)
LONG = (1 << 63) - 1


@dataclass
class Whitening:
    n: int                      # vectors of the fit list
    sums: list[int]             # per dimension
    largest: int                # largest entry in size
    components: np.ndarray      # (count, dims), unit rows
    variances: np.ndarray       # (count,), falling
    trace: float
    identity_error: float = 0.0


def integer_rows(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that remain, x padded to the longest length; that length."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(
        c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding").where(ok)
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(offset))
    pad = F.array_repeat(F.lit(offset).cast("long"), F.lit(dims) - F.size("embedding"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.concat(x, pad).alias("x")), dims


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def times_n(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - S without rounding: longs, or Python integers where longs could overflow."""
    if 2 * n * max(largest, 1) < LONG:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """x minus the mean, rounded once."""
    return (times_n(x, n, sums, largest) / n).astype(np.float64)


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows @ inverse(upper) by substitution, column after column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def totals(fit_list: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """n, exact sums per dimension, the largest entry in size."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b, dims)
            # halves of a long: sums of a batch cannot overflow
            high, low = (m >> 32).sum(axis=0), (m & 0xFFFFFFFF).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (
                np.arange(dims, dtype=np.int32), np.full(dims, len(m)), high, low,
                np.maximum(m.max(axis=0), -m.min(axis=0)))], names=["i", "n", "high", "low", "top"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = fit_list.mapInArrow(part, "i int, n long, high long, low long, top long").groupBy(
        "i").agg(F.sum("n").alias("n"), wide("high"), wide("low"), F.max("top").alias("top")).collect()
    found.sort(key=lambda r: r["i"])
    return (found[0]["n"] if found else 0, [(int(r["high"]) << 32) + int(r["low"]) for r in found],
            max((r["top"] for r in found), default=0))


def gram(fit_list: DataFrame, dims: int, n: int, sums: list[int], largest: int,
         step, width: int) -> np.ndarray:
    """Distributed Gram matrix of ``step`` (centred rows -> rows of ``width`` numbers), by one
    pass; every task sends one triangle."""
    row, col = np.triu_indices(width)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((width, width))
        for b in batches:
            a = step(centred(matrix(b, dims), n, sums, largest))
            g += a.T @ a
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(
            np.int32)), pa.array(g[row, col])], names=["i", "j", "g"])

    out = np.zeros((width, width))
    for r in fit_list.mapInArrow(part, "i int, j int, g double").groupBy("i", "j").agg(
            F.sum("g").alias("g")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["g"]
    return out


def factor(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of g + shift; the shift grows until there is one."""
    top = max(float(np.linalg.eigvalsh(g)[-1]), np.finfo(np.float64).tiny)
    while True:
        try:
            return np.linalg.cholesky(g + shift * top * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, len(g) * EPS)


def fit(rows: DataFrame, dims: int, count: int = 16) -> tuple[Whitening | None, DataFrame]:
    """Whitening of the distinct vectors of ``rows`` (x), and the checkpointed fit list."""
    fit_list = cut(rows.select("x").distinct())
    n, sums, largest = totals(fit_list, dims) if dims else (0, [], 0)
    if not n:
        return None, fit_list
    factors: list[np.ndarray] = []

    def rows_now(a: np.ndarray) -> np.ndarray:
        for r in factors:
            a = solved(a, r)
        return a

    whole, trace = np.eye(dims), 0.0
    for k in range(PASSES):
        g = gram(fit_list, dims, n, sums, largest, rows_now, dims)
        if not k:
            trace = float(np.trace(g)) / n
            if not trace:
                return None, fit_list
        elif np.abs(g @ g - g).max() < ORTHONORMAL:
            break
        # the usual shift, within reason for very many rows
        shift = min(11 * (n * dims + dims * (dims + 1)) * EPS / 2, 1e-7) if not k else 0.0
        factors.append(factor(g, shift))
        whole = factors[-1] @ whole
    # g is the Gram matrix of the last rows: the identity up to rounding, or zero in directions
    # without variance
    values, vectors = np.linalg.eigh(g)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    _, singular, right = np.linalg.svd(root @ whole)
    keep = min(count, int((singular > NO_VARIANCE * singular[0]).sum()))
    model = Whitening(n, sums, largest, right[:keep], singular[:keep] ** 2 / n, trace)
    ones = lambda a: np.hstack([project(a, model), np.ones((len(a), 1))])
    second = gram(fit_list, dims, n, sums, largest, ones, keep + 1) / n
    mean = second[:keep, keep]
    model.identity_error = float(np.abs(second[:keep, :keep] - np.outer(mean, mean) - np.eye(keep)).max())
    return model, fit_list


def project(a: np.ndarray, model: Whitening) -> np.ndarray:
    return (a @ model.components.T) / np.sqrt(model.variances)


OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
       "identity_error double")


def whiten(vectors: DataFrame, count: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """One row per remaining vector and component (1 to ``count``), see the module's docstring."""
    rows, dims = integer_rows(vectors, scale, offset)
    model, _ = fit(rows, dims, count)
    if model is None:
        return rows.sparkSession.createDataFrame([], OUT)
    k = len(model.components)
    explained = model.variances / model.trace

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exact = times_n(matrix(b, dims), model.n, model.sums, model.largest)
            white = project((exact / model.n).astype(np.float64), model)
            if exact.dtype != object and dims * int(np.abs(exact).max(initial=0)) ** 2 > LONG:
                exact = exact.astype(object)
            deviation = (exact * exact).sum(axis=1)
            m = len(white)
            each = lambda v: pa.array(np.repeat(v, k))
            ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            fits = [int(d) if d <= LONG else None for d in deviation for _ in range(k)] \
                if deviation.dtype == object else np.repeat(deviation, k)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 each(np.full(m, model.n)), pa.array(fits, pa.int64()), pa.array(white.ravel()),
                 pa.array(np.tile(explained, m)), each(np.full(m, model.identity_error))],
                names=[c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(apply, OUT)
