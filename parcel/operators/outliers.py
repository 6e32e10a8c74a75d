"""Isolation-forest outlier flagging (OD-2).

* Sampling: every tree takes each row with probability ``p = oversample * psi / n``, decided by
  hashes of the key (stable under repartitioning), then keeps the ``psi`` smallest draws inside
  its group: every tree group is bounded by ~``oversample * psi`` rows whatever the table size or
  key skew. One hash says how many trees a row skips before its first one; most rows skip them
  all, and only the others are asked about the trees that follow.
* Building: ``groupBy(tree_id).applyInPandas`` grows one tree per group with
  numpy (seeded by the tree id) -- the only Python in the operator.
* Scoring: the forest is a fixed-size array set (``n_trees x (2*psi - 1)``
  nodes, independent of the data size), shipped to a vectorized pandas UDF
  that walks every tree for a whole Arrow batch at once.
* Threshold: ``percentile(score, 1 - contamination)`` via the exact,
  bounded-memory quantile of ``fit.exact_quantiles``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcel.operators.fit import exact_quantiles

TREE_SCHEMA = ("tree_id int, feature array<int>, threshold array<double>, "
               "left array<int>, right array<int>, size array<int>")


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx: np.ndarray, depth: int) -> int:
        me = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1)
        size.append(int(len(idx)))
        if depth >= limit or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < t
        feat[me], thr[me] = f, t
        left[me] = node(idx[mask], depth + 1)
        right[me] = node(idx[~mask], depth + 1)
        return me

    node(np.arange(len(x)), 0)
    return feat, thr, left, right, size


def _build_group(features: Sequence[str], psi: int):
    limit = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        pdf = pdf.sort_values("u").head(psi)
        x = pdf[list(features)].to_numpy(dtype=float)
        rng = np.random.default_rng(tree_id)
        f, t, l, r, s = _grow(x, rng, limit)
        return pd.DataFrame({"tree_id": [tree_id], "feature": [f], "threshold": [t],
                             "left": [l], "right": [r], "size": [s]})
    return build


def fit_isolation_forest(df: DataFrame, features: Sequence[str], key: str,
                         n_trees: int = 100, psi: int = 256, oversample: float = 2.0,
                         seed: int = 42) -> list[dict]:
    """OD-2 fit: returns the forest (list of node arrays per tree; bounded size)."""
    n = df.count()
    psi = int(min(psi, max(n, 1)))
    p = min(1.0, oversample * psi / max(n, 1))
    feats = [F.col(c).cast("double").alias(c) for c in features]
    # Per-(row, tree) uniform draw from the native 64-bit hash of (key, tree, seed):
    # deterministic, partition-independent and cheap enough to evaluate n_trees times.
    def unit(k: Column, t: Column, s: int) -> Column:
        return F.pmod(F.xxhash64(k, t, F.lit(s)), F.lit(1 << 32)).cast("double") / float(1 << 32)
    rest = lambda first: F.filter(F.sequence(first + 1, F.lit(n_trees)), lambda t: (
        t < n_trees) & (unit(F.col(key), t, seed) < F.lit(p)))
    skip = F.lit(0) if p >= 1 else F.floor(F.log(1.0 - unit(F.col(key), F.lit(-1), seed)) / math.log1p(-p))
    rows = df.select(F.col(key), *feats).na.drop(subset=list(features)).withColumn("first", skip)
    sampled = (rows.where(F.col("first") < n_trees).withColumn("first", F.col("first").cast("int"))
               .withColumn("tree_id", F.explode(F.concat(F.array("first"), rest(F.col("first")))))
               .drop("first")
               .withColumn("u", unit(F.col(key), F.col("tree_id"), seed + 1)))
    forest = (sampled.groupBy("tree_id")
              .applyInPandas(_build_group(features, psi), TREE_SCHEMA).collect())
    return [{"tree_id": r["tree_id"], "feature": r["feature"], "threshold": r["threshold"],
             "left": r["left"], "right": r["right"], "size": r["size"], "psi": psi}
            for r in sorted(forest, key=lambda r: r["tree_id"])]


def _compile(tree: dict) -> dict:
    """Node arrays as numpy, with the leaf adjustment c(size) precomputed per node."""
    return {"feature": np.asarray(tree["feature"]), "threshold": np.asarray(tree["threshold"]),
            "left": np.asarray(tree["left"]), "right": np.asarray(tree["right"]),
            "adjust": np.array([_c(s) for s in tree["size"]], dtype=float)}


def _path_lengths(x: np.ndarray, tree: dict) -> np.ndarray:
    feat, thr = tree["feature"], tree["threshold"]
    left, right = tree["left"], tree["right"]
    node = np.zeros(len(x), dtype=int)
    depth = np.zeros(len(x))
    active = feat[node] >= 0
    while active.any():
        idx = np.flatnonzero(active)
        f = feat[node[idx]]
        go_left = x[idx, f] < thr[node[idx]]
        node[idx] = np.where(go_left, left[node[idx]], right[node[idx]])
        depth[idx] += 1
        active = feat[node] >= 0
    return depth + tree["adjust"][node]


def score_column(forest: list[dict], features: Sequence[str]):
    """Anomaly score 2^(-E[h(x)] / c(psi)) as a vectorized pandas UDF column."""
    psi = forest[0]["psi"] if forest else 2
    norm = _c(psi)
    forest = [_compile(t) for t in forest]

    @F.pandas_udf(T.DoubleType())
    def iso_score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        h = np.mean([_path_lengths(x, t) for t in forest], axis=0) if forest else np.zeros(len(x))
        return pd.Series(np.power(2.0, -h / norm) if norm > 0 else np.full(len(x), 0.5))

    return iso_score(*[F.col(c).cast("double") for c in features])


def flag_outliers(df: DataFrame, features: Sequence[str], key: str,
                  contamination: float = 0.02, n_trees: int = 100, psi: int = 256,
                  seed: int = 42) -> tuple[DataFrame, float]:
    """OD-2: score every row, flag the top ``contamination`` share (score >= threshold).

    Rows with a missing feature get no score and are never flagged.
    """
    forest = fit_isolation_forest(df, features, key, n_trees, psi, seed=seed)
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in features])
    scored = df.withColumn("anomaly_score", F.when(~any_null, score_column(forest, features)))
    from parcel.operators.models import materialize
    scored = materialize(scored)
    threshold = exact_quantiles(scored, "anomaly_score", [1.0 - contamination])[0]
    return scored.withColumn("is_outlier", F.col("anomaly_score") >= F.lit(threshold)), threshold


def split_outliers(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by the flag."""
    return (flagged.where(~F.coalesce(F.col("is_outlier"), F.lit(False))),
            flagged.where(F.coalesce(F.col("is_outlier"), F.lit(False))))
