"""Fitted statistics: exact quantiles (all paths), imputation, log selection, scalers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcel.operators import fit as FIT
from parcel.operators import levels as LV


def _np_quantile(xs, p):
    return float(np.quantile(np.asarray(xs, dtype=float), p, method="linear"))


@pytest.mark.parametrize("case", ["uniform", "dupes", "hot_value", "tiny"])
def test_exact_quantiles_small_path(spark, case):
    rnd = random.Random(7)
    if case == "uniform":
        xs = [rnd.uniform(-5, 5) for _ in range(3000)]
    elif case == "dupes":
        xs = [float(rnd.randint(0, 20)) for _ in range(3000)]
    elif case == "hot_value":   # one value holds a third of all rows
        xs = [42.0] * 1000 + [rnd.uniform(0, 100) for _ in range(2000)]
    else:
        xs = [3.0]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.98, 1.0]
    got = FIT.exact_quantiles(df, "v", probs)
    for p, g in zip(probs, got):
        assert math.isclose(g, _np_quantile(xs, p), rel_tol=1e-12, abs_tol=1e-12)


def test_exact_quantiles_refinement_path(spark):
    """Force the bracket-refinement path (tiny collect limit) and compare with numpy."""
    rnd = random.Random(11)
    xs = [rnd.gauss(0, 1) for _ in range(20000)] + [1.5] * 7000
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    probs = [0.001, 0.33, 0.5, 0.9, 0.999]
    for options in ({"collect_limit": 500}, {"collect_limit": 500, "sketch_k": 8},
                    {"collect_limit": 1, "max_levels": 1}, {"collect_limit": 3, "max_levels": 0}):
        got = FIT.exact_quantiles(df, "v", probs, **options)
        for p, g in zip(probs, got):
            assert math.isclose(g, _np_quantile(xs, p), rel_tol=1e-12, abs_tol=1e-12), options


def test_exact_quantiles_of_training_folds(spark):
    """Every fold's training rows, several columns, with folds of unlike size and values; by
    collected pairs, by sketches and by ranges of sorted values."""
    from parcel.operators import quantiles as Q
    rnd = random.Random(5)
    rows = [(k % 7 % 4, rnd.gauss(k % 4, 1), None if k % 3 else float(k), float(k % 2) if k % 4 else math.nan,
             None if k % 7 % 4 != 2 else 1.0) for k in range(4000)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, d double")
    probs = [0.25, 0.5]
    for options in ({}, {"collect_limit": 200}, {"collect_limit": 1, "max_levels": 1}):
        got = Q.exact(df, ["a", "b", "c", "d"], probs, "fold", 4, **options)
        assert sorted(got) == [0, 1, 2, 3]
        for f in range(4):
            for i, c in enumerate("abcd", 1):
                xs = [r[i] for r in rows if r[0] != f and r[i] is not None and not math.isnan(r[i])]
                want = [_np_quantile(xs, p) for p in probs] if xs else [None, None]
                assert got[f][c] == pytest.approx(want, abs=1e-12) if xs else got[f][c] == want, (f, c, options)


def test_exact_quantiles_empty(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert FIT.exact_quantiles(df, "v", [0.5]) == [None]


def test_impute_strategies(spark):
    df = spark.createDataFrame([(1.0, 10.0, None), (3.0, None, 2.0), (None, 30.0, None),
                                (10.0, 20.0, 4.0)], "a double, b double, c double")
    vals = FIT.fit_impute(df, {"a": "median", "b": "mean", "c": "constant:7"})
    assert vals == {"a": 3.0, "b": 20.0, "c": 7.0}
    out = FIT.apply_impute(df, vals).collect()
    assert [r["a"] for r in out] == [1.0, 3.0, 3.0, 10.0]
    with pytest.raises(ValueError):
        FIT.fit_impute(df, {"a": "mode"})


def test_log_selection_matches_pandas_skew(spark):
    import pandas as pd
    rnd = random.Random(3)
    pos = [math.exp(rnd.gauss(0, 1)) for _ in range(500)]
    sym = [rnd.uniform(1, 2) for _ in range(500)]
    neg = [x - 1.5 for x in sym]
    df = spark.createDataFrame(list(zip(pos, sym, neg)), "pos double, sym double, neg double")
    chosen = FIT.fit_log_columns(df, ["pos", "sym", "neg"], 0.5)
    expected = [f"log_{c}" for c, xs in (("pos", pos), ("sym", sym), ("neg", neg))
                if min(xs) > 0 and abs(pd.Series(xs).skew()) > 0.5]
    assert chosen == expected == ["log_pos"]


def test_scalers_and_zero_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "x double, k double")
    st = FIT.fit_scaler(df, ["x", "k"], "standard")
    assert st["k"] == (5.0, 1.0)
    assert math.isclose(st["x"][1], float(np.std([1, 2, 3, 10])))
    rb = FIT.fit_scaler(df, ["x"], "robust")["x"]
    assert rb == (_np_quantile([1, 2, 3, 10], 0.5),
                  _np_quantile([1, 2, 3, 10], 0.75) - _np_quantile([1, 2, 3, 10], 0.25))
    mm = FIT.fit_scaler(df, ["x"], "minmax")["x"]
    assert mm == (1.0, 9.0)


def test_low_variance_and_one_hot(spark):
    rows = [("a", 1)] * 96 + [("b", 0)] * 4
    df = spark.createDataFrame(rows, "cat string, flag int")
    assert FIT.fit_low_variance(df, ["flag"], 0.95) == ["flag"]
    assert FIT.fit_one_hot(df, ["cat"]) == {"cat": []}      # b is in 4 % of the rows
    levels = FIT.fit_one_hot(df, ["cat"], low_variance=0.97)
    assert levels == {"cat": ["b"]}
    out = FIT.apply_one_hot(df, levels)
    assert out.agg({"cat_b": "sum"}).first()[0] == 4


def test_vocabulary_order(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a"],), (["c", "b"],)], "l array<string>")
    table = FIT.fit_vocabulary(df, "l")
    assert sorted((r["level"], r["n"], r["code"]) for r in table.collect()) == [("a", 2, 0), ("b", 2, 1), ("c", 1, 2)]
    assert LV.most_frequent(table, 2) == ["a", "b"] and LV.most_frequent(table, 9) == ["a", "b", "c"]


def test_wide_scaler_in_jobs_of_few_columns(spark, monkeypatch):
    cols = [f"c{i}" for i in range(45)]
    df = spark.range(50).select(*[((F.col("id") * (i + 3)) % (i + 7)).cast("double").alias(c)
                                  for i, c in enumerate(cols)])
    rows = np.array([tuple(r) for r in df.collect()])
    kind, sizes = type(df), []
    agg = kind.agg
    monkeypatch.setattr(kind, "agg", lambda self, *e: (sizes.append(len(e)), agg(self, *e))[1])
    state = FIT.fit_scaler(df, cols, "standard")
    assert max(sizes) <= 2 * FIT.SCALER_COLUMNS
    assert list(state) == cols
    assert [state[c][0] for c in cols] == pytest.approx(rows.mean(axis=0))
    assert [state[c][1] for c in cols] == pytest.approx(rows.std(axis=0))
