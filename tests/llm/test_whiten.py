import math
import random

import numpy as np

from parcel.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, x int, component string"
OFFSET = 1_000_000


def vectors(n, dims, seed=1):
    """Correlated dimensions of very different variance, repeats, and rows that are dropped."""
    r = np.random.default_rng(seed)
    mixed = r.normal(size=(n, dims)) @ np.diag(0.7 ** np.arange(dims)) @ r.normal(size=(dims, dims))
    out = [(k, [float(x) for x in row]) for k, row in enumerate(mixed)]
    out += [(3, out[3][1])] * (n // 3) + [(None, out[5][1]), (900, [0.5] * (dims - 2))]
    bad = [(901, None), (902, [0.5, None]), (903, [math.nan] * dims), (904, [-math.inf] * dims)]
    random.Random(0).shuffle(out)
    return [(i, v, 1, "c") for i, v in out + bad]


def reference(rows, dims):
    """Integers, and whitening by an eigendecomposition of the covariance."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + OFFSET for c in v] + [OFFSET] * (dims - len(v)))
            for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(axis=0)
    a = (n * fit - s) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    return kept, n, s, values[::-1], vectors[:, ::-1]


def test_equals_direct_whitening(spark):
    rows, dims = vectors(300, 12), 12
    kept, n, s, values, vectors_ = reference(rows, dims)
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4), 8).collect()
    assert len(got) == 8 * len(kept)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert len({r.identity_error for r in got}) == 1
    for c in range(1, 9):
        own = [r for r in got if r.component == c]
        assert abs(own[0].explained - values[c - 1] / values.sum()) < 1e-9
        want = sorted((sum((n * x - t) ** 2 for x, t in zip(v, s.tolist())),
                       abs((np.array(v) - s / n) @ vectors_[:, c - 1]) / math.sqrt(values[c - 1]),
                       -1 if i is None else i) for i, v in kept)
        have = sorted((r.deviation, abs(r.whitened), -1 if r.vec_id is None else r.vec_id) for r in own)
        assert [(d, i) for d, _, i in want] == [(d, i) for d, _, i in have]
        assert np.allclose([w for _, w, _ in want], [w for _, w, _ in have], atol=1e-7)


def test_whitened_fit_list_is_white_and_signs_agree(spark):
    rows = vectors(200, 6)
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA), 6).collect()
    table = {}
    for r in got:
        table.setdefault(r.deviation, {})[r.component] = r.whitened
    white = np.array([[v[c] for c in range(1, 7)] for v in table.values()])
    cov = np.cov(white.T, bias=True)
    assert np.abs(cov - np.eye(6)).max() < 1e-9


def test_dimensions_without_variance(spark):
    """Constant and copied dimensions: as many components as the rank."""
    r = random.Random(2)
    rows = []
    for k in range(100):
        a, b = r.uniform(-2, 2), r.uniform(-2, 2)
        rows.append((k, [a, a, 0.5, b, 0.25], 1, ""))
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA), 16).collect()
    assert {r.component for r in got} == {1, 2}
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-9
    assert got[0].identity_error < 1e-6


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], 0, ""), (1, [0.5, 0.5], 0, "")], SCHEMA)
    for frame in (df, df.where("false"), spark.createDataFrame([(1, [], 0, "")], SCHEMA)):
        got = whiten.whiten(frame)
        assert got.count() == 0 and got.columns == [c.split()[0] for c in whiten.OUT.split(", ")]


def test_large_numbers_stay_exact(spark):
    """Deviations beyond a long are null, those within are exact."""
    rows = [(k, [float(2 ** 40 * k), 1.0], 0, "") for k in range(3)]
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA), 1).collect()
    assert {r.vec_id: r.deviation for r in got} == {0: None, 1: 0, 2: None}


def test_triangular_solve():
    r = np.random.default_rng(0)
    upper = np.triu(r.normal(size=(7, 7))) + 5 * np.eye(7)
    rows = r.normal(size=(20, 7))
    assert np.allclose(whiten.solved(rows, upper) @ upper, rows)
