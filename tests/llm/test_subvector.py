import hashlib
import math
import random

import numpy as np
import pytest

from parcel.llm import subvector

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, v int"


def vectors(n, dims, seed=1):
    """Clustered vectors, repeated ids and rows, ties, and rows that take no part."""
    r = random.Random(seed)
    out = [(k, [r.choice([-0.5, 0.1, 0.4]) + r.uniform(-0.05, 0.05) for _ in range(dims)]) for k in range(n)]
    out += [(7, [0.25] * dims)] * (n // 3) + [(None, [0.3] * dims), (None, [-0.3] * dims)]
    bad = [(900, None), (901, [0.1, None] + [0.0] * (dims - 2)), (902, [math.nan] * dims),
           (903, [math.inf] * dims), (904, [0.1] * (dims - 1)), (905, [])]
    return [(i, v, 1, "x", 2) for i, v in out + bad]


def brute(rows, k, rounds, scale, dims):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda p: (p[0] is None, hashlib.sha256(f"3:{p[0]}".encode()).hexdigest()
                                        if p[0] is not None else "", p[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            members = [v for (_, v), c in zip(kept, own) if c == j]
            if members:
                centres[j] = [sum(x) // len(members) for x in zip(*members)]
    last = [(i, *nearest(v)) for i, v in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, sum(x for _, x, c in last if c == j), sum(x for _, x, _ in last), digest[j])
                   for i, d, j in last), key=repr)


@pytest.mark.parametrize("limit", [8192, 40, 3])
def test_equals_brute_force(spark, monkeypatch, limit):
    """Wide shared dictionaries, narrow ones, and dictionaries of the pages' own."""
    monkeypatch.setattr(subvector, "PAGE", 50)
    rows = vectors(200, 10)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = subvector.clusters_with_inertia(df, 5, 4, 100, 10, limit=limit)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 5, 4, 100, 10)


def test_dictionaries_are_lossless_and_bounded(spark):
    df = spark.createDataFrame(vectors(300, 10), SCHEMA)
    vecs = subvector.integer_vectors(df, 20, 10)
    blocks = subvector.dictionaries(vecs, 10, 60)
    assert [(b.first, b.last) for b in blocks][0][0] == 0 and blocks[-1].last == 10
    assert all(a.last == b.first for a, b in zip(blocks, blocks[1:]))
    assert all(b.entries is None or len(b.entries) <= 60 for b in blocks)
    rows = sorted(r["v"] for r in vecs.collect())
    back = []
    layout = [(b.first, b.last, b.entries) for b in blocks]
    pages = subvector.encode(vecs, blocks, 10).toArrow().to_batches()
    for batch in pages:
        for _, page in subvector.decode(batch, layout):
            back += np.hstack([(e if own is None else own)[codes] for (codes, own), (_, _, e)
                               in zip(page, layout)]).tolist()
    assert sorted(back) == rows


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], 0, "", 0), (2, [0.25, 0.0], 0, "", 0)], SCHEMA)
    got = subvector.clusters_with_inertia(df, 8, 10, 4, 2).collect()
    assert sorted((r.vec_id, r.distance) for r in got) == [(1, 0), (2, 0)]
    empty = subvector.clusters_with_inertia(df.where("false"), 8, 10, 4, 2)
    assert empty.count() == 0 and empty.columns == got[0].__fields__


def test_a_component_too_large_stops(spark):
    df = spark.createDataFrame([(1, [1e9, 0.5], 0, "", 0)], SCHEMA)
    with pytest.raises(Exception, match="2\\*\\*27"):
        subvector.cluster(df, 2, 1, 1024, 2)
