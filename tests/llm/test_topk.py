import math
import random

import numpy as np

from parcel.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, score int"


def vectors(n, seed, dims=8):
    r = random.Random(seed)
    out = [(k, [r.uniform(-1, 1) for _ in range(dims)], 0, "u", 1) for k in range(n)]
    out += [(20, [0.5] * dims, 0, "u", 1), (20, [0.5] * dims, 0, "u", 1),     # repeated id
            (40, None, 0, "u", 1), (60, [0.1, None] + [0.0] * (dims - 2), 0, "u", 1),
            (80, [math.nan] * dims, 0, "u", 1), (100, [math.inf] * dims, 0, "u", 1),
            (120, [0.9] * 3, 0, "u", 1), (140, [], 0, "u", 1), (None, [0.4] * dims, 0, "u", 1)]
    out += [(1000 + k, [0.25] * dims, 0, "u", 1) for k in range(n // 2)]       # ties
    return out


def brute(rows, k, every):
    ok = [(i, v) for i, v, *_ in rows if v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(64 * float(np.float32(x))) for x in v] for _, v in ok]
    out = []
    for a, (qid, _) in enumerate(ok):
        if qid is None or qid % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(ints[a], ints[b])), -math.inf if i is None else i)
                       for b, (i, _) in enumerate(ok) if b != a)[:k]
        out += [(qid, n + 1, None if i == -math.inf else i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out, key=repr)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_VALUES", 600)      # several shards
    monkeypatch.setattr(topk, "GROUP_QUERIES", 5)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rows = vectors(300, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in topk.top_k(df, 7, 20).collect()), key=repr)
    assert got == brute(rows, 7, 20)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0], 0, "u", 1), (1, [1.0, 0.0], 0, "u", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 4096)]
    assert topk.top_k(df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id = 0")).count() == 0


def test_blocks_are_pruned():
    r = np.random.default_rng(0)
    docs = np.sort(r.integers(-50, 50, (4000, 1)), axis=0) + r.integers(0, 2, (4000, 4))
    uid = np.arange(4000)
    best = topk.search(docs[:2], uid[:2], np.full(2, topk.NO_SCORE), docs, uid, uid, 5)
    want = np.sort(docs[:1] @ docs[1:].T)[0, ::-1][:5]
    assert best.score[0].tolist() == want.tolist()
