from collections import defaultdict

import numpy as np

from parcel.llm import minhash
from parcel.llm.graph import components
from tests.llm.util import frame, prose, rows


def brute(pairs):
    """Smallest doc_id reachable, per row of distinct (doc_id, text)."""
    sets = {}
    for d, t in set(pairs):
        w = (t or "").encode().lower().split()
        sets[(d, t)] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else (
            frozenset([tuple(w)]) if w else frozenset())
    keys = list(sets)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = defaultdict(list)
    for k in keys:
        low[root(k)].append(-1 << 63 if k[0] is None else k[0])
    return {k: (len(sets[k]), min(low[root(k)])) for k in keys}


def edited(seed, text, share):
    r = np.random.default_rng(seed)
    words = text.split()
    for k in np.flatnonzero(r.random(len(words)) < share):
        words[k] = f"w{seed}x{k}"
    return " ".join(words)


def check(spark, pairs):
    got = minhash.near_duplicates(frame(spark, pairs)).collect()
    truth = brute(pairs)
    want = sorted((-1 << 63 if d is None else d, *truth[(d, t)]) for d, t in pairs)
    have = sorted((-1 << 63 if r.doc_id is None else r.doc_id, r.n_shingles,
                   -1 << 63 if r.component_id is None else r.component_id) for r in got)
    assert have == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_awkward_rows(spark):
    check(spark, rows([(20, "a b c d"), (21, "A b  c\nd"), (22, "a b c d e"), (23, "d c b a")]))


def test_near_copies_at_many_distances(spark):
    pairs = [(k, prose(k, 120)) for k in range(6)]
    pairs += [(100 + 10 * k + j, edited(100 * k + j, prose(k, 120), 0.01 * (1 + j)))
              for k in range(6) for j in range(8)]
    check(spark, pairs)


def test_large_region_is_cut_and_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(minhash, "REGION", 4)
    base = prose(3, 150)
    check(spark, [(1000 - k, edited(k, base, 0.015 + 0.0005 * k)) for k in range(60)])


def test_keep_first_and_empty(spark):
    pairs = rows()
    df = frame(spark, pairs)
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and ids.count(0) == 1
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (500, 501)],
                                  "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[501] == 500


def test_order_matters_for_classes():
    a, b = minhash.sequence_ids(["x y z", "z y x"])
    assert a != b
