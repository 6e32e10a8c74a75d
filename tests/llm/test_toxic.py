import itertools

import numpy as np
import pytest

from parcel.llm import toxic
from tests.llm.util import frame, prose, rows

INSULTS = ["idiot", "moron", "pathetic", "worthless"]


def brute_kernel(s, t, order, decay):
    total = 0.0
    for a in itertools.combinations(range(len(s)), order):
        for b in itertools.combinations(range(len(t)), order):
            if all(s[x] == t[y] for x, y in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_equals_enumeration():
    pairs = [("idiot", "i-d-iot"), ("moron", "mornon"), ("abc", "cba"), ("aaaa", "aaa"), ("ab", "ab")]
    s, _, _ = toxic.codes([p[0] for p in pairs], 8)
    t, _, _ = toxic.codes([p[1] for p in pairs], 8)
    want = [brute_kernel(a, b, toxic.ORDER, toxic.DECAY) for a, b in pairs]
    assert np.allclose(toxic.kernel(s, t), want, rtol=1e-4)


@pytest.fixture(scope="module")
def data(spark):
    pairs, labels = [], []
    for k in range(400):
        text = prose(k, 40).split()
        bad = k % 4 == 0
        if bad:
            for j in range(3):
                text.insert(5 + 7 * j, INSULTS[(k // 4 + j) % 4])
        pairs.append((k, " ".join(text)))
        labels.append((k, 1, int(bad)))
    docs = frame(spark, pairs + [(1000, "you i d i o t and w-o-r-t-h-l-e-s-s m.o.r.o.n you"),
                                 (1001, "such an id.iot, a mo*ron, path-etic people here"),
                                 (1002, prose(77, 60)), (1003, None), (1004, "")])
    return docs, spark.createDataFrame(labels + [(None, 0, 1), (3, 0, None)],
                                       "doc_id long, quality int, toxic int")


def test_held_out_and_gapped_insults(spark, data):
    docs, labels = data
    got = {r.doc_id: r for r in toxic.toxicity(docs, labels).collect()}
    out = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert out and sum(r.predicted == (r.doc_id % 4 == 0) for r in out) >= 0.97 * len(out)
    assert got[1000].predicted == 1 and got[1001].predicted == 1
    assert got[1002].predicted == 0 and got[1003].predicted == 0
    assert got[1003].score == got[1004].score
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = toxic.keep(docs, toxic.fit(docs, labels))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        k for k, r in got.items() if r.predicted == 0)


def test_labels_of_held_out_rows_do_not_matter(spark, data):
    docs, labels = data
    from pyspark.sql import functions as F
    other = labels.withColumn("toxic", F.when(toxic.held_out(F.col("doc_id")), 1 - F.col("toxic"))
                              .otherwise(F.col("toxic")).cast("int"))
    a, b = toxic.fit(docs, labels), toxic.fit(docs, other)
    assert a["words"] == b["words"] and np.allclose(a["w"], b["w"])


def test_no_labels_and_awkward_rows(spark, data):
    docs, labels = data
    odd = frame(spark, rows())
    assert toxic.toxicity(odd, labels.where("false")).where("score = 0").count() == len(rows())
    assert toxic.toxicity(odd.where("false"), labels).count() == 0
    one_class = toxic.toxicity(docs, labels.where("toxic = 0"))
    assert one_class.where("predicted = 1").count() == 0
