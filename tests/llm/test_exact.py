import hashlib
from collections import defaultdict

import pytest

from parcel.llm import exact
from tests.llm.util import frame, prose, rows

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("capacity,bits", [(2048, 64), (3, 64), (50, 3)])
def test_against_grouping(spark, capacity, bits):
    pairs = rows([(100 + k, prose(k % 40, 12)) for k in range(160)]
                 + [(400 + k, "Hot TEXT É" if k % 2 else "hot text É") for k in range(120)])
    groups = defaultdict(list)
    for d, t in pairs:
        groups[(t or "").translate(LOWER)].append(d)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = exact.exact_dedup(frame(spark, pairs), capacity, bits).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_directory_doubles_only_where_needed(spark):
    keys = spark.range(4000).selectExpr("xxhash64(id) as key")
    depths = exact.directory(keys, 20)
    assert len(depths) == 64 and 1 <= max(depths) <= 6
    from pyspark.sql import functions as F
    most = keys.groupBy(exact.bucket_of(F.col("key"), depths)).count().agg(F.max("count")).first()[0]
    assert most <= 20
    assert exact.directory(keys, 10_000) == [0] * 64


def test_chains_and_empty(spark):
    df = frame(spark, rows())
    _, index, _ = exact.build_index(df, 50, 1)
    assert index.agg({"chain": "max"}).first()[0] > 1
    assert index.where("chain > links").count() == 0
    assert exact.exact_dedup(df.where("false")).count() == 0


def test_one_owner_per_bucket_and_hot_copies_combined(spark):
    from pyspark.sql import functions as F
    pairs = [(k, "hot text" if k % 3 == 0 else prose(k % 900, 9)) for k in range(3000)]
    df = frame(spark, pairs).repartition(6)
    keyed, index, hot = exact.build_index(df, 4)
    assert hot.count() == 1 and index.count() == len({t for _, t in pairs})
    assert index.agg(F.max("n")).first()[0] == 1000
    placed = index.select("bucket", F.spark_partition_id().alias("task")).distinct()
    owners = placed.groupBy("bucket").agg(F.count("task").alias("tasks"))
    assert owners.where("tasks > 1").count() == 0 and owners.count() > 64
    got = exact.exact_dedup(df, 4)
    assert got.count() == 3000 and got.where("kept").count() == index.count()
    extra = df.selectExpr("*", "1 as key", "2 as bucket", "'x' as norm", "doc_id as head", "'y' as sha")
    assert sorted(exact.exact_dedup(extra, 4).collect()) == sorted(got.collect())
