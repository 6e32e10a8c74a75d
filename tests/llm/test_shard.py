import zlib
from collections import defaultdict

import pytest

from parcel.llm.shard import shard, write_shards
from tests.llm.util import frame, prose, rows


def check(got, pairs, shards):
    assert sorted((r.size, r.text_crc32) for r in got) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in pairs)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for k, part in by.items():
        assert 0 <= k < shards
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / shards) <= largest


@pytest.mark.parametrize("range_rows,splits", [(200_000, 128), (20, 4)])
def test_bytes_law(spark, range_rows, splits):
    hot = [(100 + k, "the same text again") for k in range(150)]      # a third of the rows
    pairs = rows([(300 + k, prose(k, 1 + k % 40)) for k in range(250)] + hot)
    got = shard(frame(spark, pairs), 16, range_rows, splits).collect()
    check(got, pairs, 16)


def test_empty_and_files(spark, tmp_path):
    df = frame(spark, rows())
    assert shard(df.where("false")).count() == 0
    write_shards(df.where("doc_id > 9"), str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
