"""A row keeps its number when a later scan of the table is planned in other partitions."""

import pytest

from parcel.llm.hpylm import language_scores
from parcel.llm.license import scan
from parcel.llm.linedup import dedup_lines
from tests.llm.util import frame, prose

LEAST = "spark.sql.files.minPartitionNum"
OPEN = "spark.sql.files.openCostInBytes"
PASSAGE = "\n".join(prose(800 + k, 9) for k in range(8))


@pytest.mark.parametrize("answer", [
    lambda df: dedup_lines(df).select("doc_id", "text", "lines_deleted"),
    lambda df: scan(df),
    lambda df: language_scores(df, sweeps=1, burn=0).select("doc_id", "n_tokens", "base_score"),
], ids=["line_dedup", "license", "language_scores"])
def test_scans_in_other_partitions(spark, tmp_path, answer):
    pairs = [(k, f"{prose(k, 5 + k % 9)}\n{PASSAGE if k % 3 else 'own words'}\n"
                 f"{'Licensed under CC BY-NC 4.0' if k % 4 == 1 else prose(k + 90, 6)}") for k in range(64)]
    frame(spark, pairs).repartition(8).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = lambda df: sorted((repr(tuple(r)) for r in df.collect()))
    before = {k: spark.conf.get(k, None) for k in (LEAST, OPEN)}
    try:
        spark.conf.set(LEAST, "1")
        spark.conf.set(OPEN, "1")           # few partitions of many files
        want = rows(answer(docs))
        got = answer(docs)
        spark.conf.set(LEAST, "64")         # the executors have changed before the last scan
        spark.conf.set(OPEN, str(1 << 22))
        assert rows(got) == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
