"""Every corpus query equals its SQL on the smallest tables; the others keep their contract."""

import math
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from parcel.llm import queries as Q
from parcel.sources.tables import TABLES
from tests.conftest import SF_SMALL


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v if isinstance(v, (str, bool)) else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got, want = Q.QUERIES[name](spark, SF_SMALL), con.sql(Q.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = Counter(tuple(norm(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    assert a == Counter(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_all_are_registered():
    names = E.queries()
    assert set(Q.QUERIES) <= set(names) and "pipeline" in names
    assert sorted({int(n[2:].split("_")[0]) for n in Q.QUERIES}) == list(range(1, 14))


def test_queries_without_sql_answer_every_document(spark):
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    one = Q.QUERIES["op1_bpe_roundtrip"](spark, SF_SMALL)
    assert one.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and one.count() == n
    four = Q.QUERIES["op4_subsequence_svm"](spark, SF_SMALL).collect()
    assert len(four) == n and all(r.predicted == int(r.score >= 0.5) for r in four)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in four)
    ten = Q.QUERIES["op10_pitman_yor"](spark, SF_SMALL).collect()
    assert len(ten) == n and sum(r.score for r in ten) > sum(r.base_score for r in ten)
    seven = Q.QUERIES["op7_slack_packing"](spark, SF_SMALL)
    assert seven.select("doc_id").distinct().count() == n
