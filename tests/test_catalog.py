"""Every catalogued query with an oracle equals DuckDB on the small fixture (sf0.001);
every other query runs and returns a stable schema."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from parcel.plans import catalog, q_ml
from parcel.sources.tables import TABLES
from tests.conftest import SF_SMALL

ORACLE = catalog.oracle_sql()
QUERIES = catalog.queries()
#: Queries without SQL that take long at their full size: the same code with a smaller budget.
SMALLER = {"fit_forest": {"trees": 4, "depth": 4}, "importance_folds": {"trees": 2, "depth": 3},
           "fit_boosted": {"max_rounds": 6, "patience": 2}, "elbow_curve": {"most": 3}}


def _norm(v):
    if v is None:
        return "NULL"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(0.0 if round(v, 6) == 0 else round(v, 6))
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = df.collect()
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    si = [df.columns.index(c) for c in order]
    oi = [rel.columns.index(c) for c in order]
    orows = rel.fetchall()
    assert Counter(tuple(_norm(r[i]) for i in si) for r in rows) == \
        Counter(tuple(_norm(r[i]) for i in oi) for r in orows)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE))
def test_rows_only_queries_run(spark, name):
    run = getattr(q_ml, name) if name in SMALLER else QUERIES[name]
    df = run(spark, SF_SMALL, **SMALLER.get(name, {}))
    assert df.count() > 0 and len(df.columns) > 0


def test_every_query_has_oracle_or_is_ml():
    missing = set(QUERIES) - set(ORACLE)
    allowed = {*SMALLER, "cv_random_search", "retrain_best", "score_stream", "feature_matrix", "fit_linear",
               "score_batch", "kmeans_areas", "isolation_outliers", "page_listing_extract"}
    assert missing <= allowed, missing - allowed


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "postal_district" in df.columns
