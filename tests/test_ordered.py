"""Orders that span the table: running minimum and numbering over several ranges."""

import pytest

from parcel.operators import ordered as O

CAST = {"long": "at", "timestamp_ntz": "cast(timestamp_seconds(at) as timestamp_ntz)", "string": "lpad(at, 6, '0')",
        "decimal": "cast(at as decimal(20,3))"}


@pytest.mark.parametrize("kind", sorted(CAST))
def test_running_min_equals_window(spark, kind):
    """Ties and null order values; null groups; orders of several types; several ranges."""
    rows = [(k, None if k % 50 == 7 else k // 3, ("a", "b", None)[k % 7 % 3], float((k * 7919) % 1009),
             f"extra{k}") for k in range(1500)]
    df = spark.createDataFrame(rows, "t long, at long, study string, v double, note string")
    best, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        best[r[2]] = min(best.get(r[2], r[3]), r[3])
        want[r[0]] = best[r[2]]
    typed = df.selectExpr("t", f"{CAST[kind]} as at", "study", "v", "note")
    assert O.in_slices(typed, ["at", "t"], 100).select("_slice").distinct().count() > 8
    for columns in (["t", "at", "study", "v"], ["t", "at", "study", "v", "note"]):
        out = O.running_min(typed.select(*columns), "v", ["at", "t"], "study", slice_rows=100)
        assert out.columns == [*columns, "best_value"]
        assert {r["t"]: r["best_value"] for r in out.collect()} == want
    assert O.running_min(typed.where("false"), "v", ["at"], "study").count() == 0


def test_running_min_skips_null_values(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 3.0), (3, "a", None), (4, "a", 2.0)],
                               "t long, study string, v double")
    got = {r["t"]: r["best_value"] for r in O.running_min(df, "v", ["t"], "study", slice_rows=1).collect()}
    assert got == {1: None, 2: 3.0, 3: 3.0, 4: 2.0}


def test_numbered_is_gapless_in_every_group(spark):
    rows = [(("x", "y", None)[k % 11 % 3], -(k * 37 % 101), k) for k in range(900)]
    df = spark.createDataFrame(rows, "name string, n long, k long")
    want = {}
    for g in ("x", "y", None):
        for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[r[2]] = i
    got = O.numbered(df, ["n", "k"], ["name"], slice_rows=30)
    assert got.columns == ["name", "n", "k", "code"]
    assert {r["k"]: r["code"] for r in got.collect()} == want


def test_best_so_far_over_several_slices(spark):
    """The catalogue's query over timestamps without a zone: one slice and many agree."""
    from parcel.plans.q_models import best_so_far
    from tests.conftest import SF_SMALL
    whole = best_so_far(spark, SF_SMALL)
    parts = best_so_far(spark, SF_SMALL, slice_rows=150)
    assert dict(whole.dtypes)["ts"] == "timestamp_ntz"
    assert sorted(whole.collect()) == sorted(parts.collect())
