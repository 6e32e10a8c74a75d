"""Scalar parsers on the edge values of FIXTURES F11."""

from pyspark.sql import functions as F

from parcel.functions import parse as P


def _one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_price_and_size(spark):
    vals = ["€ 500.000 k.k.", "N/A", "", None, "Prijs op aanvraag", "86 m²", "12,5 m²", "1.830"]
    assert _one(spark, vals, P.parse_price) == [500000, None, None, None, None, 86, 125, 1830]


def test_year(spark):
    vals = ["Voor 1906", "Na 2020", "2000", "onbekend", None, "Voor", " 2000"]
    assert _one(spark, vals, P.parse_year) == [1905, 2021, 2000, None, None, None, None]


def test_currency_and_float(spark):
    assert _one(spark, ["€ 1.234.567", "12.50", ".", "abc", None], P.to_float_currency) == \
        [1.234567, 12.5, None, None, None]
    assert _one(spark, ["1.2.3", ".", "3e verdieping", "12 m²"], P.to_float) == \
        [None, None, 3.0, 12.0]


def test_pct_and_int(spark):
    assert _one(spark, ["38%", "1.830", None], P.to_float_pct) == [0.38, 18.3, None]
    assert _one(spark, ["1.830", "€ 5.990", "x"], P.to_int) == [1830, 5990, None]


def test_postal_city(spark):
    vals = ["1012 AB Amsterdam", "1012ab amsterdam", "  1017AB  ", "geen code", None]
    codes = _one(spark, vals, P.postal_code_clean)
    cities = _one(spark, vals, P.postal_city)
    assert codes == ["1012 AB", "1012AB", "1017AB", "GEEN CODE", None]
    assert cities == ["AMSTERDAM", "AMSTERDAM", None, None, None]


def test_floor_and_lease(spark):
    assert _one(spark, ["Begane grond", "N/A", None, "2e woonlaag", "kelder"],
                P.extract_floor) == [0, 0, 0, 2, 0]
    lease = _one(spark, ["Volle eigendom", "", None, "Erfpacht, einddatum erfpacht: 01-09-2081",
                         "Erfpacht, einddatum erfpacht: 01-09-2001", "Erfpacht"],
                 lambda c: P.extract_lease_years(c, 2025))
    assert lease == [None, None, None, 56, 0, None]


def test_simplify(spark):
    assert _one(spark, ["Plat dak", "Zadeldak", "N/A", None, "Riet"], P.simplify_roof) == \
        ["Flat", "Saddle", "Unknown", "Unknown", "Other"]
    assert _one(spark, ["Volle eigendom", "Erfpacht Gemeentelijk", "Erfpacht", "", "x"],
                P.simplify_ownership) == ["Full", "Municipal", "Leasehold", "Unknown", "Other"]
    assert _one(spark, ["In centrum", "In woonwijk", "Vrij uitzicht", None, "Aan park"],
                P.simplify_location) == ["Central", "Residential", "Other", "Unknown", "Park"]


def test_flags_and_sentinels(spark):
    assert _one(spark, ["Balkon", "N/A", None], P.presence_flag) == [1, 0, 0]
    assert _one(spark, ["N/A", " ", "x", None], P.nullify_sentinels) == [None, None, "x", None]
    assert _one(spark, ["5", "5.0", "0.1", "x"], P.param_integral) == [5, 5, None, None]
