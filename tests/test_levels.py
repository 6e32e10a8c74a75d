"""Level dictionaries without a ceiling: codes, joins in slices, sparse vectors."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from parcel.operators import levels as LV


def test_codes_by_frequency_and_hot_levels(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"l{k % 40:02d}", None if k % 5 == 0 else f"x{k % 2}") for k in range(600)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    table = LV.dictionary(LV.count_levels(df, ["a", "b"]), slice_rows=10).cache()
    want = {}
    for i, c in ((1, "a"), (2, "b")):
        values = [r[i] for r in rows if r[i] is not None]
        order = sorted(set(values), key=lambda v: (-values.count(v), v))
        want |= {(c, v): k for k, v in enumerate(order)}
    assert {(r["name"], r["level"]): r["code"] for r in table.collect()} == want
    unseen = df.union(spark.createDataFrame([(1000, "new", None)], df.schema))
    for hot_rows in (20, 200_000):
        got = LV.encode(unseen, ["id"], table, ["a", "b"], hot_rows=hot_rows).collect()
        assert len(got) == 601
        assert all(r["a_code"] == want.get(("a", r["a"])) and r["b_code"] == want.get(("b", r["b"])) for r in got)


def test_sparse_vectors(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, "y", None), (3, "x", "new")], "id long, a string, b string")
    table = LV.dictionary(LV.count_levels(df.where("id < 3"), ["a", "b"])).cache()
    size = LV.sizes(table)
    assert size == {"a": 2, "b": 1}
    out = LV.one_hot(LV.encode(df, ["id"], table, ["a", "b"]), size, ["a", "b"])
    got = {r["id"]: list(r["v"]) for r in out.select("id", vector_to_array("levels").alias("v")).collect()}
    assert got == {1: [1, 0, 1], 2: [0, 1, 0], 3: [1, 0, 0]}


def test_a_million_levels_fit_and_encode(spark):
    n = 1_000_000
    df = spark.range(n + 500_000).select("id", F.when(F.col("id") < n, F.col("id")).otherwise(7).cast(
        "string").alias("a"))
    table = LV.dictionary(LV.count_levels(df, ["a"])).cache()
    assert LV.sizes(table) == {"a": n} and LV.most_frequent(table, 1) == ["7"]
    out = LV.encode(df, ["id"], table, ["a"])
    row = out.agg(F.count("a_code").alias("n"), F.count_distinct("a_code").alias("d"), F.max("a_code").alias("m"),
                  F.count_if(F.col("a_code") == 0).alias("hot")).first()
    assert (row["n"], row["d"], row["m"], row["hot"]) == (n + 500_000, n, n - 1, 500_001)
    sparse = LV.one_hot(out.limit(3), {"a": n}, ["a"]).first()["levels"]
    assert sparse.size == n and len(sparse.indices) == 1
