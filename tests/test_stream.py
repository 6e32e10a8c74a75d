"""Stream scoring equals batch scoring; errors of every kind come out once, with their cause."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcel.operators import errors as ER
from parcel.plans.q_stream import fit_scoring_state
from parcel.sources import ingest as IN
from parcel.sources.listings import listing_view
from parcel.streaming import scoring as SS
from tests.conftest import SF_SMALL

ID = T.StructField("listing_id", T.LongType())
PLANTED = {"price": "op aanvraag", "size": "groot", "year_of_construction": "circa 1900", "nr_rooms": "vijf",
           "postal_code": "onbekend", "energy_label": "Z"}
CAUSES = {"nr_rooms": "rooms"}


@pytest.fixture(scope="module")
def state(spark):
    return fit_scoring_state(spark, SF_SMALL)


@pytest.fixture(scope="module")
def folder(spark):
    """300 listings without errors as JSON lines, seven records with one error each."""
    good = ER.with_errors(listing_view(spark, SF_SMALL).drop("lat", "lon")).where(F.size("errors") == 0).drop("errors")
    path = tempfile.mkdtemp(prefix="parcel-stream-", dir="/tmp")
    first = good.limit(300).repartition(3)
    first.write.mode("overwrite").json(f"{path}/in")
    lines = first.limit(6).toJSON().collect()
    bad = []
    for k, (field, text) in enumerate(PLANTED.items()):
        bad.append(json.dumps(json.loads(lines[k]) | {field: text, "listing_id": 10_000_000 + k}))
    with open(f"{path}/in/bad.json", "w") as f:
        f.write("\n".join([*bad, '{"price": "half a rec']) + "\n")
    return path


def batch(spark, folder):
    schema = T.StructType([*IN.LISTING_RAW.fields, ID, T.StructField(IN.CORRUPT, T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", IN.CORRUPT).json(f"{folder}/in").cache()


def causes(rows):
    return sorted((r["listing_id"] or -1, e["cause"]) for r in rows for e in r["errors"])


def test_stream_equals_batch_with_planted_errors(spark, state, folder):
    keep = ["listing_id", "dist_to_center_bin_encoded", *state.meta.count_columns]
    want = {r["listing_id"]: r for r in SS.score(batch(spark, folder), state, keep).collect()}
    stream = SS.listing_stream(spark, f"{folder}/in", max_files=2, extra=[ID])
    q = SS.start(stream, state, f"{folder}/out", f"{folder}/dead", f"{folder}/counts", f"{folder}/ckpt", keep)
    q.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert len(rows) == len(want) == 307 and {r["batch_id"] for r in rows} >= {0, 1}
    for r in rows:
        w = want[r["listing_id"]]
        assert (r["prediction"] is None) == (w["prediction"] is None) == (r["listing_id"] is None)
        if r["prediction"] is not None:
            assert r["prediction"] == pytest.approx(w["prediction"], rel=1e-6)
            assert all(r[c] == w[c] for c in keep)
    planted = sorted([(10_000_000 + k, CAUSES.get(f, f)) for k, f in enumerate(PLANTED)] + [(-1, ER.CORRUPT_CAUSE)])
    assert causes(rows) == causes(want.values()) == planted
    dead = spark.read.parquet(*[f"{folder}/dead/batch_id={b}" for b in {r["batch_id"] for r in rows if r["errors"]}])
    assert sorted((r["listing_id"] or -1, r["cause"]) for r in dead.collect()) == planted
    assert {r["cause"]: r["detail"] for r in dead.collect()}["size"] == "groot"
    counts = {r["cause"]: r["n"] for r in spark.read.parquet(f"{folder}/counts").groupBy("cause").agg(
        F.sum("n").alias("n")).collect()}
    assert counts == {"none": 300, **{c: 1 for _, c in planted}}


def test_a_replayed_batch_replaces_its_output(spark, state, folder):
    run = SS.write_micro_batch(state, f"{folder}/o2", f"{folder}/d2", f"{folder}/c2")
    for _ in range(2):
        run(batch(spark, folder).limit(20), 5)
    assert spark.read.parquet(f"{folder}/o2").count() == 20


def test_sentinels_and_missing_fields_are_no_errors(spark):
    df = spark.createDataFrame([("N/A", None, ""), ("x", "12 m", "3")], "price string, size string, nr_rooms string")
    got = [[e["cause"] for e in r["errors"]] for r in ER.with_errors(df).collect()]
    assert got == [[], ["price"]]
    assert ER.with_errors(df.select(F.lit(1).alias("other"))).first()["errors"] == []
