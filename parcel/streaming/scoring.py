"""Stream scoring (SM-1..SM-3): the batch transform, applied to a listing stream.

Listings arrive as JSON files. Every micro-batch goes through the same ``conform -> errors ->
preprocess -> impute -> transform_features -> score`` functions as a batch, including the joins with
the fitted state's tables (coordinates and centroids with their amenity counts), so batch, stream and one-row
scoring cannot drift apart. Nothing is carried from batch to batch: no watermark or state store is needed.

A micro-batch is written into ``batch_id=<n>`` folders in overwrite mode, so a replayed batch
(after a failure) replaces its own output instead of duplicating it. Three tables come out: the
scored records with their errors, the dead letters (one row per record and error, partitioned by
cause) and the number of records per cause.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcel.operators import errors as ER
from parcel.operators import features as FE
from parcel.operators import fit as FIT
from parcel.operators import models as ML
from parcel.operators.preprocess import facility_flags, preprocess_listings
from parcel.sources import ingest as IN
from parcel.sources.store import scratch


@dataclass
class ScoringState:
    """Everything fitted in batch that scoring needs (small, or named tables, and the model)."""
    impute_values: dict
    meta: FE.FeatureMeta
    model: ML.FittedModel


def listing_stream(spark: SparkSession, path: str, max_files: int | None = None,
                   extra: Sequence[T.StructField] = ()) -> DataFrame:
    """SM-1 source: JSON listing files with the fixed raw schema (no inference); a line that is no
    JSON object arrives as its text."""
    schema = T.StructType([*IN.LISTING_RAW.fields, *extra, T.StructField(IN.CORRUPT, T.StringType())])
    r = (spark.readStream.schema(schema).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", IN.CORRUPT))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path)


def prepare(df: DataFrame, state: ScoringState, keep: Sequence[str] = ("listing_id",)
            ) -> DataFrame:
    """conform -> errors -> preprocess -> impute -> features."""
    checked = ER.with_errors(IN.conform_listing(df))  # keeps listing_id / url when present
    # An unknown label is reported and scored as the lowest class.
    known = FE.energy_ordinal("energy_label", on_unknown="null").isNotNull()
    safe = checked.withColumn("energy_label", F.when(known, F.col("energy_label")).otherwise(F.lit("G")))
    clean = facility_flags(preprocess_listings(safe), state.meta.binary_flags)
    filled = FIT.apply_impute(clean, state.impute_values)
    keep = [k for k in keep if k in filled.columns or k in state.meta.count_columns]
    return FE.transform_features(filled, state.meta, keep=[*keep, "errors"])


def score(df: DataFrame, state: ScoringState, keep: Sequence[str] = ("listing_id",)
          ) -> DataFrame:
    """SM-3: a result for every record: prediction (none for unreadable text) and errors. ``keep``
    may name record fields, features and amenity counts."""
    prepared = prepare(df, state, keep)
    mine = [k for k in keep if k in prepared.columns]
    renamed = prepared.withColumns({f"_keep_{k}": F.col(k) for k in mine})
    out = ML.score(renamed.drop(*[k for k in mine if k not in state.model.features]), state.model,
                   keep=[*[f"_keep_{k}" for k in mine], "errors"])
    return out.select(*[F.col(f"_keep_{k}").alias(k) for k in mine],
                      F.when(ER.is_readable(), F.col("prediction")).alias("prediction"), "errors")


def write_micro_batch(state: ScoringState, sink: str, dead_letter: str, counts: str,
                      keep: Sequence[str] = ("listing_id",)):
    """foreachBatch writer: scored once, then three tables, each idempotent per batch id."""
    def run(batch: DataFrame, batch_id: int) -> None:
        to = lambda base: f"{base.rstrip('/')}/batch_id={batch_id}"
        with scratch(score(batch, state, keep)) as scored:        # computed once, read three times
            kept = [c for c in scored.columns if c not in ("prediction", "errors")]
            scored.write.mode("overwrite").parquet(to(sink))
            ER.dead_letters(scored, kept).write.mode("overwrite").partitionBy("cause").parquet(to(dead_letter))
            ER.error_counts(scored).write.mode("overwrite").parquet(to(counts))
    return run


def start(stream: DataFrame, state: ScoringState, sink: str, dead_letter: str, counts: str,
          checkpoint: str, keep: Sequence[str] = ("listing_id",), available_now: bool = True):
    """SM-1 / SM-2 / SM-3: start the scoring stream; returns the StreamingQuery."""
    w = (stream.writeStream.foreachBatch(write_micro_batch(state, sink, dead_letter, counts, keep))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
