"""Corpus pipeline: toxicity, line dedup, MinHash near-dedup, best-fit packing.

Every stage works on all rows that the stage before it kept and is written as Parquet in the
shared checkpoint folder, so a lost executor costs a stage's tasks and no more. Stages 1 to 3
return the columns of ``documents``; the last returns the packed pieces.

Nulls: a null text is an empty document (kept by every filter, one token when packed). Rows
that repeat in full go through all stages; near-dedup keeps one row of them. Empty tables give
empty results. Extra columns go along untouched up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcel.llm import linedup, minhash, packing, toxic
from parcel.llm.common import table
from parcel.llm.queries import vocabulary
from parcel.session import ensure_checkpoint_dir
from parcel.sources.store import delete


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half."""
    model = toxic.fit(docs, table(spark, sf_dir, "labels"))
    return toxic.keep(docs, model)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of runs of 50 words or more; ``n_chars`` follows."""
    done = linedup.dedup_lines(docs, report=False)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        done = done.withColumn("n_chars", F.char_length("text").cast(kind))
    return done


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near duplicates."""
    return minhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", remove_toxic), ("line_dedup", remove_repeated_lines),
          ("minhash", keep_one_of_near_duplicates), ("packing", pack)]

#: The model of the first stage and the tokenizer of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again; only the last one's table stays."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus_pipeline/{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:          # nothing reads the stage before the last one any more
            delete(spark, before)
        before = path
    return docs
