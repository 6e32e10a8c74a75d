"""Exact deduplication over an extendible-hash index in shared files.

Keys are 64-bit hashes of the normalised text (A-Z lower-cased). The directory has ROOT slots by
the top bits of a key; a slot whose buckets hold more than ``capacity`` distinct keys doubles
its part of the directory, bit by bit, until none is overfull. A bucket is a range of keys and has
one owner: the texts are shuffled by bucket, so the owner task meets all of a bucket's texts,
compares whole byte strings (equal texts become one entry) and chains different texts that share
a key. The entries, without texts, are the index in the shared checkpoint folder.

Documents are then looked up: the directory gives the bucket, the bucket the key. The entry of a
key without a chain is the answer; a key with a chain asks for the entry of the text's SHA-256.
Whether there is any chain is counted, and documents are read for it only if so.

A key with more than ``max(HOT_ROWS, rows / HOT_KEYS)`` rows is hot; there are fewer than HOT_KEYS
of them at any size. Their copies are combined before they go to their owner (one row per text and
input task), and their entries are looked up by a broadcast of at most HOT_KEYS rows.

Null text counts as empty; all empty texts are equal. Of equal texts the largest doc_id stays
(null is the smallest; rows that repeat the winning doc_id stay with it). An empty table gives
an empty result. Extra columns of ``docs``, whatever their names, are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcel.llm.common import ascii_lower, cut, documents

ROOT_BITS = 6
CAPACITY = 2_048
HOT_ROWS = 16
HOT_KEYS = 10_000


def keyed_texts(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """doc_id, key, norm. ``key_bits`` under 64 forces collisions (for tests)."""
    docs = documents(docs).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    key = F.shiftleft(F.xxhash64("norm"), 64 - key_bits) if key_bits < 64 else F.xxhash64("norm")
    return docs.select("doc_id", key.alias("key"), "norm")


def slot_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - ROOT_BITS).cast("int")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> list[int]:
    """Local depth of every root slot (64 numbers): the least at which no bucket of the slot
    has more than ``capacity`` distinct keys. Buckets already small enough are not counted
    again."""
    depths = [0] * (1 << ROOT_BITS)
    keys = keys.select("key").distinct()
    bucket_rows = keys.groupBy(slot_of(F.col("key")).alias("slot")).count()
    full = {r[0]: r[1] for r in bucket_rows.where(F.col("count") > capacity).collect()}
    while full:
        for slot, n in full.items():
            depths[slot] += max(1, (n // capacity).bit_length() - 1)
        largest = keys.where(slot_of(F.col("key")).isin(list(full))).groupBy(
            slot_of(F.col("key")).alias("slot"), bucket_of(F.col("key"), depths).alias("b")
        ).count().groupBy("slot").agg(F.max("count").alias("most"))
        full = {r[0]: r[1] for r in largest.where(F.col("most") > capacity).collect()
                if depths[r[0]] < 64 - ROOT_BITS}
    return depths


def bucket_of(key: Column, depths: list[int]) -> Column:
    """First key of the bucket: the key's top bits, as many as its slot's depth asks for."""
    bits = F.element_at(F.array(*[F.lit(d) for d in depths]), slot_of(key) + 1)
    low = (F.lit(64 - ROOT_BITS) - bits).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftrightunsigned", key, low), low)


def hot_keys(sizes: DataFrame) -> DataFrame:
    """The keys of ``sizes`` (key, rows) with more than their share of rows: fewer than HOT_KEYS."""
    rows = sizes.agg(F.sum("rows")).first()[0] or 0
    return sizes.where(F.col("rows") > max(HOT_ROWS, rows // HOT_KEYS + 1)).select("key")


def owned_entries(texts: DataFrame, hot: DataFrame) -> DataFrame:
    """bucket, key, sha, head, n: one row per text, made by the owner of its bucket."""
    cold = texts.join(F.broadcast(hot), "key", "left_anti").select(
        "bucket", "key", "norm", F.col("doc_id").alias("head"), F.lit(1).cast("long").alias("n"))
    combined = texts.join(F.broadcast(hot), "key", "left_semi").groupBy("bucket", "key", "norm").agg(
        F.max("doc_id").alias("head"), F.count(F.lit(1)).alias("n"))
    return cold.unionByName(combined).repartition("bucket").groupBy("bucket", "key", "norm").agg(
        F.max("head").alias("head"), F.sum("n").alias("n")).select(
        "bucket", "key", F.sha2("norm", 256).alias("sha"), "head", "n")


def build_index(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64):
    """(rows, index, hot). Rows: doc_id, bucket, key per document. Index entries: bucket, key, chain
    (place among different texts of one key), links (their number), sha, head (the doc that stays),
    n. Hot: the keys with more than their share of rows."""
    texts = keyed_texts(docs, key_bits)
    keyed = cut(texts.select("doc_id", "key"))
    sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")))
    depths = directory(sizes, capacity)
    hot = hot_keys(sizes)
    bucket = bucket_of(F.col("key"), depths)
    chain = Window.partitionBy("bucket", "key")
    index = cut(owned_entries(texts.withColumn("bucket", bucket), hot)
                .withColumn("chain", F.row_number().over(chain.orderBy("sha")))
                .withColumn("links", F.count(F.lit(1)).over(chain)))
    return keyed.withColumn("bucket", bucket), index, hot


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed, index, hot = build_index(docs, capacity, key_bits)
    entries = index.where("links = 1").select("bucket", "key", "sha", "head", "n")
    hot_entries = F.broadcast(entries.join(F.broadcast(hot), "key", "left_semi"))
    found = keyed.join(hot_entries, ["bucket", "key"]).unionByName(
        keyed.join(F.broadcast(hot), "key", "left_anti").join(entries, ["bucket", "key"]))
    chained = index.where("links > 1").select("key", "sha", "head", "n")
    if not chained.isEmpty():
        texts = keyed_texts(docs, key_bits).join(chained.select("key").distinct(), "key", "left_semi")
        found = found.select("doc_id", "key", "sha", "head", "n").unionByName(
            texts.select("doc_id", "key", F.sha2("norm", 256).alias("sha")).join(
                chained, ["key", "sha"]))
    return found.select("doc_id", F.col("head").alias("keep_id"), F.col("n").alias("group_size"),
                        F.col("doc_id").eqNullSafe(F.col("head")).alias("kept"),
                        F.col("sha").alias("text_sha256"))
