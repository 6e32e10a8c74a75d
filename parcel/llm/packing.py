"""Best-fit packing of token sequences by minimum bin slack.

A bin starts with the longest piece left; a bitset subset-sum over the lengths that are left
finds the combination that fills the rest best, and that combination is removed. Only the
number of pieces of each length matters for the search, so it runs on the histogram of lengths
(at most ``capacity`` entries, whatever the input's size), and a combination is taken as many
times as its pieces last: the next bins of the search would be the same ones. Pieces then find
their places by their rank among the pieces of equal length.

Null text counts as empty: the end token alone. Repeated rows are packed each on its own. Texts
of any length are tokenized whole and cut into pieces of ``capacity`` tokens, the first one
shorter.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcel.llm.bpe import _gather, _spans, byte_strings, slices
from parcel.llm.common import cut, documents, worker_cache

CAPACITY = 1024
END_ID = 2
MAX_WORDS = 300_000        # word cache entries of a worker; emptied when full
RANK_ROWS = 500_000          # pieces that one ranking task is meant to hold
BROADCAST_ROWS = 60_000      # plan rows (about 60 bytes each) up to which they are broadcast


class ByteEncoder:
    """Byte-level ids of whole texts. A token never spans a boundary between a character and a
    space after it, so texts are split there and each word is encoded once. Texts with runs of
    spaces or special tokens go to the tokenizer itself."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer
        from public_tokenizers import PATTERN
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        spec = json.loads(self.tok.to_str())
        table = byte_strings()
        self.added = [a["content"] for a in spec["added_tokens"]]
        ranks = {bytes(table[c] for c in t): i for t, i in spec["model"]["vocab"].items()
                 if t not in self.added}
        self.plain = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks,
                                       special_tokens={}).encode_ordinary
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.ids, self.ends = array("I"), array("q", [0, 0])

    def word(self, word: str, ids=None) -> int:
        k = self.index.get(word)
        if k is None:
            self.ids.extend(self.plain(word) if ids is None else ids)
            self.ends.append(len(self.ids))
            k = self.index[word] = len(self.index)
        return k

    def words_of(self, text: str, out: list) -> None:
        if any(t in text for t in self.added) or "  " in text or text.endswith(" "):
            # one entry for the whole text, not kept under a name of its own
            self.ids.extend(self.tok.encode(text, add_special_tokens=False).ids)
            self.ends.append(len(self.ids))
            k = self.index[f"\x00 {len(self.index)}"] = len(self.index)
            out.append(k)
            return
        words = text.split(" ")
        spaced = [" " + w for w in words[1:]]
        out.append(self.word(words[0]))
        try:
            out.extend([self.index[w] for w in spaced])
        except KeyError:
            out.extend([self.word(w) for w in spaced])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > MAX_WORDS:
            self.forget()
        words, ends = [], []
        for t in texts:
            self.words_of(t, words)
            ends.append(len(words))
        ids, id_ends = _gather(np.array(self.ids, "<u4"), np.array(self.ends),
                               np.array(words, np.int64), np.array(ends, np.int64))
        return [ids[a:b] for a, b in _spans(id_ends)]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and ids with ``with_ids``)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches):
        enc = worker_cache(("packing", path), lambda: ByteEncoder(path))
        for doc_ids, texts in slices(batches):
            rows = []
            for doc_id, ids in zip(doc_ids, enc.encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                n = len(ids)
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    part = ids[a:b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(part.tobytes()),
                                 *([part.astype(np.int32)] if with_ids else [])))
            cols = list(zip(*rows)) or [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                     pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names[:len(cols)])

    return documents(docs).mapInArrow(run, schema)


def fullest(room: int, left: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``: lengths are
    added from the longest, ``reach`` has a bit for every sum that they can make."""
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        for _ in range(min(left[length], room // length)):
            more = reach | (reach << length) & full
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> room & 1:
            break
    target, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> target & 1:
            taken[length] = taken.get(length, 0) + 1
            target -= length
    return taken


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict, int]]:
    """(combination, times) until no piece is left. Each entry uses up the pieces of a length
    or nearly so, hence their number does not grow with the input."""
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    plan = []
    while left:
        seed = max(left)
        left[seed] -= 1
        bin_ = fullest(capacity - seed, left)
        left[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(left[k] // m for k, m in bin_.items())
        plan.append((bin_, times))
        for k, m in bin_.items():
            left[k] -= times * m
        left = {k: n for k, n in left.items() if n}
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple = ("doc_id", "piece"),
         rank_rows: int = RANK_ROWS) -> DataFrame:
    """``pieces`` (any columns, with ``length``) plus sequence_id and offset."""
    pieces = cut(pieces)
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    rows, sequence = [], 0
    used = dict.fromkeys(counts, 0)
    for bin_, times in plan_bins(counts, capacity):
        offset = 0
        for length in sorted(bin_, reverse=True):
            many = bin_[length]
            rows.append((length, used[length], used[length] + times * many, many, sequence, offset))
            used[length] += times * many
            offset += length * many
        sequence += times
    plan = spark.createDataFrame(rows, "_length long, _lo long, _hi long, _many long, _first long, "
                                       "_offset long")
    if len(rows) <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    # rank among equal lengths: within a hash slice, after the slices before it
    parts = max(64, -(-sum(counts.values()) // rank_rows))
    keyed = pieces.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    slices_ = keyed.groupBy("length", "_slice").count().select(
        F.col("length").alias("_l"), F.col("_slice").alias("_s"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = keyed.withColumn("_in", F.row_number().over(
        Window.partitionBy("length", "_slice").orderBy(*order, *[
            c for c in ("ids_crc32",) if c in pieces.columns])) - 1)
    rank = F.col("_before") + F.col("_in")
    placed = ranked.join(slices_, (F.col("length") == F.col("_l")) & (F.col("_slice") == F.col("_s"))
                         ).withColumn("_rank", rank)
    at = F.col("_rank") - F.col("_lo")
    return placed.join(plan, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo"))
                       & (F.col("_rank") < F.col("_hi"))).select(
        *pieces.columns, (F.col("_first") + F.floor(at / F.col("_many"))).alias("sequence_id"),
        (F.col("_offset") + at % F.col("_many") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    """Tokenize and pack whole documents."""
    return pack(token_pieces(docs, path, capacity, end_id, with_ids), capacity)
