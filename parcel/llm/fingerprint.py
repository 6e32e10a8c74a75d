"""Document fingerprints by MinHash.

A document's words (A-Z lower-cased, parted by space and 9 to 13) give its set of five-word
shingles, or the whole sequence as one shingle if there are fewer words. PERMS universal hash
functions (a * x + b modulo 2**64, upper half) are applied to all shingles of a few documents at
a time in numpy; the fingerprint is the lowest 16 bits of each function's smallest value, written
as hexadecimal digits. The likeness of two fingerprints is the share of equal places, an unbiased
estimate of the Jaccard similarity of the sets but for chance hits of 1 in 65536.

``fingerprints`` also takes every document's neighbour: documents are dealt out as ranges of
descending doc_id whose boundaries are sampled keys, drawn by size, so ranges have about equal
bytes. A boundary is the key of a record; that record is also sent to the end of the range before
it, so every task sees the neighbour of its last record, and a task streams through its sorted
records with one of them in hand. No document is numbered, and texts are shuffled once.

``near_copies`` joins signature bands: documents with equal texts are one class. All members of a
bucket are compared, in cells of two blocks; those whose fingerprints do not rule the threshold out
(MARGIN under it, more than six standard errors) belong to one family. Two classes at the threshold share
no bucket with probability 5e-6. Within a family every two classes are compared on their full shingle
sets, in cells of two blocks: ``n_links`` counts all links, and the components of the links are the
groups. No pair leaves a task: a cell gives counts and who is joined there (a star for each group), and
before components are sought the stars of all cells are hung together, about one link for a member. What
that costs: a bucket or family of m classes takes m * m / 2 comparisons by the nature of the count, and
a class is sent to m / BLOCK cells; a cell is bounded in members and in characters.

Defined results: a null text is empty. A text without words has no shingles and a fingerprint of
its own kind (all f); it is like other such texts (1) and unlike the rest (0), and linked with
nothing. Null doc_ids come last in the order; records with equal doc_id are ordered by md5 of the
text, and records equal in both are neighbours of each other (they stay in one range). The
document after the last is the first, so a single document is its own neighbour. An empty table
gives an empty result. Texts of any length are read whole. Extra columns are left behind.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcel.llm.common import cut, documents
from parcel.llm.graph import components
from parcel.llm.hashing import mix, words_of

PERMS = 128
ROWS = 4                   # places of a band
SHINGLE = 5                # words
MARGIN = 0.25
WAVE = 16                  # bands joined together
BLOCK = 256                # classes of a block
BLOCK_CHARS = 1 << 23      # and their characters, at most about
GROUP_CHARS = 1 << 19      # characters fingerprinted at once; a longer text goes alone
RANGE_BYTES = 1 << 30      # of text in a range, at most about
SAMPLES = 8                # sampled keys for each boundary
NULL_LAST = "nulls_last int, descending long, md5 binary"

_draw = np.random.default_rng(7919)
_A = _draw.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(SHINGLE)], np.uint64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------------------- signatures
def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the texts in turn, and the number of each text's."""
    words, ends, _, _ = words_of(texts)
    starts = np.concatenate([[0], ends[:-1]])
    count = ends - starts
    if not len(words):
        return words, np.zeros(len(texts), np.int64)
    at = np.arange(len(words))
    left = np.repeat(ends, count) - at                     # words from here to the text's end
    first = at == np.repeat(starts, count)
    at = at[(left >= SHINGLE) | first]
    length = np.minimum(left[at], SHINGLE)
    with np.errstate(over="ignore"):
        total = length.astype(np.uint64) * _LENGTH
        for j in range(SHINGLE):
            here = length > j
            total[here] += words[at[here] + j] * _POWERS[j]
    return mix(total), np.where(count, np.maximum(count - SHINGLE + 1, 1), 0)


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about GROUP_CHARS."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > GROUP_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def signatures(texts: list[str]) -> np.ndarray:
    """(texts, PERMS) places of 16 bits."""
    out = np.full((len(texts), PERMS), 0xFFFF, np.uint16)
    for a, z in groups(texts):
        hashes, count = shingles(texts[a:z])
        full = np.flatnonzero(count)
        if not len(full):
            continue
        starts = (np.cumsum(count) - count)[full]
        for p in range(PERMS):
            with np.errstate(over="ignore"):
                values = (hashes * _A[p] + _B[p]) >> np.uint64(32)
            out[a + full, p] = (np.minimum.reduceat(values, starts) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


# ---------------------------------------------------------------------------- neighbours
def boundaries(keyed: DataFrame, ranges: int | None = None) -> list[tuple]:
    """Sorted keys of records at which ranges start; the first is the smallest key there is."""
    key = F.struct("nulls_last", "descending", "md5")
    size = F.octet_length("text") + F.lit(1)
    total, least = keyed.agg(F.sum(size), F.min(key)).first()
    if total is None:
        return []
    if ranges is None:
        ranges = max(2 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                     -(-total // RANGE_BYTES))
    u = F.pmod(F.xxhash64("descending", "md5", F.lit(1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = sorted((r[0], r[1], bytes(r[2])) for r in keyed.where(
        u < size * F.lit(SAMPLES * ranges / total)).select("nulls_last", "descending", "md5").collect())
    picked = {sample[len(sample) * k // ranges] for k in range(1, ranges)} if sample else set()
    return sorted(picked | {(least[0], least[1], bytes(least[2]))})


def in_ranges(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Records sorted within ranges, each range ended by the first record of the next (``head``)."""
    text = F.col("text")
    keyed = documents(docs).select(
        "doc_id", "text", F.col("doc_id").isNull().cast("int").alias("nulls_last"),
        F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("descending"),
        F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("md5"))
    bounds = boundaries(keyed, ranges)
    last = max(len(bounds) - 1, 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("nulls_last", "descending", "md5"))))
            at = [bisect_right(bounds, k) - 1 for k in keys]
            also = [i for i, (k, p) in enumerate(zip(keys, at)) if bounds[p] == k]
            rows = np.concatenate([np.arange(len(at)), np.array(also, np.int64)])
            part = at + [(at[i] or last + 1) - 1 for i in also]
            head = [0] * len(at) + [1] * len(also)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(head, pa.int32()), *b.take(pa.array(rows)).columns],
                names=["range", "head", *b.schema.names])

    dealt = keyed.mapInArrow(deal, "range int, head int, doc_id long, text string, " + NULL_LAST)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(max(parts, -(-(last + 1) // 2)), "range").sortWithinPartitions(
        "range", "head", "nulls_last", "descending", "md5", "text")


OUT = ("doc_id long, md5 binary, n_chars long, edited_sha256 string, places binary, edited_places binary, "
       "near_edited double, near_next double, has_words boolean")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per document its places, those of the edited text, and the likenesses; checkpointed."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                    # the last record so far: (range, head, doc_id, md5, text, places)
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("range", "head", "doc_id", "md5", "text")]
            for a, z in groups(columns[-1]):
                places = signatures(columns[-1][a:z])
                rows = list(zip(*(c[a:z] for c in columns), places))
                if held:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and not x[1]]
                if pairs:
                    yield described(pairs)

    return cut(in_ranges(docs, ranges).mapInArrow(stream, OUT))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next document's first."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def described(pairs: list[tuple]) -> pa.RecordBatch:
    """Rows of OUT for (record, next record)."""
    own = np.array([x[5] for x, _ in pairs])
    texts = [edited(x[4], y[4]) for x, y in pairs]
    new = signatures(texts)
    cols = [[x[2] for x, _ in pairs], [x[3] for x, _ in pairs], [len(x[4]) for x, _ in pairs],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
            [p.astype(">u2").tobytes() for p in own], [p.astype(">u2").tobytes() for p in new],
            likeness(own, new), likeness(own, np.array([y[5] for _, y in pairs])),
            (own != 0xFFFF).any(axis=1)]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(),
             pa.float64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      names=[c.split()[0] for c in OUT.split(", ")])


# ---------------------------------------------------------------------------- near copies
def banded(classes: DataFrame, first: int, last: int) -> DataFrame:
    """(bucket, md5): one row per class and band; a bucket is a band's number and places."""
    return classes.select("md5", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("band"),
                          "places").select(F.concat(
                              F.unhex(F.lpad(F.hex("band"), 2, "0")),
                              _slice("places", "band", 2 * ROWS)).alias("bucket"), "md5")


def shared(classes: DataFrame) -> DataFrame:
    """(bucket, md5, n) of the buckets with n classes, two or more; checkpointed."""
    out = None
    for first in range(0, PERMS // ROWS, WAVE):
        bands = banded(classes, first, first + WAVE)
        several = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = cut(bands.join(several, "bucket"))
        out = found if out is None else out.unionByName(found)
    return out


def dealt(members: DataFrame, blocks: str, *key: str) -> DataFrame:
    """Members in their slot, one row for each cell (i, j) of two of the ``blocks`` slots that has theirs."""
    return members.withColumn("slot", F.pmod(F.xxhash64("md5", *key), F.col(blocks)).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))).withColumns(
            {"i": F.least("slot", "other"), "j": F.greatest("slot", "other")}).drop("other", blocks)


def _slice(col: str, at: str, width: int) -> Column:
    return F.expr(f"substring({col}, {at} * {width} + 1, {width})")


def cells(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """Stretches of equal keys in batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in key)))
        start = 0
        for k in range(len(keys)):
            if keys[k] != last:
                if k > start:
                    held.append(b.slice(start, k - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], k, keys[k]
        if start < len(keys):
            held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def join(part: np.ndarray, x: int, ys: np.ndarray) -> None:
    """The parts of members ``x`` and ``ys`` become one."""
    others = np.unique(part[ys[part[ys] != part[x]]])
    if len(others):
        part[np.isin(part, others)] = part[x]


def stars(part: np.ndarray, nodes: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """(a, b): the members of every part with the smallest of them."""
    a, b, first = [], [], None
    for k in sorted(range(len(nodes)), key=lambda k: (part[k], nodes[k])):
        if first is None or part[k] != part[first]:
            first = k
        else:
            a.append(nodes[first])
            b.append(nodes[k])
    return a, b


def likely(bands: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that join the members of one bucket whose fingerprints do not rule the threshold
    out: every two members are compared (unless joined already), and a cell gives stars."""
    key = ("bucket", "i", "j")
    rows = dealt(bands.withColumn("n", F.ceil(F.col("n") / BLOCK).cast("int")).join(
        classes.select("md5", "places"), "md5"), "n", "bucket")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cells(batches, key):
            nodes = t.column("md5").to_pylist()
            places = np.frombuffer(b"".join(t.column("places").to_pylist()), ">u2").reshape(-1, PERMS)
            part = np.arange(len(nodes))
            for x in range(len(nodes) - 1):
                ys = x + 1 + np.flatnonzero(part[x + 1:] != part[x])
                if len(ys):
                    join(part, x, ys[likeness(places[ys], places[x]) >= threshold - MARGIN])
            a, b = stars(part, nodes)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                                                 names=["a", "b"])

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "a binary, b binary")


def hung(links: DataFrame) -> DataFrame:
    """The components of ``links`` (a, b) by fewer links: every node hangs on its smallest neighbour, and
    so do the other neighbours that are smaller than the node. A member has a star's centre in each of its
    cells; what is left of them is about one link a member and some between centres."""
    low = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    first = F.min("a").over(Window.partitionBy("b"))
    return low.withColumn("first", first).select(
        F.col("first").alias("a"), F.when(F.col("a") == F.col("first"), F.col("b")).otherwise(F.col("a")).alias("b")
    ).distinct()


def filter_words(wanted: DataFrame, n: int) -> np.ndarray:
    """A bit for every wanted class (8 bits or more for each, 2**27 bits at most) as longs."""
    bits = 1 << min(27, max(16, (8 * n).bit_length()))
    place = F.pmod(F.xxhash64("md5"), F.lit(bits))
    words = np.zeros(bits // 64, np.int64)
    for r in wanted.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).collect():
        words[r["w"]] = r["v"]
    return words


def sets_linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int
                ) -> Iterator[tuple[int, np.ndarray]]:
    """(member, members of higher number linked with it); all in one list, those of ``right`` after those
    of ``left``. Without ``right`` all pairs are compared, else those of one side with the other."""
    full = left + (right or [])
    size = np.array([len(x) for x in full])
    starts = np.cumsum(size) - size
    ids = np.unique(np.concatenate(full), return_inverse=True)[1]
    mark = np.zeros(ids.max() + 1, np.int64)
    for x in range(len(left)):
        first = x + 1 if right is None else len(left)
        if first == len(full):
            return
        own = ids[starts[x]:starts[x] + size[x]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids[starts[first]:]], starts[first:] - starts[first])
        mark[own] = 0
        ok = 100 * both >= percent * (size[x] + size[first:] - both)
        yield x, first + np.flatnonzero(ok)


def compared(members: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): for members (node, label) the links with classes of the same label, by Jaccard
    similarity of the full shingle sets. Rows with b say that a and b are linked, if by way of others; the
    rest give a's number of links in one cell. Only the texts of the members are shuffled: a bit table of bounded
    size sorts out nearly all others in the scan."""
    known = members.join(classes.select(F.col("md5").alias("node"), "n_chars"), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_chars") / BLOCK_CHARS)).cast("int")
    placed = cut(known.join(known.groupBy("label").agg(blocks.alias("blocks")), "label").select(
        F.col("node").alias("md5"), "label", "blocks"))
    words = docs.sparkSession.sparkContext.broadcast(filter_words(placed, placed.count()))
    percent = round(100 * threshold)
    key = ("label", "i", "j")

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.value.view(np.uint64)
        for b in batches:
            p = b.column("p").to_numpy()
            hit = (table[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)
            yield b.select(["md5", "text"]).filter(pa.array(hit.astype(bool)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for a, z in groups(texts):
                hashes, count = shingles(texts[a:z])
                own = [np.unique(h).tobytes() for h in np.split(hashes, np.cumsum(count)[:-1])]
                yield pa.RecordBatch.from_arrays([*b.select(["md5", "label", "blocks"]).slice(a, z - a).columns,
                                                  pa.array(own, pa.binary())],
                                                 names=["md5", "label", "blocks", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cells(batches, key):
            slot = t.column("slot").to_numpy()
            order = np.argsort(slot, kind="stable")
            t = t.take(pa.array(order))
            nodes = t.column("md5").to_pylist()
            full = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            cut_at = int((slot == slot.min()).sum())
            if t.column("i")[0] == t.column("j")[0]:
                found = sets_linked(full, None, percent)
            elif cut_at < len(full):
                found = sets_linked(full[:cut_at], full[cut_at:], percent)
            else:
                continue                       # the other block is empty
            part, n = np.arange(len(full)), np.zeros(len(full), np.int64)
            for x, ys in found:
                n[x] += len(ys)
                n[ys] += 1
                join(part, x, ys)
            a, b = stars(part, nodes)
            some = np.flatnonzero(n).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(a + [nodes[k] for k in some], pa.binary()), pa.array(b + [None] * len(some), pa.binary()),
                 pa.array([0] * len(a) + n[some].tolist(), pa.int64())], names=["a", "b", "n"])

    text = documents(docs).select(F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("md5"), "text")
    bits = 64 * len(words.value)
    full = text.withColumn("p", F.pmod(F.xxhash64("md5"), F.lit(bits))).mapInArrow(
        sifted, "md5 binary, text string").groupBy("md5").agg(F.first("text").alias("text")).join(placed, "md5")
    rows = dealt(full.mapInArrow(sets, "md5 binary, label binary, blocks int, shingles binary"), "blocks")
    return cut(rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(
        compare, "a binary, b binary, n long"))


def near_copies(prints: DataFrame, docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``prints`` plus group_id, the smallest doc_id reachable through verified links (its
    own for a text without words), and n_links, the number of other classes it is linked with."""
    classes = cut(prints.where("has_words").groupBy("md5").agg(
        F.first("places").alias("places"), F.min("doc_id").alias("class_doc"), F.first("n_chars").alias("n_chars")))
    families = components(hung(hung(likely(shared(classes), classes, threshold))))
    found = compared(families, classes, docs, threshold)
    labels = components(hung(found.where("b is not null").select("a", "b")))
    number = found.where("b is null").groupBy(F.col("a").alias("_c")).agg(F.sum("n").alias("n_links"))
    smallest = classes.join(labels, F.col("md5") == F.col("node")).groupBy("label").agg(
        F.min("class_doc").alias("group_id"))
    linked = labels.join(smallest, "label").join(number, F.col("node") == F.col("_c")).select(
        F.col("node").alias("_m"), "group_id", "n_links")
    own = classes.select(F.col("md5").alias("_k"), "class_doc")
    return prints.join(own, F.col("md5") == F.col("_k"), "left").join(
        linked, F.col("md5") == F.col("_m"), "left").select(
            *prints.columns, F.coalesce("group_id", "class_doc", "doc_id").alias("group_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
