"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its distinct shingles of ``width`` words (fewer words: the whole
sequence). Equal word sequences form one class at once; everything below runs on classes.

The forest has ``TREES`` trees; a tree orders the classes by the signature read from another
place. Classes that share the first ``DEPTH`` values of an order form a region. In every
region, sorted by the deeper values, neighbours with the longest common prefix are candidates;
a region of more than REGION classes is cut at a greater depth (and, where even the deepest
prefixes are equal, by id), so no task sees an unbounded region. Candidates are confirmed on
full shingle sets. Regions that then still hold more than one component have all their pairs
from different components compared, in blocks of REGION by REGION members: no candidate of a
region is left out, however large it is. A pair at the threshold shares no region with
probability (1 - 0.75 ** DEPTH) ** TREES, about five in a million.

Null or empty texts have no shingles and are linked with nothing. Repeated rows are documents
like others. A null doc_id counts as the smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcel.llm.bpe import slices, text_slices
from parcel.llm.common import cut, documents
from parcel.llm.graph import components
from parcel.llm.hashing import mix, words_of

WIDTH, PERCENT = 5, 75
TREES, DEPTH = 32, 4
REGION = 128
NO_ID = -(1 << 63)

_rng = np.random.default_rng(71)
_XOR = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.array([mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(64)])


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, ends, _, _ = words_of(texts)
    n = len(hashes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            rolled += hashes[k:n - width + 1 + k] * _STEP[k]
        rolled = mix(rolled)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= width:
            out.append(np.unique(rolled[start:end - width + 1]))
        elif end > start:
            with np.errstate(over="ignore"):
                whole = (hashes[start:end] * _STEP[:end - start]).sum(dtype=np.uint64)
                out.append(mix(np.array([whole + np.uint64(end - start)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def sequence_ids(texts: list[str]) -> list[int]:
    """64-bit id of each text's word sequence (order counts)."""
    hashes, ends, _, _ = words_of(texts)
    out, start = [], 0
    import hashlib
    for end in ends.tolist():
        out.append(int.from_bytes(hashlib.blake2b(hashes[start:end].tobytes(), digest_size=8)
                                  .digest(), "little", signed=True))
        start = end
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(len(_XOR), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            part = (shingles[at:at + 1024, None] ^ _XOR) * _ODD
            best = np.minimum(best, part.min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key (hash of the text as it is), n_shingles, node (null without words),
    sig."""
    def run(batches):
        for part in text_slices(batches):
            texts = part.column(1).to_pylist()
            sets = shingle_sets(texts, width)
            nodes = [s if len(x) else None for s, x in zip(sequence_ids(texts), sets)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(0), "text_key": part.column(2),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array(nodes, pa.int64()),
                "sig": pa.array([signature(s).tobytes() if len(s) else None for s in sets],
                                pa.binary())})
    keyed = documents(docs).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, n_shingles long, node long, sig binary")


def forest(classes: DataFrame) -> DataFrame:
    """node -> one row per tree: region (first DEPTH values), d2 and d4 (first 2 and 4 times
    DEPTH values of the tree's order)."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(0).to_numpy()
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(
                len(node), -1).astype(np.uint64)
            for t in range(TREES):
                order = np.roll(sig, -t * DEPTH, axis=1)
                keys, acc = [], np.full(len(node), np.uint64(t + 1))
                with np.errstate(over="ignore"):
                    for k in range(4 * DEPTH):
                        acc = mix(acc * _STEP[0] + order[:, k])
                        if k + 1 in (DEPTH, 2 * DEPTH, 4 * DEPTH):
                            keys.append(acc.view(np.int64))
                yield pa.RecordBatch.from_pydict({"region": keys[0], "d2": keys[1], "d4": keys[2],
                                                  "node": node})
    return classes.select("node", "sig").mapInArrow(run, "region long, d2 long, d4 long, node long")


def neighbours(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a < b: neighbours in the sorted order of every region, or of the
    part of it at the depth where it is small enough; and the parts' first members among
    themselves."""
    hot = members.where(F.col("n") > REGION)
    n2 = hot.groupBy("region", "d2").agg(F.count(F.lit(1)).alias("n2")).select(
        F.col("region").alias("r2"), F.col("d2").alias("k2"), "n2")
    n4 = hot.groupBy("region", "d4").agg(F.count(F.lit(1)).alias("n4")).select(
        F.col("region").alias("r4"), F.col("d4").alias("k4"), "n4")
    deep = hot.join(n2, (F.col("region") == F.col("r2")) & (F.col("d2") == F.col("k2"))).join(
        n4, (F.col("region") == F.col("r4")) & (F.col("d4") == F.col("k4")))
    same = F.pmod(F.xxhash64("node"), F.ceil(F.col("n4") / REGION))
    part = F.when(F.col("n2") <= REGION, F.xxhash64("d2")).otherwise(F.xxhash64("d4", same))
    cells = members.where(F.col("n") <= REGION).select(
        "region", F.lit(0).cast("long").alias("part"), "d2", "d4", "node").unionByName(
        deep.select("region", part.alias("part"), "d2", "d4", "node"))
    order = Window.partitionBy("region", "part").orderBy("d2", "d4", "node")
    pairs = cells.select(F.lag("node").over(order).alias("a"), F.col("node").alias("b"))
    heads = deep.select("region", part.alias("part"), "node").groupBy("region", "part").agg(
        F.min("node").alias("head"))
    first = heads.groupBy("region").agg(F.min("head").alias("top")).select(
        F.col("region").alias("r"), "top")
    pairs = pairs.unionByName(heads.join(first, F.col("region") == F.col("r")).select(
        F.col("top").alias("a"), F.col("head").alias("b")))
    return pairs.where("a is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))

    def run(batches):
        for batch in batches:
            a, b, sa, sb = batch.columns
            ok = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64),
                         percent) for x, y in zip(sa, sb)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(
                pa.array(ok, pa.bool_()))

    size = lambda c: F.octet_length(c)
    both = pairs.join(left, "a").join(right, "b").where(
        (100 * F.least(size("set_a"), size("set_b"))
         >= percent * F.greatest(size("set_a"), size("set_b"))))
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def set_table(docs: DataFrame, nodes: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """node, set for the given nodes, from the text of the class's first document."""
    wanted = classes.join(nodes, "node", "left_semi").select(F.col("first").alias("doc_id")).distinct()
    texts = documents(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).join(
        wanted, "doc_id", "left_semi")

    def run(batches):
        for _, texts_ in slices(batches):
            sets = shingle_sets(texts_, width)
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(sequence_ids(texts_), pa.int64()),
                "set": pa.array([s.tobytes() for s in sets], pa.binary())})

    found = texts.mapInArrow(run, "node long, set binary")
    # rows that repeat a doc_id give a set twice, or one that nobody asked for
    return cut(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def cross_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one region that are in different components. The members
    of a region's largest component need no comparison among themselves: they are dealt to blocks, the others
    to blocks of their own, and every pair of blocks with an outsider in it is compared (pairs
    from different components only) and gives a spanning set of links."""
    sizes = members.groupBy("region", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("region").agg(
        F.max_by("label", F.struct("m", "label")).alias("_label"), F.max("m").alias("most"),
        F.sum("m").alias("all")).withColumnRenamed("region", "_region")
    marked = members.select("region", "node", "label").join(
        largest, F.col("region") == F.col("_region")).withColumn("major", F.col("label") == F.col("_label"))
    blocks = lambda n: F.ceil(n / REGION).cast("int")
    slot = lambda n: F.pmod(F.xxhash64("node", "region"), blocks(n)).cast("int")
    few = F.col("all") - F.col("most")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    major = marked.where("major").select(
        "region", "node", "label", slot(F.col("most")).alias("j"), each(few).alias("k")).select(
        "region", "node", "label", (-1 - F.col("k")).alias("i"), "j")
    minor = marked.where("not major")
    against = minor.select("region", "node", "label", (-1 - slot(few)).alias("i"),
                           each(F.col("most")).alias("j"))
    own = minor.withColumn("own", slot(few)).select(
        "region", "node", "label", "own", each(few).alias("other"))
    among = own.select("region", "node", "label", F.least("own", "other").alias("i"),
                       F.greatest("own", "other").alias("j"))
    rows = major.unionByName(against).unionByName(among).join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        parent = {x: x for x in t["label"]}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        sets_ = [np.frombuffer(s, np.uint64) for s in t["set"]]
        order = sorted(range(len(sets_)), key=lambda k: len(sets_[k]))
        a, b = [], []
        for p, x in enumerate(order):
            for y in order[p + 1:]:
                if percent * len(sets_[y]) > 100 * len(sets_[x]):
                    break
                rx, ry = root(t["label"][x]), root(t["label"][y])
                if rx != ry and linked(sets_[x], sets_[y], percent):
                    parent[rx] = ry
                    a.append(t["node"][x])
                    b.append(t["node"][y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("region", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, text_key."""
    base = signatures(docs, width).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    base = cut(base)
    classes = cut(base.where("node is not null").groupBy("node").agg(
        F.min("id").alias("first"), F.first("sig").alias("sig")))
    rows = forest(classes)
    shared = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(rows.join(shared, "region"))
    pairs = cut(neighbours(members))
    nodes = members.select("node").distinct()
    sets = set_table(docs, nodes, classes, width)
    edges = cut(confirm(pairs, sets, percent))
    labels = components(edges)

    # regions of three or more that still hold several components
    marked = members.where("n > 2").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    open_ = marked.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")
                                         ).where("lo <> hi").select("region")
    more = cut(cross_links(marked.join(open_, "region", "left_semi"), sets, percent).distinct())
    if not more.isEmpty():
        labels = components(edges.unionByName(more))

    named = classes.select("node", "first").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component"))
    owner = named.join(smallest, "label").select("node", "component")
    out = base.select("doc_id", "id", "text_key", "n_shingles", "node").join(owner, "node", "left")
    component = F.coalesce("component", "id")
    return out.select("doc_id", "n_shingles",
                      F.nullif(component, F.lit(NO_ID)).alias("component_id"),
                      (F.col("id") == component).alias("kept"), "text_key")


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns: of every group the document with the smallest doc_id; of rows that
    repeat doc_id and text one stays."""
    found = near_duplicates(docs, width, percent).where("kept").groupBy("doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("n"))
    kept = cut(found.withColumnsRenamed({"doc_id": "__doc", "text_key": "__key", "n": "__n"}))
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    first = docs.join(kept.drop("__n"), F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (
        key == F.col("__key")), "left_semi")
    if kept.where("__n > 1").isEmpty():
        return first
    return first.dropDuplicates(["doc_id", "text"])
