"""Centroid clustering by subvector dictionaries.

Vectors of integers are cut into blocks of neighbouring dimensions. Every block has a dictionary
of the distinct subvectors that occur in it, so a vector is a row of codes and nothing is lost.
A round computes the squared distance of every dictionary entry to every centroid's part once;
a vector's distance is the sum of those partial distances looked up by its codes, and a cluster's
sum is its histogram of codes times the entries. All arithmetic is on integers and exact.

One pass finds the entries of blocks of 4, 2 and 1 dimensions; a task forgets a block once it has
more than ``limit`` entries there. The widest blocks with at most ``limit`` entries in the whole
table are taken, so the dictionaries hold at most dims * limit entries whatever the table's size
(4 MB of integers here); they and the partial distances (k times as much) are the only things
broadcast. A single dimension with more than ``limit`` distinct values gets a dictionary in each
page of coded rows instead: the same sums, with entries that are not shared between pages. Rows
are never shuffled or grouped, so a vector that a third of all rows repeat costs nothing special;
a task holds one page of PAGE rows. The coded pages are checkpointed once and read every round.

Defined results: vectors that are null, hold a null or a non-finite component, or have another
number of components than ``dims`` take no part. Repeated rows count as often as they occur.
Equal start hashes (repeated vec_ids) go to the smaller vector first; a null vec_id comes after
all others. Fewer vectors than k give fewer centroids; an empty table gives an empty result. A
component of 2**27 or more in size after scaling stops the job: distances would not fit a long.
Sums that do not fit a long are null. Extra columns, whatever their names, are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcel.llm.common import cut

LIMIT = 8192          # entries of a shared dictionary; codes are 16 bits
WIDTHS = (4, 2, 1)    # dimensions of a block, widest first
PAGE = 8192           # rows of a page
NO_ID = -(1 << 63)
LONG = (1 << 63) - 1


@dataclass
class Block:
    """Dimensions first to last - 1; ``entries`` (count, width) or None: a dictionary per page."""
    first: int
    last: int
    entries: np.ndarray | None


def integer_vectors(vectors: DataFrame, scale: int, dims: int) -> DataFrame:
    """vec_id, v (array<bigint>) of the vectors that take part."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") == dims) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (
            F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    wide = F.exists("v", lambda x: (x >= 1 << 27) | (x <= -(1 << 27)))
    return vectors.select("vec_id", "embedding").where(ok).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).withColumn(
            "v", F.when(wide, F.raise_error(F.lit("a scaled component has 2**27 or more")))
            .otherwise(F.col("v")))


def start(vecs: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``."""
    first = vecs.withColumn("h", F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast(
        "string")), 256)).orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in first], np.int64)


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def packed(m: np.ndarray) -> np.ndarray:
    """Each row as one item of raw bytes."""
    return np.ascontiguousarray(m).view(np.dtype((np.void, 8 * m.shape[1]))).ravel()


def spans(dims: int, width: int) -> list[tuple[int, int]]:
    return [(a, min(a + width, dims)) for a in range(0, dims, width)]


def dictionaries(vecs: DataFrame, dims: int, limit: int = LIMIT) -> list[Block]:
    """The widest blocks whose distinct subvectors number ``limit`` at most."""
    candidates = [s for w in WIDTHS for s in spans(dims, w)]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, set | None] = {s: set() for s in candidates}
        for b in batches:
            m = matrix(b, dims)
            for (a, z), own in found.items():
                if own is not None:
                    own.update(x.tobytes() for x in np.unique(packed(m[:, a:z])))
                    if len(own) > limit:
                        found[a, z] = None
        for (a, z), own in found.items():
            own = [None] if own is None else list(own)
            yield pa.RecordBatch.from_arrays([pa.array([a] * len(own), pa.int32()), pa.array(
                [z] * len(own), pa.int32()), pa.array(own, pa.binary())], names=["a", "z", "entry"])

    table = cut(vecs.select("v").mapInArrow(entries, "a int, z int, entry binary").distinct())
    sizes = table.groupBy("a", "z").agg(F.count(F.lit(1)).alias("n"), F.bool_or(
        F.col("entry").isNull()).alias("over")).collect()
    fits = {(r["a"], r["z"]) for r in sizes if r["n"] <= limit and not r["over"]}
    chosen, at = [], 0
    while at < dims:
        for w in WIDTHS:
            span = (at, min(at + w, dims))
            if at % w == 0 and (span in fits or w == 1):
                break
        chosen.append(span)
        at = span[1]
    kept = table.where(F.struct("a", "z").isin([F.struct(F.lit(a), F.lit(z)) for a, z in
                                                chosen if (a, z) in fits])) if fits else table.limit(0)
    by: dict[tuple, list] = {}
    for r in kept.collect():      # at most dims * limit entries
        by.setdefault((r["a"], r["z"]), []).append(bytes(r["entry"]))
    return [Block(a, z, np.frombuffer(b"".join(sorted(by[a, z])), np.int64).reshape(-1, z - a)
                  if (a, z) in by else None) for a, z in chosen]


PAGE_SCHEMA = "ids binary, codes binary, own binary"


def encode(vecs: DataFrame, blocks: list[Block], dims: int) -> DataFrame:
    """Pages of coded rows: vec_ids, a 16-bit code per row and shared block, and the values of
    the dimensions without a shared dictionary."""
    sc = vecs.sparkSession.sparkContext
    shipped = sc.broadcast([(b.first, b.last, b.entries) for b in blocks])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [(a, z, None if e is None else {x.tobytes(): i for i, x in enumerate(packed(e))})
                 for a, z, e in shipped.value]
        for b in batches:
            ids = b.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            m = matrix(b, dims)
            for at in range(0, len(m), PAGE):
                page, columns, own = m[at:at + PAGE], [], []
                for a, z, book in books:
                    if book is None:
                        own.append(page[:, a])
                    else:
                        values, inverse = np.unique(packed(page[:, a:z]), return_inverse=True)
                        codes = np.array([book[x.tobytes()] for x in values], np.uint16)
                        columns.append(codes[inverse.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (
                    ids[at:at + PAGE].astype(np.int64).tobytes(),
                    b"".join(c.tobytes() for c in columns),
                    b"".join(np.ascontiguousarray(o, np.int64).tobytes() for o in own))],
                    names=["ids", "codes", "own"])

    return cut(vecs.mapInArrow(code, PAGE_SCHEMA))


def partial_distances(blocks: list[Block], centroids: np.ndarray) -> list[np.ndarray | None]:
    """Per block: squared distance of every entry to every centroid's part, (entries, k)."""
    return [None if b.entries is None else
            ((b.entries[:, None, :] - centroids[None, :, b.first:b.last]) ** 2).sum(axis=2)
            for b in blocks]


def decode(batch: pa.RecordBatch, blocks) -> Iterator[tuple[np.ndarray, list]]:
    """Per page: vec_ids and, per block, (codes, entries); entries None: the shared ones."""
    for ids, codes, own in zip(*(batch.column(c).to_pylist() for c in ("ids", "codes", "own"))):
        ids = np.frombuffer(ids, np.int64)
        shared = iter(np.frombuffer(codes, np.uint16).reshape(-1, len(ids)))
        alone = iter(np.frombuffer(own, np.int64).reshape(-1, len(ids)))
        page = []
        for _, _, entries in blocks:
            if entries is not None:
                page.append((next(shared), None))
            else:
                values, inverse = np.unique(next(alone), return_inverse=True)
                page.append((inverse, values[:, None]))
        yield ids, page


def distances(page: list, blocks, tables, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each row of a page to each centroid."""
    total = np.zeros((len(page[0][0]), len(centroids)), np.int64)
    for (codes, entries), (a, z, _), table in zip(page, blocks, tables):
        if entries is not None:
            table = ((entries[:, None, :] - centroids[None, :, a:z]) ** 2).sum(axis=2)
        total += table[codes]
    return total


def moved(pages: DataFrame, blocks: list[Block], centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the exact floor of each cluster's mean; an empty one stays."""
    sc = pages.sparkSession.sparkContext
    k, dims = centroids.shape
    shipped = sc.broadcast(([(b.first, b.last, b.entries) for b in blocks],
                            partial_distances(blocks, centroids), centroids))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, tables, centres = shipped.value
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for _, page in decode(b, layout):
                cluster = distances(page, layout, tables, centres).argmin(axis=1)
                count += np.bincount(cluster, minlength=k)
                for (codes, own), (a, z, entries) in zip(page, layout):
                    entries = entries if own is None else own
                    histogram = np.bincount(cluster * len(entries) + codes,
                                            minlength=k * len(entries)).reshape(k, -1)
                    total[:, a:z] += histogram @ entries
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (np.repeat(np.arange(k, dtype=np.int32), dims),
                                   np.tile(np.arange(dims, dtype=np.int32), k),
                                   total.ravel(), np.repeat(count, dims))],
            names=["cluster", "dim", "total", "rows"])

    found = pages.mapInArrow(sums, "cluster int, dim int, total long, rows long").groupBy(
        "cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
                              F.sum("rows").alias("rows")).collect()     # k * dims rows
    out = centroids.copy()
    for r in found:
        if r["rows"]:
            out[r["cluster"], r["dim"]] = int(r["total"]) // r["rows"]
    shipped.unpersist()
    return out


def assigned(pages: DataFrame, blocks: list[Block], centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every row."""
    shipped = pages.sparkSession.sparkContext.broadcast((
        [(b.first, b.last, b.entries) for b in blocks], partial_distances(blocks, centroids), centroids))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, tables, centres = shipped.value
        for b in batches:
            for ids, page in decode(b, layout):
                d = distances(page, layout, tables, centres)
                cluster = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == NO_ID), pa.array(cluster.astype(np.int32)),
                     pa.array(d[np.arange(len(d)), cluster])], names=["vec_id", "cluster", "distance"])

    return pages.mapInArrow(nearest, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64,
            seed: str = "3", limit: int = LIMIT) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids."""
    vecs = integer_vectors(vectors, scale, dims)
    centroids = start(vecs, k, seed)
    if not len(centroids):
        return vecs.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), \
            np.zeros((0, dims), np.int64)
    blocks = dictionaries(vecs, dims, limit)
    pages = encode(vecs, blocks, dims)
    for _ in range(rounds):
        now = moved(pages, blocks, centroids)
        if (now == centroids).all():     # every later round would repeat this one
            break
        centroids = now
    return assigned(pages, blocks, centroids), centroids


def clusters_with_inertia(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024,
                          dims: int = 64, seed: str = "3", limit: int = LIMIT) -> DataFrame:
    """``cluster``'s rows with cluster_inertia, inertia and the digest of the row's centroid."""
    rows, centroids = cluster(vectors, k, rounds, scale, dims, seed, limit)
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda x: F.lit(x if x <= LONG else None).cast("long")
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    own = lambda values: F.element_at(F.array(*values) if values else F.lit(None).cast(
        "array<string>"), F.col("cluster") + 1)
    return rows.select(
        "vec_id", "cluster", "distance",
        own([long(sums.get(c, 0)) for c in range(len(digest))]).cast("long").alias("cluster_inertia"),
        long(sum(sums.values())).alias("inertia"),
        own([F.lit(d) for d in digest]).alias("centroid_sha256"))
