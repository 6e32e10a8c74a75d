"""Exact top-k inner products by block-at-a-time pruning.

Vectors are turned into integers, ordered by their strongest component so that neighbours are
alike, and dealt out as ranges ("shards"); a shard is cut into blocks of BLOCK vectors with a
forward index (their matrix) and the smallest and largest value of every term (component). For
a query the sum of term maxima bounds every score of a block from above. Blocks are taken in
the order of their bounds, scored through the forward index, and left out once the bound falls
below the query's k-th score. Each query is first run against its own shard; the k-th score
found there goes with it to the other shards.

Queries are grouped, so a task holds one group and one shard, whatever the tables' size.

Vectors that are null or hold a null or a non-finite component take no part; a shorter vector
has zeros behind its end. Inner products must fit a long. Ties go to the smaller vec_id (null
first). Rows are told apart by position: rows repeating a vec_id are candidates of each other.
Fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcel.llm.common import cut

BLOCK = 64
SHARD_VALUES = 8192 * 64     # components of a shard
GROUP_QUERIES = 2048         # queries of a group
NO_ID = -(1 << 63)
NO_SCORE = -(1 << 63) + 1      # its negative is still a long
FOUND = "query_uid long, query_id long, uid long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """uid, vec_id, v (array<bigint>) of the vectors that take part."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(
        x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding").where(ok).select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


class Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NO_SCORE)
        self.vec_id = np.full((n, k), np.iinfo(np.int64).max)
        self.uid = np.full((n, k), -1)

    def add(self, row: int, score, vec_id, uid) -> None:
        s = np.append(self.score[row], score)
        i = np.append(self.vec_id[row], vec_id)
        u = np.append(self.uid[row], uid)
        top = np.lexsort((u, i, -s))[:self.k]
        self.score[row], self.vec_id[row], self.uid[row] = s[top], i[top], u[top]


def search(q, q_uid, floor_score, docs, doc_id, doc_uid, k: int, block: int = BLOCK) -> Best:
    """k best documents of each query among one shard's, as far as they reach floor_score.
    Blocks are runs of ``block`` rows of ``docs``."""
    kind = np.float64 if max(np.abs(q).max(initial=0), np.abs(docs).max(initial=0)) < (
        1 << 20) and q.shape[1] <= 4096 else np.int64       # exact either way
    q, docs = q.astype(kind), docs.astype(kind)
    starts = np.arange(0, len(docs), block)
    high, low = np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = Best(len(q), k)
    kth = floor_score.astype(kind) if kind is np.int64 else floor_score.astype(np.float64)
    active = np.arange(len(q))
    for step in range(len(starts)):
        at = order[active, step]
        going = bounds[active, at] >= kth[active]
        active, at = active[going], at[going]
        if not len(active):
            break
        for b in np.unique(at):
            rows = active[at == b]
            a, z = starts[b], min(starts[b] + block, len(docs))
            scores = q[rows] @ docs[a:z].T
            good = (scores >= kth[rows][:, None]) & (doc_uid[a:z][None, :] != q_uid[rows][:, None])
            for i in np.flatnonzero(good.any(axis=1)):
                keep, row = good[i], rows[i]
                best.add(row, scores[i][keep].astype(np.int64), doc_id[a:z][keep],
                         doc_uid[a:z][keep])
                kth[row] = max(kth[row], best.score[row, k - 1])
    return best


def found_rows(best: Best, q_id, q_uid) -> pa.RecordBatch:
    row, col = np.nonzero(best.uid >= 0)
    return _batch(FOUND, q_uid[row], q_id[row], best.uid[row, col], best.vec_id[row, col],
                  best.score[row, col])


def _batch(schema: str, *cols) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score for the queries: rows whose vec_id is divisible by
    ``query_every``."""
    vecs = integer_vectors(vectors, scale)
    n, dims = vecs.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dims = max(dims or 1, 1)
    per_shard = max(BLOCK, SHARD_VALUES // dims)
    shards = max(1, -(-n // per_shard))
    # the strongest component with its sign, then the value there: like vectors are neighbours
    strongest = F.array_max(F.transform("v", lambda x, i: F.struct(
        F.abs(x).alias("a"), i.alias("i"), x.alias("x"))))
    ordered = vecs.select("uid", "vec_id", "v", strongest.alias("m")).repartitionByRange(
        shards, F.col("m.i") * F.signum("m.x"), F.col("m.x"), "uid").select("uid", "vec_id", "v")

    shard_schema = "shard int, uids binary, ids binary, matrix binary"

    def build(batches: Iterator[pa.RecordBatch]):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        shard = TaskContext.get().partitionId()
        for part in range(0, t.num_rows, 4 * per_shard):    # a range may turn out larger
            p = t.slice(part, 4 * per_shard)
            lists = p.column(2).combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            m = np.zeros((p.num_rows, dims), np.int64)
            m[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
            yield _batch(shard_schema, [shard], [p.column(0).to_numpy().tobytes()],
                         [p.column(1).fill_null(NO_ID).to_numpy().tobytes()], [m.tobytes()])

    table = cut(ordered.mapInArrow(build, shard_schema))

    own_schema = FOUND + ", vector binary, kth long"

    def own(batches):
        """Queries of a shard against the shard: what was found, and once per query (uid null)
        the query with its k-th score."""
        for b in batches:
            for _, uids, ids, matrix in zip(*b.to_pydict().values()):
                uid, vid = np.frombuffer(uids, np.int64), np.frombuffer(ids, np.int64)
                m = np.frombuffer(matrix, np.int64).reshape(len(uid), dims)
                at = np.flatnonzero((vid % query_every == 0) & (vid != NO_ID))
                if not len(at):
                    continue
                best = search(m[at], uid[at], np.full(len(at), NO_SCORE), m, vid,
                              uid, k)
                f = found_rows(best, vid[at], uid[at])
                none = [None] * f.num_rows
                yield _batch(own_schema, *f.columns, none, none)
                empty = [None] * len(at)
                yield _batch(own_schema, uid[at], vid[at], empty, empty, empty,
                             [m[i].tobytes() for i in at], best.score[:, k - 1])

    near = cut(table.mapInArrow(own, own_schema))
    queries = near.where("uid is null").select("query_uid", "query_id", "vector", "kth")
    groups = max(1, -(-n // query_every // GROUP_QUERIES))
    packed = cut(queries.groupBy(F.pmod(F.xxhash64("query_uid"), F.lit(groups)).alias("g")).agg(
        F.collect_list(F.struct("query_uid", "query_id", "vector", "kth")).alias("q")))

    def cross(batches):
        for b in batches:
            for q, uids, ids, matrix in zip(*b.to_pydict().values()):
                uid, vid = np.frombuffer(uids, np.int64), np.frombuffer(ids, np.int64)
                m = np.frombuffer(matrix, np.int64).reshape(len(uid), dims)
                q_uid = np.array([x["query_uid"] for x in q], np.int64)
                far = ~np.isin(q_uid, uid)      # its own shard is done
                if not far.any():
                    continue
                q_id = np.array([x["query_id"] for x in q], np.int64)[far]
                kth = np.array([x["kth"] for x in q], np.int64)[far]
                qm = np.frombuffer(b"".join(x["vector"] for x in q), np.int64).reshape(
                    len(q), dims)[far]
                yield found_rows(search(qm, q_uid[far], kth, m, vid, uid, k), q_id, q_uid[far])

    last = table.agg(F.max("shard")).first()[0]
    cells = packed.select("q", F.explode(F.sequence(F.lit(0), F.lit(last or 0))).alias("_shard"))
    others = cells.join(table, F.col("_shard") == F.col("shard")).select(
        "q", "uids", "ids", "matrix").mapInArrow(cross, FOUND)
    both = near.where("uid is not null").select(others.columns).unionByName(others)
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(
        F.desc("score"), "vec_id", "uid"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
