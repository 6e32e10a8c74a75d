"""Language-model scores by a hierarchical Pitman-Yor model, seated by Gibbs sampling.

A token is a word (A-Z lower-cased) or the end of a text. The model predicts a word from the whole
word before it (the end stands for "no word before"): one restaurant for each word that goes before. Their parents are
the endings of those words, two bytes and then one byte, and the root serves all words; below the root stands the
uniform distribution over the training vocabulary and one unknown word.

Dishes (words) are dealt out to owners by hash and carry all that is counted of them: one task seats a
word in all restaurants that serve it, and its tables become customers of the parents there and
then. What is global in a sweep, the number of tables of every restaurant, is taken from the sweep
before. There are at most 65,793 restaurants of endings, so their totals fit a small array on every task. Those of whole
words are as many as the vocabulary and stay distributed: every owner sends its tables by context to the owner of the
context, which adds them up and sends back the sums of the contexts asked for. A pair seen once has one table whatever is
drawn, so such tables are sent once, and in a sweep only the contexts of pairs seen twice or more travel.
Tables and lower probabilities are averaged over the sweeps after ``burn``; the probabilities of a restaurant add up to one
with these averages, too.

Seating draws the tables of a dish one customer after another; from the 64th customer on
customers come in groups of a sixteenth of those seated, with a binomial number of new tables,
so a word that fills a third of the corpus costs a few hundred draws.

Data flow: each partition is read in blocks of BLOCK_ROWS rows, packed and written; a block sends
its distinct (word, word before) cells, packed by word hash, to the tasks that own the words; the owners
send back what each pair itself weighs, what the parent gives for each word and ending, and for each word its count and the tables
of its restaurant (every context is a word of the block). The block's rows are unpacked again and summed. Words are known
by ids of 64 bits: their last two bytes, then 48 bits of hash. Sums per text are taken in double precision;
an owner's answers travel as 32-bit floats.

Null texts are empty: one token, the end. Repeated rows are scored, and counted, one by one.
With no training text all counts are zero, and the base score of an empty model is 0. Blocks are
made in one scan of ``docs`` and written packed; both the cells and the sums are taken from there,
so a block holds the same rows both times.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcel.llm.common import cut, documents, shuffles_released
from parcel.llm.hashing import _SPACE, words_of
from parcel.session import ensure_checkpoint_dir
from parcel.sources.store import delete

BLOCK_BITS = 12              # rows of a block: 4096
PACK_LEVEL = 6
CELLS_PER_TASK = 2_000_000   # cells that one owner task is meant to hold
SWEEPS, BURN = 4, 1
WAVES = 4                    # groups of owners that answer one after another
STRENGTH = 1.0
HASH_BITS = np.uint64(48)
END = np.uint64(0x5851F42D4C95)       # id of the end token, and of "no word before"; its ending is 0
STATES = 1 << 16


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def pairs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before it, end of each text's tokens) of all tokens, ends included."""
    hashes, ends, starts, raw = words_of(texts)
    n = len(hashes)
    # last two bytes of each word; a word of one byte has 0 in front
    if n:
        space = np.flatnonzero(_SPACE[raw])
        stop = space[np.searchsorted(space, starts)]      # first separator after the start
        last = raw[stop - 1].astype(np.uint64)
        before = np.where(stop - starts > 1, raw[np.maximum(stop - 2, 0)], 0).astype(np.uint64)
        hashes = ((before * np.uint64(256) + last) << HASH_BITS) | (hashes >> (np.uint64(64) - HASH_BITS))
    texts_n = len(ends)
    where = ends + np.arange(texts_n)                     # places of the end tokens
    word = np.empty(n + texts_n, np.uint64)
    is_end = np.zeros(len(word), bool)
    is_end[where] = True
    word[is_end], word[~is_end] = END, hashes
    context = np.empty_like(word)
    context[0:1], context[1:] = END, word[:-1]
    return word, context, where + 1


def ending(context: np.ndarray) -> np.ndarray:
    """Restaurant of the last two bytes; 0 for no word before."""
    return (context >> HASH_BITS).astype(np.uint32)


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, ending before it, end of each text's tokens) of all tokens, ends included."""
    word, context, ends = pairs_of(texts)
    return word, ending(context), ends


def owner_of(word: np.ndarray, owners: int) -> np.ndarray:
    return ((word >> np.uint64(20)) % np.uint64(owners)).astype(np.int32)


def parent_state(state: np.ndarray) -> np.ndarray:
    """Restaurant of the last byte alone."""
    return state & np.uint32(255)


class Cells:
    """Distinct (word, word before) pairs of a block's tokens, in the order of (owner, word, word before)."""

    def __init__(self, word: np.ndarray, owners: int):
        self.names, at = np.unique(word, return_inverse=True)
        n = len(self.names)
        owner = owner_of(self.names, owners)
        self.by = np.argsort(owner, kind="stable")            # words by owner
        rank = np.empty(n, np.int64)
        rank[self.by] = np.arange(n)
        before = np.empty(len(at), np.int64)
        before[0:1], before[1:] = np.searchsorted(self.names, END), at[:-1]
        keys, self.of_token = np.unique(rank[at] * n + before, return_inverse=True)
        self.at, self.before = (self.by[keys // n], keys % n) if n else (keys, keys)     # places in names
        self.word, self.context, self.owner = self.names[self.at], self.names[self.before], owner[self.at]

    def by_owner(self):
        """(owner, first cell, end of cells)."""
        if not len(self.word):
            return
        cuts = np.flatnonzero(self.owner[1:] != self.owner[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.word)]):
            yield int(self.owner[a]), a, b


KINDS = (np.uint64, np.float32, np.uint16, np.uint32)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each behind its type and length, compressed. Signed numbers under 255
    take a byte; larger ones follow in full. Other types are kept as they are."""
    out = []
    for x in arrays:
        if x.dtype in KINDS:
            planes = x.view(np.uint8).reshape(len(x), x.itemsize).T          # like bytes together
            out += [np.array([KINDS.index(x.dtype), len(x)], "<i8").tobytes(), planes.tobytes()]
        else:
            big = x[x >= 255].astype("<i8")
            out += [np.array([len(KINDS), len(x), len(big)], "<i8").tobytes(),
                    np.minimum(x, 255).astype(np.uint8).tobytes(), big.tobytes()]
    body = b"".join(out)
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(body, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    body = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    out, at = [], 0
    while at < len(body):
        kind, n = np.frombuffer(body, "<i8", 2, at).tolist()
        at += 16
        if kind < len(KINDS):
            width = np.dtype(KINDS[kind]).itemsize
            planes = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n)
            out.append(np.ascontiguousarray(planes.T).view(KINDS[kind]).reshape(n))
            at += n * width
        else:
            many = int(np.frombuffer(body, "<i8", 1, at)[0])
            x = np.frombuffer(body, np.uint8, n, at + 8).astype(np.int64)
            x[x == 255] = np.frombuffer(body, "<i8", many, at + 8 + n)
            out.append(x)
            at += 8 + n + 8 * many
    return out


def changes(*columns: np.ndarray) -> np.ndarray:
    """True for the first of every run of equal rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def pack_cells(word: np.ndarray, context: np.ndarray, count: np.ndarray) -> bytes:
    """Cells in the order of (word, context): the words, and grouped by context which words, and counts."""
    new = changes(word)
    which = np.cumsum(new) - 1
    order = np.argsort(context, kind="stable")
    context = context[order]
    first = changes(context)
    per = np.diff(np.append(np.flatnonzero(first), len(word)))
    small = np.uint16 if new.sum() < 1 << 16 else np.uint32
    return pack(word[new], context[first], per, which[order].astype(small), count[order])


def unpack_cells(blob: bytes, ordered: bool = True):
    words, contexts, per, which, count = unpack(blob)
    context = np.repeat(contexts, per)
    if ordered:
        order = np.argsort(which, kind="stable")
        which, context, count = which[order], context[order], count[order]
    return words[which], context, count


def packed_blocks(docs: DataFrame) -> DataFrame:
    """block, rows: the rows of every block as one compressed value."""
    def run(batches):
        for block, ids, texts, train in blocks(batches):
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()),
                "rows": pa.array([pack_rows(ids, texts, train)], pa.binary())})

    return rows_with_blocks(docs).mapInArrow(run, "block long, rows binary")


def pack_rows(ids: list, texts: list[str], train: list[bool]) -> bytes:
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string()),
                      "train": pa.array(train, pa.bool_())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(
            compression=pa.Codec("zstd", PACK_LEVEL))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_rows(blob: bytes) -> tuple[list, list[str], list[bool]]:
    """doc_ids, texts, train."""
    table = pa.ipc.open_stream(blob).read_all()
    return tuple(table.column(c).to_pylist() for c in ("doc_id", "text", "train"))


def block_cells(packed: DataFrame, owners: int) -> DataFrame:
    """owner, block, cells of every block; counts are those of training texts only."""
    def each(batches):
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1)):
                yield block, *unpack_rows(blob.as_py())

    def run(batches):
        for block, _, texts, train in each(batches):
            word, _, ends = pairs_of(texts)
            cells = Cells(word, owners)
            train = np.repeat(np.array(train, bool), np.diff(np.append(0, ends)))
            count = np.bincount(cells.of_token[train], minlength=len(cells.word))
            got = [(o, pack_cells(cells.word[a:b], cells.context[a:b], count[a:b]))
                   for o, a, b in cells.by_owner()]
            yield pa.RecordBatch.from_pydict({
                "owner": pa.array([g[0] for g in got], pa.int32()),
                "block": pa.array([block] * len(got), pa.int64()),
                "cells": pa.array([g[1] for g in got], pa.binary())})

    return packed.mapInArrow(run, "owner int, block long, cells binary")


def rows_with_blocks(docs: DataFrame) -> DataFrame:
    text = documents(docs)
    return text.select(F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"),
                       "doc_id", "text", (~held_out(F.col("doc_id"))).alias("train"))


def blocks(batches):
    """(block, doc_ids, texts, train) for each run of rows with one block number."""
    now, rows = None, ([], [], [])
    for b in batches:
        number = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for a, z in zip(cuts, cuts[1:]):
            if z == a:
                continue
            if now is not None and number[a] != now:
                yield now, *rows
                rows = ([], [], [])
            now = int(number[a])
            for k in range(3):
                rows[k].extend(b.column(k + 1).slice(a, z - a).to_pylist())
    if now is not None:
        yield now, *rows


def merge_cells(blobs: list[bytes]):
    """Sum of cells: word, context, count sorted by (word, context), training cells only."""
    parts = []
    for b in blobs:
        word, context, count = unpack_cells(b, ordered=False)
        keep = count > 0
        parts.append((word[keep], context[keep], count[keep]))
    word, context, count = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((context, word))
    word, context, count = word[order], context[order], count[order]
    if not len(word):
        return word, context, count
    new = changes(word, context)
    return word[new], context[new], np.add.reduceat(count, np.flatnonzero(new))


def seat(customers: np.ndarray, p_parent: np.ndarray, tables_all: np.ndarray, discount: float,
         rng: np.random.Generator) -> np.ndarray:
    """Tables drawn for each dish: with i customers at t tables, the next one opens a table with
    odds (strength + discount * tables of the restaurant) * p_parent to (i - discount * t)."""
    tables = np.minimum(customers, 1).astype(np.int64)
    order = np.argsort(-customers, kind="stable")
    left = customers[order]
    t = tables[order]
    opening = ((STRENGTH + discount * tables_all) * p_parent)[order]
    seated = 1
    while True:
        group = max(1, seated // 16) if seated >= 64 else 1
        n = int(np.searchsorted(-left, -seated, side="left"))    # dishes with more customers
        if not n:
            break
        size = np.minimum(group, left[:n] - seated)
        chance = opening[:n] / (opening[:n] + np.maximum(seated - discount * t[:n], 1e-9))
        if group == 1:
            t[:n] += rng.random(n) < chance
        else:
            t[:n] += rng.binomial(size, np.minimum(chance, 1))
        seated += group
    tables[order] = t
    return tables


def group_sum(values: np.ndarray, group_starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, group_starts) if len(values) else values


class Restaurants:
    """One owner's words in the restaurants of endings: cells of two bytes, of one byte, and the root."""

    def __init__(self, word, state, count):
        self.word, self.state, self.count = word, state, count
        n = len(word)
        up = parent_state(state)
        self.mid_order = np.lexsort((up, word))
        w, u = word[self.mid_order], up[self.mid_order]
        new = np.ones(n, bool)
        new[1:] = (w[1:] != w[:-1]) | (u[1:] != u[:-1])
        self.mid_starts = np.flatnonzero(new)
        self.mid_word, self.mid_state = w[new], u[new]
        self.mid_of = np.empty(n, np.int64)
        self.mid_of[self.mid_order] = np.cumsum(new) - 1
        first = np.ones(len(self.mid_word), bool)
        first[1:] = self.mid_word[1:] != self.mid_word[:-1]
        self.root_starts = np.flatnonzero(first)
        self.root_word = self.mid_word[first]
        self.root_of = np.cumsum(first) - 1
        self.words_count = np.bincount(self.root_of[self.mid_of], weights=count,
                                       minlength=len(self.root_word)) if n else np.zeros(0)

    def customers(self, t2: np.ndarray, t1: np.ndarray):
        c1 = group_sum(t2[self.mid_order], self.mid_starts)
        return c1, group_sum(t1, self.root_starts)

    def probabilities(self, t2, t1, t0, g: dict):
        """(p0 per word, p1 per middle cell, p2 per cell). g: totals and discounts."""
        d2, d1, d0 = g["d"]
        c1, c0 = self.customers(t2, t1)
        p0 = (np.maximum(c0 - d0 * t0, 0) + (STRENGTH + d0 * g["T0"]) * g["base"]) / (STRENGTH + g["C0"])
        u = self.mid_state
        p1 = (np.maximum(c1 - d1 * t1, 0) + (STRENGTH + d1 * g["T1"][u]) * p0[self.root_of]) / (
            STRENGTH + g["C1"][u])
        s = self.state
        p2 = (np.maximum(self.count - d2 * t2, 0) + (STRENGTH + d2 * g["T2"][s]) * p1[self.mid_of]) / (
            STRENGTH + g["C2"][s])
        return p0, p1, p2

    def sweep(self, t2, t1, t0, g: dict, rng):
        """New tables of every level, given the other levels."""
        d2, d1, d0 = g["d"]
        p0, p1, _ = self.probabilities(t2, t1, t0, g)
        t2 = seat(self.count, p1[self.mid_of], g["T2"][self.state], d2, rng)
        c1, _ = self.customers(t2, t1)
        t1 = seat(c1, p0[self.root_of], g["T1"][self.mid_state], d1, rng)
        _, c0 = self.customers(t2, t1)
        t0 = seat(c0, np.full(len(c0), g["base"]), np.full(len(c0), float(g["T0"])), d0, rng)
        return t2, t1, t0


class Contexts:
    """One owner's words in the restaurants of whole words (sorted by word and context), and ``below`` in
    those of the endings, whose customers are the tables above."""

    def __init__(self, word, context, count):
        self.word, self.context, self.count = word, context, count
        state = ending(context)
        new = changes(word, state)
        self.starts = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.below = Restaurants(word[new], state[new], group_sum(count, self.starts))
        self.open = np.flatnonzero(count > 1)       # a pair seen once has one table
        self.asked, self.asked_at = np.unique(context[self.open], return_inverse=True)

    def start(self):
        """One table a dish in every restaurant."""
        return self.seated(np.ones(len(self.open), np.int64), *start_tables(self.below))

    def seated(self, t3, t2, t1, t0):
        """These tables (t3 of the open cells only), with the customers that they mean."""
        full = np.ones(len(self.word), np.int64)
        full[self.open] = t3
        self.below.count = group_sum(full, self.starts)
        return t3, t2, t1, t0

    def sweep(self, tables, asked_tables, g: dict, rng):
        """New tables of every level; ``asked_tables`` are all tables of the contexts in ``asked``."""
        t3, *lower = tables
        if len(self.open):
            p2 = self.below.probabilities(*lower, g)[2]
            t3 = seat(self.count[self.open], p2[self.of[self.open]], asked_tables[self.asked_at], g["d3"], rng)
        self.seated(t3, *lower)
        return t3, *self.below.sweep(*lower, g, rng)

    def open_tables(self, t3) -> np.ndarray:
        """Tables of the open cells by context, in the order of ``asked``."""
        return np.bincount(self.asked_at, weights=t3, minlength=len(self.asked)).astype(np.int64)


def start_tables(kept: Restaurants):
    """One table a dish in every restaurant."""
    t2 = np.minimum(kept.count, 1)
    return t2, np.ones(len(kept.mid_word), np.int64), np.ones(len(kept.root_word), np.int64)


LEVELS = "level int, state int, customers long, tables long"


def totals(kept: Restaurants, t2, t1, t0) -> pa.Table:
    """Customers and tables of every restaurant, as far as these words go."""
    c1, c0 = kept.customers(t2, t1)
    rows = []
    for level, state, c, t in ((2, kept.state, kept.count, t2), (1, kept.mid_state, c1, t1),
                               (0, np.zeros(len(c0), np.uint32), c0, t0)):
        many = STATES if level == 2 else 256
        cs = np.bincount(state, weights=c, minlength=many).astype(np.int64)
        ts = np.bincount(state, weights=t, minlength=many).astype(np.int64)
        at = np.flatnonzero(cs)
        rows.append((np.full(len(at), level), at, cs[at], ts[at]))
    extra = [(3, 0, len(kept.root_word), int(kept.words_count.sum()))]     # vocabulary, tokens
    for level, c in ((5, kept.count), (6, c1), (7, c0)):                   # ones and twos
        extra.append((level, 0, int((c == 1).sum()), int((c == 2).sum())))
    rows.append(tuple(np.array([e[k] for e in extra]) for k in range(4)))
    return pa.table({n: pa.array(np.concatenate([r[k] for r in rows]).astype(np.int64)).cast(kind)
                     for k, (n, kind) in enumerate((("level", pa.int32()), ("state", pa.int32()),
                                                    ("customers", pa.int64()), ("tables", pa.int64())))})


def gather_totals(levels: DataFrame) -> dict:
    """Arrays of the restaurants of endings (65,793 rows at most)."""
    rows = levels.groupBy("level", "state").agg(F.sum("customers"), F.sum("tables")).collect()
    g = {"d3": 0.5, "T2": np.zeros(STATES), "C2": np.zeros(STATES), "T1": np.zeros(256), "C1": np.zeros(256),
         "T0": 0.0, "C0": 0.0, "V": 0, "N": 0}
    ones = {5: (0, 0), 6: (0, 0), 7: (0, 0), 8: (0, 0)}
    for level, state, c, t in rows:
        if level in (1, 2):
            g[f"C{level}"][state], g[f"T{level}"][state] = c, t
        elif level == 0:
            g["C0"], g["T0"] = float(c), float(t)
        elif level == 3:
            g["V"], g["N"] = c, t
        else:
            ones[level] = (c, t)
    # the usual estimate of a discount from dishes ordered once and twice
    *g["d"], g["d3"] = [min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5 for a, b in
                        (ones[5], ones[6], ones[7], ones[8])]
    g["base"] = 1.0 / (g["V"] + 1)
    return g


def _rng(owner: int, sweep: int) -> np.random.Generator:
    return np.random.default_rng([20240229, owner, sweep])


# What owners write and send: ``kind`` says what a packet holds, ``part`` whom it is from.
PACKETS = "owner int, part int, kind int, packet binary, " + LEVELS
TABLES, NAMES, CLOSED, OPEN, REPLY, EVERY, SUMS, CELLS = range(8)


def packets(rows: list[tuple]) -> pa.Table:
    """Table of PACKETS from (owner, part, kind, packet)."""
    owner, part, kind, blob = zip(*rows) if rows else ((),) * 4
    n = len(rows)
    return pa.table({"owner": pa.array(owner, pa.int32()), "part": pa.array(part, pa.int32()),
                     "kind": pa.array(kind, pa.int32()), "packet": pa.array(blob, pa.binary()),
                     "level": pa.nulls(n, pa.int32()), "state": pa.nulls(n, pa.int32()),
                     "customers": pa.nulls(n, pa.int64()), "tables": pa.nulls(n, pa.int64())})


def to_owners(owner: int, kind: int, context: np.ndarray, owners: int, *values: np.ndarray) -> list[tuple]:
    """Packets of ``values`` to the owners of the contexts, contexts ascending in each."""
    to = owner_of(context, owners)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    return [(int(to[at[0]]), owner, kind, pack(*(v[at] for v in values)))
            for at in np.split(order, cuts) if len(at)]


def written(kept: Contexts, tables, owner: int, owners: int, first: bool) -> pa.Table:
    """PACKETS of an owner after a sweep: its tables, those of open cells by context, and the totals of
    endings; the first time also the contexts that it asks for and the tables of the other cells."""
    rows = [(owner, owner, TABLES, pack(*tables)),
            *to_owners(owner, OPEN, kept.asked, owners, kept.open_tables(tables[0]))]
    if first:
        names, n = np.unique(kept.context[kept.count == 1], return_counts=True)
        rows += to_owners(owner, NAMES, kept.asked, owners, kept.asked)
        rows += to_owners(owner, CLOSED, names, owners, names, n.astype(np.int64))
    levels = totals(kept.below, *tables[1:])
    n = kept.count
    more = pa.table({k: pa.array([v], levels.schema.field(k).type) for k, v in (
        ("level", 8), ("state", 0), ("customers", int((n == 1).sum())), ("tables", int((n == 2).sum())))})
    return pa.concat_tables([packets(rows), pa.concat_tables([levels, more])], promote_options="default")


def owner_tables(cells: DataFrame) -> DataFrame:
    """owner, cells: the training cells of each owner."""
    def run(table: pa.Table) -> pa.Table:
        blob = pack_cells(*merge_cells(table.column("cells").to_pylist()))
        return pa.table({"owner": table.column("owner").slice(0, 1), "cells": pa.array([blob], pa.binary())})

    return cells.groupBy("owner").applyInArrow(run, "owner int, cells binary")


def context_sums(sent: DataFrame, first: DataFrame) -> DataFrame:
    """PACKETS of the owners of contexts: replies to the owners that sent OPEN tables, in their order, and
    SUMS of all tables of all contexts, ascending (EVERY, in the first round only, says which). NAMES and
    CLOSED are those of the ``first`` round."""
    named = sent is first

    def run(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        names, values, ids, shares = {}, {}, [], []
        for part, kind, blob in zip(*(table.column(c).to_pylist() for c in ("part", "kind", "packet"))):
            if kind == CLOSED:
                for x, y in zip((ids, shares), unpack(blob)):
                    x.append(y)
            else:
                (names if kind == NAMES else values)[part] = unpack(blob)[0]
        for part in names:
            ids.append(names[part])
            shares.append(values[part])
        every, at = np.unique(np.concatenate(ids), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(shares), minlength=len(every)).astype(np.int64)
        rows = [(part, owner, REPLY, pack(total[np.searchsorted(every, names[part])])) for part in names]
        if named:
            rows.append((owner, owner, EVERY, pack(every)))
        return packets([*rows, (owner, owner, SUMS, pack(total))])

    return sent.where(F.col("kind") == OPEN).unionByName(first.where(F.col("kind").isin(NAMES, CLOSED))).groupBy(
        "owner").applyInArrow(run, PACKETS)


def _rng(owner: int, sweep: int) -> np.random.Generator:
    return np.random.default_rng([20240229, owner, sweep])


def asked_tables(kept: Contexts, replies: dict[int, np.ndarray], owners: int) -> np.ndarray:
    """Replies of the owners of contexts (by owner) in the order of ``asked``."""
    to = owner_of(kept.asked, owners)
    out = np.zeros(len(to))
    for part, values in replies.items():
        out[to == part] = values
    return out


def swept(owner_df: DataFrame, own: DataFrame, owners: int, g: dict, sweep: int) -> DataFrame:
    """PACKETS of all owners after one more sweep, from their TABLES and the replies to them."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        owner = left.column("owner")[0].as_py()
        kept = Contexts(*unpack_cells(left.column("cells")[0].as_py()))
        tables, replies = None, {}
        for part, kind, blob in zip(*(right.column(c).to_pylist() for c in ("part", "kind", "packet"))):
            if kind == TABLES:
                tables = kept.seated(*unpack(blob))
            else:
                replies[part] = unpack(blob)[0]
        tables = kept.sweep(tables, asked_tables(kept, replies, owners), g, _rng(owner, sweep))
        return written(kept, tables, owner, owners, False).combine_chunks()

    return owner_df.groupBy("owner").cogroup(own.groupBy("owner")).applyInArrow(run, PACKETS)


def train(owner_df: DataFrame, owners: int, sweeps: int = SWEEPS, burn: int = BURN):
    """PACKETS with EVERY context, and after each sweep but the first ``burn`` (the last one in any case):
    (totals of endings, PACKETS with each owner's TABLES, PACKETS with SUMS)."""
    def begin(batches):
        for b in batches:
            for owner, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kept = Contexts(*unpack_cells(blob))
                yield from written(kept, kept.start(), owner, owners, True).combine_chunks().to_batches()

    now = cut(owner_df.mapInArrow(begin, PACKETS))
    first, rounds, every = now, [], None
    for k in range(sweeps + 1):
        g = gather_totals(now.where("level is not null").select("level", "state", "customers", "tables"))
        sums = cut(context_sums(now, first))
        if every is None:
            every = sums.where(F.col("kind") == EVERY)
        if k > burn or k == sweeps:
            rounds.append((g, now, sums))
        if k == sweeps:
            return every, rounds

        own = now.where(F.col("kind") == TABLES).unionByName(sums.where(F.col("kind") == REPLY))
        now = cut(swept(owner_df, own, owners, g, k))


class Places:
    """Places of pairs (a, b) in sorted distinct pairs."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = np.unique(a), np.unique(b)
        self.key = np.searchsorted(self.a, a) * len(self.b) + np.searchsorted(self.b, b)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each (a, b), or -1."""
        if not len(self.key):
            return np.full(len(a), -1)
        at, bt = place(self.a, a), place(self.b, b)
        want = np.maximum(at, 0) * len(self.b) + np.maximum(bt, 0)
        return np.where((at >= 0) & (bt >= 0), place(self.key, want), -1)


def place(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each of ``x`` in distinct sorted values, or -1."""
    if not len(ordered):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return np.where(ordered[at] == x, at, -1)


class Lexicon:
    """An owner's part of the model, averaged over rounds of (totals, tables)."""

    def __init__(self, kept: Contexts, rounds: list[tuple], every: np.ndarray, sums: list[np.ndarray]):
        self.kept, n = kept, len(rounds)
        total, self.below = 0, []
        for g, tables in rounds:
            kept.seated(*tables)
            total = total + tables[0]
            self.below.append((*kept.below.probabilities(*tables[1:], g), *unseen(g)))
        own = np.ones(len(kept.word))
        own[kept.open] = total / n
        self.weight = kept.count - rounds[-1][0]["d3"] * own
        self.pairs = Places(kept.word, kept.context)
        self.two = Places(kept.below.word, kept.below.state)
        self.one = Places(kept.below.mid_word, kept.below.mid_state)
        self.names, self.tables = every, sum(sums) / n if sums else np.zeros(0)

    def of_cells(self, word: np.ndarray, context: np.ndarray):
        """(weight of the pair itself for each cell, probability that the parent gives for each word and ending)."""
        k = self.pairs.find(word, context)
        own = chosen(self.weight, k, np.zeros(len(word)))
        state = ending(context)
        new = changes(word, state)
        word, state = word[new], state[new]
        up = parent_state(state)
        k0 = place(self.kept.below.root_word, word)
        k1, k2 = self.one.find(word, up), self.two.find(word, state)
        parent = np.zeros(len(word))
        for p0, p1, p2, u0, u1, u2 in self.below:
            p = chosen(p0, k0, np.full(len(word), u0))
            p = chosen(p1, k1, u1[up] * p)
            parent += chosen(p2, k2, u2[state] * p) / len(self.below)
        return own, parent

    def of_words(self, word: np.ndarray):
        """(training count, tables of the restaurant of the word)."""
        k, at = place(self.kept.below.root_word, word), place(self.names, word)
        none = np.zeros(len(word))
        return chosen(self.kept.below.words_count, k, none).astype(np.int64), chosen(self.tables, at, none)


def chosen(values: np.ndarray, at: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """``values`` at these places, the other one where a place is -1."""
    return np.where(at >= 0, values[at], otherwise) if len(values) else otherwise


def unseen(g: dict):
    """Probability of the unknown word at the root, and what restaurants leave to their parents."""
    d2, d1, d0 = g["d"]
    return ((STRENGTH + d0 * g["T0"]) * g["base"] / (STRENGTH + g["C0"]),
            (STRENGTH + d1 * g["T1"]) / (STRENGTH + g["C1"]), (STRENGTH + d2 * g["T2"]) / (STRENGTH + g["C2"]))


def answers(owner_df: DataFrame, cells: DataFrame, every: DataFrame, rounds: list[tuple]) -> DataFrame:
    """block, owner, answer: for the block's cells of that owner what ``Lexicon`` gives of cells and words."""
    gs = [r[0] for r in rounds]
    told = every.select("owner", F.lit(0).cast("long").alias("block"), "kind", F.col("packet").alias("cells"))
    for k, (_, now, sums) in enumerate(rounds):
        part = now.where(F.col("kind") == TABLES).unionByName(sums.where(F.col("kind") == SUMS)).select(
            "owner", F.lit(k).cast("long").alias("block"), "kind", F.col("packet").alias("cells"))
        told = told.unionByName(part)
    right_side = told.unionByName(cells.withColumn("kind", F.lit(CELLS)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.uint64)
        kept = Contexts(*(unpack_cells(left.column("cells")[0].as_py()) if left.num_rows
                          else (none, none, np.zeros(0, np.int64))))
        tables, names, sums, asked = {}, none, [], []
        for row, (block, kind) in enumerate(zip(right.column("block").to_pylist(), right.column("kind").to_pylist())):
            if kind == CELLS:
                asked.append((row, block))
            elif kind == TABLES:
                tables[block] = unpack(right.column("cells")[row].as_py())
            elif kind == EVERY:
                names = unpack(right.column("cells")[row].as_py())[0]
            else:
                sums.append(unpack(right.column("cells")[row].as_py())[0])
        lexicon = Lexicon(kept, [(g, tables.get(k, kept.start())) for k, g in enumerate(gs)], names, sums)
        out = []
        for row, _ in asked:
            word, context, _ = unpack_cells(right.column("cells")[row].as_py())
            own, parent = lexicon.of_cells(word, context)
            count, restaurant = lexicon.of_words(word[changes(word)])
            out.append(pack(own.astype(np.float32), parent.astype(np.float32), count,
                            restaurant.astype(np.float32)))
        owner = right.column("owner")[0].as_py() if asked else 0
        return pa.table({"block": pa.array([b for _, b in asked], pa.int64()),
                         "owner": pa.array([owner] * len(asked), pa.int32()), "answer": pa.array(out, pa.binary())})

    return owner_df.groupBy("owner").cogroup(right_side.groupBy("owner")).applyInArrow(
        run, "block long, owner int, answer binary")


def block_scores(block: Cells, got: dict[int, bytes], d3: float) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of the model's probability, training count of the word) of a block's cells. The customers of a
    word's restaurant are as many as the word's count: one token follows every word."""
    if not len(block.word):
        return np.zeros(0), np.zeros(0)
    own, parent, count, tables = (np.concatenate(x).astype(float) for x in zip(
        *(unpack(got[o]) for o, _, _ in block.by_owner())))
    parent = parent[np.cumsum(changes(block.word, ending(block.context))) - 1]
    c, t = np.empty_like(count), np.empty_like(tables)
    c[block.by], t[block.by] = count, tables
    at = block.before                                      # every context is a word here
    return np.log10(np.maximum((own + (STRENGTH + d3 * t[at]) * parent) / (STRENGTH + c[at]), 1e-300)), c[block.at]


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written in the shared checkpoint folder, for tables that are deleted before the end."""
    with shuffles_released(df.sparkSession):
        df.select("*").write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def language_scores(docs: DataFrame, sweeps: int = SWEEPS, burn: int = BURN) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    size = documents(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = cut(packed_blocks(docs))
    owners = max(8, -(-size // (15 * CELLS_PER_TASK)))   # some fifteen bytes of text to a cell
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pitman_yor/{uuid.uuid4().hex}"
    cells = stored(block_cells(packed, owners), f"{folder}/cells")
    owner_df = stored(owner_tables(cells), f"{folder}/owners")
    every, rounds = train(owner_df, owners, sweeps, burn)
    found = None
    for wave in range(WAVES):            # a wave's shuffles go before the next one's are written
        those = [df.where(F.col("owner") % WAVES == wave) for df in (owner_df, cells, every)]
        part = cut(answers(*those, [(g, *(df.where(F.col("owner") % WAVES == wave) for df in told))
                                    for g, *told in rounds]))
        found = part if found is None else found.unionByName(part)
    delete(spark, folder)
    g = rounds[-1][0]
    n_all, v_all, d3 = int(g["N"]), int(g["V"]), g["d3"]
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts_, trained = unpack_rows(left.column("rows")[0].as_py())
        got = dict(zip(right.column("owner").to_pylist(), right.column("answer").to_pylist()))
        word, _, ends = pairs_of(texts_)
        block = Cells(word, owners)
        logs, count = block_scores(block, got, d3)
        base = np.log10((count + 1) / (n_all + v_all + 1))
        starts = np.append(0, ends[:-1])
        known, base, logs = (np.add.reduceat(x[block.of_token], starts)
                             for x in ((count > 0).astype(float), base, logs))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([not t for t in trained]),
            "n_tokens": pa.array(ends - starts, pa.int64()),
            "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(ids), n_all), pa.int64()),
            "base_score": pa.array(base), "score": pa.array(logs)})

    return packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)
