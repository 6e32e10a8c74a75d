"""Exact quantiles of several columns: of the whole table, or of the training rows of every fold.

One job per level serves all columns, wanted ranks and folds. Each fold's rows are summarised
apart (counts below and inside a bracket, distinct values, a mergeable KLL sketch); a fold's training
rows are the other folds' summaries added up, so no row is copied or read twice. A bracket that holds few
distinct values is collected as (value, fold, count); a wider one shrinks to where the sketches put the
wanted ranks, and is widened again if exact counts show that they missed. A bracket that is still
wide after ``max_levels`` is finished by sorting its distinct values in ranges over the cluster
and collecting the one range in which a rank lies. A value that a third of all rows hold is one
pair. Nulls and NaN are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Hashable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcel.operators.ordered import SLICE, in_slices
from parcel.sources.store import scratch

COLLECT_LIMIT = 100_000     # (value, fold) pairs collected from one bracket
SKETCH_K = 4096             # rank error of a sketch: below 0.1 %
MAX_LEVELS = 6

Targets = dict[Hashable, list[int]]


@dataclass
class Bracket:
    """Where the wanted ranks of one column and probability lie: lo <= value <= hi."""
    column: int
    ranks: dict[Hashable, list[int]]                 # per target, 0-based among its rows
    lo: float = -math.inf
    hi: float = math.inf
    margin: float = 0.004
    held: dict = field(default_factory=dict)          # (target, rank) -> value, once known


def inside(b: Bracket) -> Column:
    v = F.col(f"c{b.column}")
    return (v >= F.lit(b.lo)) & (v <= F.lit(b.hi))


def summaries(rows: DataFrame, brackets: list[Bracket], sketch_k: int) -> dict:
    """One job: per bracket and fold (below, inside, distinct inside, sketch of the inside)."""
    aggs = []
    for j, b in enumerate(brackets):
        v, held = F.col(f"c{b.column}"), inside(b)
        own = F.when(held, v)
        aggs += [F.count_if(v < F.lit(b.lo)).alias(f"b{j}"), F.count_if(held).alias(f"i{j}"),
                 F.approx_count_distinct(own).alias(f"d{j}"),
                 F.kll_sketch_agg_double(own, F.lit(sketch_k)).alias(f"s{j}")]
    found = rows.groupBy("_part").agg(*aggs).collect()
    return {j: {r["_part"]: (r[f"b{j}"], r[f"i{j}"], r[f"d{j}"], r[f"s{j}"]) for r in found}
            for j in range(len(brackets))}


def narrowed(spark, brackets: list[Bracket], seen: list[dict], targets: Targets) -> None:
    """Shrink each bracket to the hull of its targets' ranks, by the merged sketches."""
    rows, wanted = [], {}
    for j, (b, parts) in enumerate(zip(brackets, seen)):
        for t, ranks in b.ranks.items():
            own = [p for p in targets[t] if p in parts and parts[p][1]]
            below = sum(parts[p][0] for p in targets[t] if p in parts)
            total = sum(parts[p][1] for p in own)
            shares = [(r - below) / max(total - 1, 1) for r in ranks]
            wanted[j, t] = (max(0.0, min(shares) - b.margin), min(1.0, max(shares) + b.margin))
            rows += [(j, repr(t), bytes(parts[p][3])) for p in own]
    merged = spark.createDataFrame(rows, "j int, t string, s binary").groupBy("j", "t").agg(
        F.kll_merge_agg_double("s").alias("s"))
    grid = sorted({p for pair in wanted.values() for p in pair})
    at = {p: i for i, p in enumerate(grid)}
    quantiles = {(r["j"], r["t"]): r["q"] for r in merged.select("j", "t", F.kll_sketch_get_quantile_double(
        "s", F.array(*[F.lit(p) for p in grid])).alias("q")).collect()}
    for j, b in enumerate(brackets):
        ends = [(quantiles[j, repr(t)], wanted[j, t]) for t in b.ranks]
        b.lo = min(q[at[w[0]]] for q, w in ends)
        b.hi = max(q[at[w[1]]] for q, w in ends)


def picked(pairs: dict[float, dict], ranks: Sequence[int], below: int, parts: Sequence[int]) -> dict[int, float]:
    """Values at 0-based ranks from {value: {fold: count}}, ``below`` rows lying before them."""
    found, seen, j = {}, below, 0
    todo = sorted(set(ranks))
    for value in sorted(pairs):
        seen += sum(pairs[value].get(p, 0) for p in parts)
        while j < len(todo) and todo[j] < seen:
            found[todo[j]] = value
            j += 1
    return found


def collected(rows: DataFrame, brackets: list[Bracket]) -> list[dict[float, dict]]:
    """One job: the (value, fold, count) pairs inside each bracket."""
    items = F.array(*[F.when(inside(b), F.struct(F.lit(j).alias("j"), F.col(f"c{b.column}").alias("v")))
                      for j, b in enumerate(brackets)])
    out: list[dict] = [defaultdict(dict) for _ in brackets]
    for r in rows.select("_part", F.explode(items).alias("x")).where("x is not null").groupBy(
            "x.j", "x.v", "_part").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["j"]][r["v"]][r["_part"]] = r["n"]
    return out


def sorted_out(rows: DataFrame, b: Bracket, parts: dict, targets: Targets) -> None:
    """The ranks of a bracket that stayed wide: its distinct values in ranges, of which the
    ranges that hold a rank are collected."""
    folds = sorted(parts)
    values = rows.where(inside(b)).groupBy(F.col(f"c{b.column}").alias("v")).agg(
        *[F.count_if(F.col("_part") == p).alias(f"n{p}") for p in folds])
    ranged = in_slices(values, ["v"])
    sums = sorted(ranged.groupBy(SLICE).agg(*[F.sum(f"n{p}").alias(f"n{p}") for p in folds]).collect(),
                  key=lambda r: r[SLICE])
    for t, ranks in b.ranks.items():
        own = [p for p in targets[t] if p in parts]
        before = sum(parts[p][0] for p in own)
        for s in sums:
            here = sum(s[f"n{p}"] for p in own)
            hit = [r for r in ranks if before <= r < before + here]
            if hit:
                pairs = {r["v"]: {p: r[f"n{p}"] for p in folds}
                         for r in ranged.where(F.col(SLICE) == s[SLICE]).collect()}
                b.held |= {(t, r): v for r, v in picked(pairs, hit, before, own).items()}
            before += here


def exact(df: DataFrame, cols: Sequence[str], probs: Sequence[float], fold: str | None = None,
          folds: int = 0, collect_limit: int = COLLECT_LIMIT, max_levels: int = MAX_LEVELS,
          sketch_k: int = SKETCH_K) -> dict[Hashable, dict[str, list[float | None]]]:
    """``{target: {column: [one value per probability]}}`` by linear interpolation (as
    ``percentile``); None where a target has no values. Without ``fold`` the only target is None,
    the whole table; with it there is one target f per fold: the rows of the other folds."""
    cols, probs = list(cols), [float(p) for p in probs]
    targets: Targets = {None: [0]} if fold is None else {
        f: [p for p in range(folds) if p != f] for f in range(folds)}
    if not cols:
        return {t: {} for t in targets}
    part = F.lit(0) if fold is None else F.col(fold).cast("int")
    clean = [F.col(c).cast("double") for c in cols]
    narrow = df.select(part.alias("_part"), *[F.when(~F.isnan(v), v).alias(f"c{i}")
                                             for i, v in enumerate(clean)])
    with scratch(narrow) as rows:
        first = [Bracket(i, {}) for i in range(len(cols))]
        seen = summaries(rows, first, sketch_k)
        n = {(t, i): sum(seen[i][p][1] for p in ps if p in seen[i]) for t, ps in targets.items()
             for i in range(len(cols))}
        places = {(t, i): [p * (n[t, i] - 1) for p in probs] for t in targets for i in range(len(cols))
                  if n[t, i]}
        opened, parts_of = [], []
        for i in range(len(cols)):
            for k in range(len(probs)):
                ranks = {t: sorted({math.floor(places[t, i][k]), min(math.floor(places[t, i][k]) + 1,
                                                                  n[t, i] - 1)})
                         for t in targets if (t, i) in places}
                if ranks:
                    opened.append(Bracket(i, ranks))
                    parts_of.append(seen[i])
        done = list(opened)
        for level in range(max_levels + 1):
            if level:
                now = summaries(rows, opened, sketch_k)
                parts_of = [now[j] for j in range(len(opened))]
            ready, wide, missed = [], [], []
            for b, parts in zip(opened, parts_of):
                hit = all(sum(parts[p][0] for p in targets[t] if p in parts) <= min(ranks) and max(ranks) < sum(
                    parts[p][0] + parts[p][1] for p in targets[t] if p in parts) for t, ranks in b.ranks.items())
                few = sum(d for _, _, d, _ in parts.values()) <= collect_limit
                (missed if not hit else ready if few else wide).append((b, parts))
            taken = 0
            while taken < len(ready):      # some brackets at a time: the driver holds that many pairs
                group, size = [], 0
                while taken < len(ready) and (not group or size + sum(
                        d for _, _, d, _ in ready[taken][1].values()) <= 4 * collect_limit):
                    size += sum(d for _, _, d, _ in ready[taken][1].values())
                    group.append(ready[taken])
                    taken += 1
                # brackets that are the same stretch of a column are collected once
                same = {}
                for b, parts in group:
                    same.setdefault((b.column, b.lo, b.hi), []).append((b, parts))
                unique = [v[0][0] for v in same.values()]
                for pairs, members in zip(collected(rows, unique), same.values()):
                    for b, parts in members:
                        for t, ranks in b.ranks.items():
                            below = sum(parts[p][0] for p in targets[t] if p in parts)
                            b.held |= {(t, r): v for r, v in picked(pairs, ranks, below, targets[t]).items()}
            for b, _ in missed:
                b.lo, b.hi, b.margin = -math.inf, math.inf, 4 * b.margin
            if level == max_levels:
                late = [(b, seen[b.column]) for b, _ in missed] + wide
                for b, parts in late:
                    sorted_out(rows, b, parts, targets)
                break
            opened = [b for b, _ in wide] + [b for b, _ in missed]
            if not opened:
                break
            narrowed(df.sparkSession, opened, [p for _, p in wide] + [seen[b.column] for b, _ in missed], targets)
        value = {}
        for b in done:
            value.setdefault(b.column, {}).update(b.held)
    out: dict = {t: {c: [None] * len(probs) for c in cols} for t in targets}
    for (t, i), hs in places.items():
        for k, h in enumerate(hs):
            lo = math.floor(h)
            a, z = value[i][t, lo], value[i][t, min(lo + 1, n[t, i] - 1)]
            out[t][cols[i]][k] = a + (z - a) * (h - lo) if h > lo else a
    return out
