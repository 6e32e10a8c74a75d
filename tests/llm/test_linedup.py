import random

import pytest

from parcel.llm.linedup import dedup_lines, repeated_runs
from tests.llm.util import frame, prose, rows


def brute(pairs, least):
    """Text of every row after deletion: every window of ``least`` words that stands somewhere
    before, all of its lines."""
    lines = [[(k, x, len(x.split())) for k, x in enumerate((t or "").split("\n")) if x.split()]
             for _, t in pairs]
    count, first, gone = {}, {}, [set() for _ in pairs]
    for doc in lines:
        for _, x, _ in doc:
            count[x] = count.get(x, 0) + 1
    for r in sorted(range(len(pairs)), key=lambda r: (-1 << 63 if pairs[r][0] is None else pairs[r][0], r)):
        for a in range(len(lines[r])):
            words = 0
            for b in range(a, len(lines[r])):
                if count[lines[r][b][1]] < 2:
                    break
                words += lines[r][b][2]
                if words >= least:
                    r0, a0 = first.setdefault(tuple(x for _, x, _ in lines[r][a:b + 1]), (r, a))
                    if (r0, a0) != (r, a):
                        start = a0 + b - a + 1 if r0 == r and a <= a0 + b - a else a
                        gone[r].update(range(start, b + 1))
    out = []
    for r, (d, t) in enumerate(pairs):
        drop = {lines[r][i][0] for i in gone[r]}
        for i in gone[r]:
            if i + 1 in gone[r]:
                drop.update(range(lines[r][i][0], lines[r][i + 1][0]))
        out.append((d, "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in drop)
                    if gone[r] else t, len(gone[r])))
    return sorted(out, key=repr)


def stories(seed, docs, pool, words):
    r = random.Random(seed)
    lines = [prose(seed * 1000 + k, r.randint(1, words)) for k in range(pool)]
    return [(k, "\n".join(r.choice([*r.sample(lines, 1), "", prose(r.random(), 6)])
                          for _ in range(r.randint(1, 30)))) for k in range(docs)]


@pytest.mark.parametrize("seed,pool,words,least", [(1, 6, 5, 12), (2, 3, 3, 10), (3, 12, 12, 9)])
def test_equals_brute_force(spark, seed, pool, words, least):
    pairs = stories(seed, 40, pool, words)
    passage = "\n".join(prose(900 + k, 4) for k in range(9))
    pairs += [(100 + k, f"{prose(k, 5)}\n{passage}\n\n{prose(k + 50, 5)}") for k in range(5)]
    pairs += [(200, "x y z\n" * 12), (201, passage), (202, passage), (202, passage)]
    got = dedup_lines(frame(spark, pairs).coalesce(1), least)
    assert sorted(((r.doc_id, r.text, r.lines_deleted) for r in got.collect()), key=repr) == brute(pairs, least)


def test_hot_line_is_ranked_in_slices(spark, monkeypatch):
    from parcel.llm import linedup
    monkeypatch.setattr(linedup, "SLICE", 2)
    pairs = [(k, f"hot line\n{prose(k % 7, 5)}\nhot line\n{prose(k % 5, 5)}") for k in range(60)]
    got = dedup_lines(frame(spark, pairs).coalesce(1), 14)
    assert sorted(((r.doc_id, r.text, r.lines_deleted) for r in got.collect()), key=repr) == brute(pairs, 14)


def test_awkward_rows(spark):
    pairs = rows([(30, prose(5, 4000))])
    df = frame(spark, pairs).coalesce(1)
    got = dedup_lines(df, 50)
    assert got.columns == [*df.columns[:1], "text", *df.columns[2:], "line_spans", "lines_before", "lines_deleted"]
    assert sorted(((r.doc_id, r.text, r.lines_deleted) for r in got.collect()), key=repr) == brute(pairs, 50)
    assert dedup_lines(df.where("false")).count() == 0
    assert dedup_lines(df.withColumn("line_spans", df.key), report=False).columns[-1] == "line_spans"
    assert repeated_runs(df, 50)[1].count() > 0
