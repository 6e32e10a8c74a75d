import math
import zlib
from collections import Counter

import numpy as np

from parcel.llm import hpylm
from tests.llm.util import frame, prose, rows


def test_base_scores_equal_brute_force(spark):
    pairs = rows([(100 + k, prose(k, 30)) for k in range(60)])
    got = hpylm.language_scores(frame(spark, pairs).coalesce(2)).collect()
    train = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for d, t in pairs if train(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(d), not train(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
                  for d, t in pairs)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                   round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    plain = [r for r in got if r.doc_id and r.doc_id >= 100]
    assert sum(r.score for r in plain) > sum(r.base_score for r in plain)


def model(words, states, counts, sweeps=3):
    kept = hpylm.Restaurants(np.array(words, np.uint64), np.array(states, np.uint32),
                             np.array(counts, np.int64))
    t = hpylm.start_tables(kept)

    def g():
        rows = hpylm.totals(kept, *t).to_pylist()
        out = {"T2": np.zeros(hpylm.STATES), "C2": np.zeros(hpylm.STATES), "T1": np.zeros(256),
               "C1": np.zeros(256), "T0": 0.0, "C0": 0.0, "d": [0.6, 0.5, 0.4]}
        for r in rows:
            if r["level"] in (1, 2):
                out[f"C{r['level']}"][r["state"]] = r["customers"]
                out[f"T{r['level']}"][r["state"]] = r["tables"]
            elif r["level"] == 0:
                out["C0"], out["T0"] = float(r["customers"]), float(r["tables"])
            elif r["level"] == 3:
                out["base"] = 1 / (r["customers"] + 1)
        return out

    for k in range(sweeps):
        t = kept.sweep(*t, g(), np.random.default_rng(k))
    return kept, t, g()


def test_probabilities_add_up():
    r = np.random.default_rng(5)
    cells = sorted({(int(w), int(s)) for w, s in zip(r.integers(1, 40, 300), r.integers(0, 600, 300))})
    kept, t, g = model([c[0] for c in cells], [c[1] for c in cells], r.integers(1, 500, len(cells)))
    p0, p1, p2 = kept.probabilities(*t, g)
    unseen = (1 + g["d"][2] * g["T0"]) * g["base"] / (1 + g["C0"])
    assert abs(p0.sum() + unseen - 1) < 1e-9       # every known word and the unknown one
    for s in {c[1] for c in cells}:
        total = 0.0
        for k, w in enumerate([*kept.root_word, None]):
            p = unseen if w is None else p0[k]
            u = s & 255
            m = np.flatnonzero((kept.mid_word == w) & (kept.mid_state == u)) if w is not None else []
            p = p1[m[0]] if len(m) else (1 + g["d"][1] * g["T1"][u]) * p / (1 + g["C1"][u])
            m = np.flatnonzero((kept.word == w) & (kept.state == s)) if w is not None else []
            p = p2[m[0]] if len(m) else (1 + g["d"][0] * g["T2"][s]) * p / (1 + g["C2"][s])
            total += p
        assert abs(total - 1) < 1e-9


def test_seating_bounds_and_large_counts():
    rng = np.random.default_rng(1)
    customers = np.array([1, 2, 50, 10_000_000, 3])
    t = hpylm.seat(customers, np.full(5, 0.1), np.full(5, 20.0), 0.5, rng)
    assert t[0] == 1 and (t >= 1).all() and (t <= customers).all()
    # expected tables of a single dish by the recursion, against draws
    want = 1.0
    for i in range(1, 200):
        want += 2.0 / (2.0 + i - 0.5 * want)
    got = np.mean([hpylm.seat(np.array([200]), np.array([0.1]), np.array([38.0]), 0.5, rng)[0]
                   for _ in range(2000)])
    assert abs(got - want) < 0.05 * want


def test_empty_table_and_no_training_text(spark):
    df = frame(spark, rows())
    assert hpylm.language_scores(df.where("false")).count() == 0
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    got = hpylm.language_scores(frame(spark, [(k, "some words here") for k in held]).coalesce(1)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 3


def test_endings_and_ends():
    word, state, ends = hpylm.tokens_of(["ab c", "", "dé"])
    assert ends.tolist() == [3, 4, 6]
    assert state.tolist() == [0, ord("a") * 256 + ord("b"), ord("c"), 0, 0, 0xC3 * 256 + 0xA9]
    assert (word[[2, 3, 5]] == hpylm.END).all()


def test_contexts_are_whole_words():
    """Words with equal endings are contexts of their own."""
    word, context, ends = hpylm.pairs_of(["running x", "Sing x", "running x x"])
    assert context[[0, 3, 6]].tolist() == [hpylm.END] * 3 and ends.tolist() == [3, 6, 10]
    assert context[1] == word[0] == context[7] and context[4] == word[3] != context[1]
    assert hpylm.ending(context[[1, 4]]).tolist() == [ord("n") * 256 + ord("g")] * 2


def test_equal_endings_share_no_distribution(spark):
    """After "sing" always red, after "ring" always blue: the other way round is less likely by far."""
    train = [k for k in range(600) if zlib.crc32(str(k).encode()) % 7 != 2]
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 7 == 2][:4]
    pairs = [(k, ("sing red", "ring blue")[k % 2]) for k in train]
    pairs += list(zip(held, ("sing red", "ring blue", "sing blue", "ring red")))
    got = {r.doc_id: r.score for r in hpylm.language_scores(frame(spark, pairs).repartition(3)).collect()}
    assert min(got[held[0]], got[held[1]]) > max(got[held[2]], got[held[3]]) + 1


def test_restaurants_of_whole_words_add_up(monkeypatch):
    """The rounds of owners and contexts by hand: probabilities after every word add up to one."""
    monkeypatch.setattr(hpylm, "STRENGTH", 1.0)
    r = np.random.default_rng(3)
    owners = 3
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.5, 40) % 30) for _ in range(50)]
    word, _, _ = hpylm.pairs_of(texts)
    cells = hpylm.Cells(word, owners)
    count = np.bincount(cells.of_token)
    kept = {o: hpylm.Contexts(cells.word[a:b], cells.context[a:b], count[a:b]) for o, a, b in cells.by_owner()}
    tables = {o: k.start() for o, k in kept.items()}

    def total_g():
        parts = [x for o in kept for x in hpylm.written(kept[o], tables[o], o, owners, False).to_pylist()
                 if x["level"] is not None]
        by = Counter()
        for x in parts:
            by[x["level"], x["state"], "c"] += x["customers"]
            by[x["level"], x["state"], "t"] += x["tables"]
        rows = [(lv, st, by[lv, st, "c"], by[lv, st, "t"]) for lv, st in {k[:2] for k in by}]

        class Levels:
            def groupBy(self, *a):
                return self

            def agg(self, *a):
                return self

            def collect(self):
                return rows
        return hpylm.gather_totals(Levels())

    def sums():
        c = Counter()
        for o, k in kept.items():
            t = np.ones(len(k.word), np.int64)
            t[k.open] = tables[o][0]
            for u, n in zip(k.context.tolist(), t.tolist()):
                c[u] += n
        return c

    monkeypatch.setattr(hpylm.F, "sum", lambda c: c)
    rounds = []
    for sweep in range(4):
        g, now = total_g(), sums()
        rounds.append((g, dict(tables), now))
        tables = {o: k.sweep(tables[o], np.array([now[u] for u in k.asked.tolist()], float), g,
                             np.random.default_rng([sweep, o])) for o, k in kept.items()}
    assert any((t[0] > 1).any() for t in tables.values())
    known = np.unique(word)
    lexica = {o: hpylm.Lexicon(k, [(g, t[o]) for g, t, _ in rounds], np.array(sorted(rounds[0][2]), np.uint64), [
        np.array([n[u] for u in sorted(n)]) for _, _, n in rounds]) for o, k in kept.items()}
    for u in known.tolist():
        total = 0.0
        for w in [*known.tolist(), 12345]:                # every known word and the unknown one
            o = int(hpylm.owner_of(np.array([w], np.uint64), owners)[0])
            own, parent = lexica[o].of_cells(np.array([w], np.uint64), np.array([u], np.uint64))
            ou = int(hpylm.owner_of(np.array([u], np.uint64), owners)[0])
            c, t = lexica[ou].of_words(np.array([u], np.uint64))
            total += ((own + (1 + rounds[-1][0]["d3"] * t) * parent) / (1 + c))[0]
        assert abs(total - 1) < 1e-9


def test_packed_numbers_come_back():
    x = [np.array([0, 1, 254, 255, 256, 1 << 40]), np.array([1 << 63, 3], np.uint64), np.zeros(0, np.int64),
         np.array([0.5, 2], np.float32)]
    got = hpylm.unpack(hpylm.pack(*x))
    assert [g.tolist() for g in got] == [v.tolist() for v in x]
