import hashlib
import re

import numpy as np

from parcel.llm import fingerprint as fp
from tests.llm.util import frame, prose, rows


def extra():
    """Near copies of one text (a chain that links far ends through its middle) and others."""
    words = prose(50, 120).split()
    chain = [(100 + k, " ".join(words[5 * k:5 * k + 90])) for k in range(5)]
    near = [(200 + k, prose(60, 300) + f" tail{k}") for k in range(12)]
    return chain + near + [(300, prose(61, 8)), (301, "a b c"), (302, "A  b\tC"), (303, "日本語" * 50)]


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def order(pairs):
    """Descending doc_id, nulls last, then md5 of the text."""
    return sorted(((d, t or "") for d, t in pairs), key=lambda r: (
        r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).digest()))


def edited(pairs):
    table = order(pairs)
    out = []
    for (d, t), (_, n) in zip(table, table[1:] + table[:1]):
        k = len(t) // 2
        out.append((d, t, n, t[:len(t) - k] + n[:k]))
    return out


def test_neighbours_equal_brute_force(spark):
    """With few and with many ranges, so that neighbours lie in the next range or far round."""
    data = rows(extra())
    for ranges in (1, 3, 40):
        got = fp.fingerprints(frame(spark, data).repartition(4), ranges).collect()
        want = sorted(((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, _, e in edited(data)), key=repr)
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == want


def test_likeness_estimates_jaccard(spark):
    data = rows(extra())
    by = {}
    for d, t, n, e in edited(data):
        by.setdefault((d, len(t)), []).append((jaccard(shingle_set(t), shingle_set(e)),
                                               jaccard(shingle_set(t), shingle_set(n))))
    got = fp.fingerprints(frame(spark, data)).collect()
    for r in got:
        if r.has_words:
            assert any(abs(r.near_edited - a) < 0.22 and abs(r.near_next - b) < 0.22
                       for a, b in by[r.doc_id, r.n_chars])


def test_equal_texts_have_equal_fingerprints_and_case_does_not_count():
    texts = [prose(1, 500), prose(1, 500), prose(1, 500).upper().replace("É", "é").replace("Ü", "Ü"), "", " \n"]
    s = fp.signatures(texts)
    assert (s[0] == s[1]).all() and (s[3] == s[4]).all() and fp.likeness(s[0], s[3]) < 0.05
    alone = np.vstack([fp.signatures([t]) for t in texts])
    assert (alone == s).all()              # whatever texts are hashed together


def test_shingles_are_the_sets():
    texts = [t or "" for _, t in rows(extra())]
    hashes, count = fp.shingles(texts)
    parts = np.split(hashes, np.cumsum(count)[:-1])
    seen = {}
    for t, h in zip(texts, parts):
        s = shingle_set(t)
        assert len(set(h.tolist())) == len(s)
        seen.setdefault(frozenset(s), set()).add(frozenset(h.tolist()))
    assert all(len(v) == 1 for v in seen.values())


def components(data):
    n = len(data)
    sets = [shingle_set(t) for _, t in data]
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and (100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])):
                label[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(data[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((data[i][0], least[find(i)]) for i in range(n)), key=repr)


def test_near_copies_equal_brute_force(spark):
    data = rows(extra())
    docs = frame(spark, data)
    got = fp.near_copies(fp.fingerprints(docs), docs).collect()
    assert sorted(((r.doc_id, r.group_id) for r in got), key=repr) == components(data)


def test_groups_hold_together(spark):
    """Copies of which each has a word of its own in another place."""
    data = []
    for g in range(6):
        words = prose(70 + g, 200).split()
        for k in range(8):
            w = list(words)
            w[25 * (k % 8)] = f"x{g}{k}"
            data.append((10 * g + k, " ".join(w)))
    docs = frame(spark, data)
    got = fp.near_copies(fp.fingerprints(docs), docs).collect()
    assert sorted(((r.doc_id, r.group_id) for r in got), key=repr) == components(data)


def link_counts(data):
    """Number of other texts a document's text is linked with."""
    texts = sorted({t or "" for _, t in data})
    sets = {t: shingle_set(t) for t in texts}
    n = {t: sum(o != t and 100 * len(sets[t] & sets[o]) >= 75 * len(sets[t] | sets[o]) and bool(sets[t])
                for o in texts) for t in texts}
    return sorted(((d, n[t or ""]) for d, t in data), key=repr)


def test_every_link_counts(spark, monkeypatch):
    """Near copies that are linked with all others, in one block and over many."""
    words = prose(80, 400).split()
    data = rows(extra())
    for k in range(40):
        w = list(words)
        w[9 * k] = f"x{k}"
        data.append((400 + k, " ".join(w)))
    docs = frame(spark, data)
    want = link_counts(data)
    assert dict(want)[400] == 39
    for block in (fp.BLOCK, 5):
        monkeypatch.setattr(fp, "BLOCK", block)
        got = fp.near_copies(fp.fingerprints(docs), docs).collect()
        assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == want
        assert sorted(((r.doc_id, r.group_id) for r in got), key=repr) == components(data)


def test_members_of_a_bucket_meet_beside_their_leader(spark, monkeypatch):
    """Pairs that no member of the bucket links with the others: every two members are looked at."""
    monkeypatch.setattr(fp, "BLOCK", 2)
    sig = np.arange(12 * fp.PERMS).reshape(12, -1)
    sig[:, :fp.ROWS] = 7                                   # all share the first bucket
    sig[9] = sig[4]
    sig[10, :110] = sig[5, :110]
    key = [bytes([k]) * 16 for k in range(12)]
    classes = spark.createDataFrame([(bytearray(k), bytearray(s.astype(">u2").tobytes()))
                                     for k, s in zip(key, sig)], "md5 binary, places binary")
    got = fp.likely(fp.shared(classes), classes, 0.75).collect()
    assert {tuple(sorted((bytes(r.a)[0], bytes(r.b)[0]))) for r in got} == {(4, 9), (5, 10)}


def test_empty_and_single(spark):
    docs = frame(spark, [(1, "one two three")])
    one = fp.near_copies(fp.fingerprints(docs), docs).collect()
    assert len(one) == 1 and one[0].group_id == 1 and one[0].near_next == 1.0
    none = fp.near_copies(fp.fingerprints(docs.where("false")), docs.where("false"))
    assert none.count() == 0


def test_stars_of_all_cells_hang_together_by_one_link_a_member(spark):
    """The stars of a large group's cells, each member with another centre in every cell of its block."""
    links, blocks, size = [], 20, 30
    for i in range(blocks):
        for j in range(i, blocks):
            links += [(min(i, j) * size, k) for b in {i, j} for k in range(b * size, (b + 1) * size)]
    links += [(9001, 9002), (9003, 9002)]
    n = blocks * size + 3
    df = spark.createDataFrame(links, "a long, b long").where("a <> b")
    assert df.distinct().count() > 8 * n
    few = fp.hung(df)
    assert few.count() <= n + blocks
    label = {r.node: r.label for r in fp.components(few).collect()}
    assert label == {**{k: 0 for k in range(blocks * size)}, 9001: 9001, 9002: 9001, 9003: 9001}
