import re

from parcel.llm import license as scanner
from tests.llm.util import frame, prose, rows

BLOCKS = ["Licensed under the Apache License, Version 2.0", "licensed, under the apache license 2.0",
          "apache license version", "THIS WORK is licensed under the GNU General Public License, version 3!",
          "gnu general public", "Released under the MIT License", "mit-license\nmit license mit license",
          "Cc-By cc  by", "the version under license mit", "Licensed under CC BY-NC 4.0.", " mit license"]


def brute(text, templates, threshold):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(scanner.WORD, low)
    hits = [(i, lab) for p, lab in scanner.PHRASES.items() for i in range(len(words))
            if words[i:i + len(p.split())] == p.split()]
    labels = {lab for _, lab in hits}
    best = {}
    for line in low.split("\n"):
        have = set(re.findall(scanner.WORD, line))
        for name, t in templates.items():
            tw = set(scanner.word_set(t))
            if len(have & tw) / len(tw) >= threshold - 1e-9:
                best[name] = max(best.get(name, 0), len(have & tw) / len(tw))
    at = [i for i, _ in hits]
    return (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | set(best))), 1.0 if hits else max(best.values(), default=0.0))


def check(spark, pairs, threshold):
    got = scanner.scan(frame(spark, pairs), threshold=threshold).collect()
    want = sorted((repr(d), *map(repr, brute(t, scanner.TEMPLATES, threshold))) for d, t in pairs)
    assert sorted((repr(r[0]), *map(repr, tuple(r)[1:])) for r in got) == want


def test_against_all_pairs(spark):
    pairs = rows([(50 + k, b) for k, b in enumerate(BLOCKS)]
                 + [(100 + k, f"{prose(k, 20)}\n{b}") for k, b in enumerate(BLOCKS)])
    check(spark, pairs, 0.9)
    check(spark, pairs, 0.5)


def test_empty_table(spark):
    assert scanner.scan(frame(spark, rows()).where("false")).count() == 0
