import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parcel.llm import packing
from tests.llm.util import frame, prose, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_equal_the_tokenizer(spark):
    tok = Tokenizer.from_file(PATH)
    pairs = rows([(20, "a  b   c"), (21, " a"), (22, "a\n b\n\n  c\t d\n "), (23, "x <|endoftext|> y"),
                  (24, "it's we'll 12 ½ __ a b　c")])
    got = packing.token_pieces(frame(spark, pairs), PATH, 64, 2, with_ids=True).collect()
    want = []
    for d, t in pairs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        cut = len(ids) % 64 or 64
        starts = [0, *range(cut, len(ids), 64)]
        for k, a in enumerate(starts):
            part = ids[a:(starts + [len(ids)])[k + 1]]
            want.append((d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bins(spark):
    pairs = rows([(100 + k, prose(k, 1 + k * 7 % 300)) for k in range(200)])
    got = packing.pack_documents(frame(spark, pairs), PATH, 256).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1]
        assert sum(n for _, n in spans) <= 256
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 256) + 2
    assert packing.pack_documents(frame(spark, pairs).where("false"), PATH).count() == 0


def brute_fullest(room, left):
    best = 0
    items = [x for x, n in left.items() for _ in range(n)]
    for k in range(len(items) + 1):
        for c in itertools.combinations(items, k):
            if best < sum(c) <= room:
                best = sum(c)
    return best


@pytest.mark.parametrize("room,left", [(10, {3: 2, 4: 1, 7: 1}), (11, {2: 3, 9: 1}), (5, {6: 1}),
                                       (13, {5: 2, 4: 2, 1: 1}), (0, {1: 2})])
def test_fullest_combination(room, left):
    got = packing.fullest(room, left)
    assert all(n <= left[k] for k, n in got.items())
    assert sum(k * n for k, n in got.items()) == brute_fullest(room, left)


def test_plan_uses_every_piece():
    counts = {1024: 3, 1000: 10, 24: 4, 500: 9, 12: 5, 1: 1}
    plan = packing.plan_bins(counts)
    used = defaultdict(int)
    for bin_, times in plan:
        assert sum(k * n for k, n in bin_.items()) <= 1024
        for k, n in bin_.items():
            used[k] += n * times
    assert used == counts
    with pytest.raises(ValueError):
        packing.plan_bins({2000: 1})
