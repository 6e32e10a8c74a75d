"""Vectorised 64-bit hashes of the words of a batch of texts."""

from __future__ import annotations

import numpy as np

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) \
    + np.uint64(1)
#: bytes that separate words: space and 9 to 13
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTES_OR_ZERO = np.where(_SPACE, np.uint64(0), _BYTES)


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        n = 1 << n.bit_length()
        for k, base in enumerate((_MULT, _INV)):
            step = np.full(n, np.uint64(base))
            step[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: bytes hashed at once; a longer text is hashed alone
BATCH_BYTES = 1 << 20


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A-Z lower-cased, split at space and 9 to 13. Returns (hash of each word, end of each
    text's words, first byte of each word, the joined lower-cased bytes)."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    groups, room = [[]], BATCH_BYTES
    for r in raw:
        if groups[-1] and len(r) > room:
            groups.append([])
            room = BATCH_BYTES
        groups[-1].append(r)
        room -= len(r) + 1
    parts, words, size = [], 0, 0
    for hashes, ends, starts, joined in map(_words, groups):
        parts.append((hashes, ends + words, starts + size, joined))
        words += len(hashes)
        size += len(joined)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    text_ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    space = _SPACE[joined]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64), starts, joined
    power, inverse = powers(len(joined))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTES_OR_ZERO[joined] * power[:len(joined)], starts)
        hashes = mix(sums * inverse[starts])
    return hashes, np.searchsorted(starts, text_ends), starts, joined
