"""Word shingles of whole texts as 64-bit hashes, in numpy.

Words are runs of anything but ASCII white space, A-Z lower-cased, nothing else changed. A document's set holds a
hash of each distinct run of k words; a document of fewer words has its whole sequence as one; without words it is
empty. Word hashes are polynomials modulo 2**64 over random byte values, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        both = []
        for b in (_BASE, _INVERSE):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * _U(pow(b, len(p), 1 << 64))])
            both.append(p)
        _powers = (both[0], both[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x moves every bit of the result."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of words before it (one more at the end)."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined.translate(_LOWER), np.uint8)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    begin = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)
    power, inverse = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * power[: len(raw)], out=total[1:])
    words = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return words, np.searchsorted(begin, starts)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles (uint64)."""
    words, first = word_hashes(texts)
    step = _U(0x9FB21C651E98DF25)
    n = max(0, len(words) - k + 1)
    rolled = np.full(n, k, np.uint64)
    for j in range(k):
        rolled = rolled * step + words[j : j + n]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = int(b - a)
            for w in words[a:b].tolist():
                h = (h * int(step) + w) & _MASK
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
