"""Word shingles of a text as sorted 64-bit hashes, and their one-permutation sketches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_COEF = np.random.default_rng(20240611).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text whose words are hashed together; bounds memory on very long texts.
PIECE = 1 << 19
#: Words of more bytes are hashed one by one: sums over bytes can be made to collide on long strings.
LONG_WORD = 64
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IN_WORD = np.array([not _SPACE.match(bytes([b])) for b in range(256)])
_BYTES = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << (n - 1).bit_length(), 1 << 14)
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, A-Z as a-z, by differences of running sums over the bytes."""
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # up to the end of the word that lies across
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        data = np.frombuffer(text[at:end], np.uint8)
        edges = np.flatnonzero(np.diff(_IN_WORD[data], prepend=False, append=False))
        first, last = edges[::2], edges[1::2]
        up, down = powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up, out=total[1:])
        h = mix((total[last] - total[first]) * down[first])
        for i in np.flatnonzero(last - first > LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(text[at + first[i]: at + last[i]].lower())
        out.append(h)
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, A-Z lower-cased.

    Words are separated by \\x20 and \\x09-\\x0D. A text of fewer words than
    ``width`` has its whole sequence as one shingle; one without words has none.
    """
    h = word_hashes(text or b"")
    n = len(h)
    if not n:
        return h
    wide = min(width, n)
    total = np.full(n - wide + 1, wide, np.uint64) * _COEF[-1]
    for j in range(wide):
        total += h[j: n - wide + 1 + j] * _COEF[j]
    total = mix(total)
    total.sort()
    return total[np.r_[True, total[1:] != total[:-1]]]


def set_digest(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


class Sketcher:
    """One-permutation hashing with optimal densification, and its bands."""

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        draw = np.random.default_rng(seed)
        self.edges = np.array([(i << 64) // self.bins + (1 if (i << 64) % self.bins else 0) for i in range(self.bins)], np.uint64)
        self.probes = draw.integers(0, self.bins, (self.bins, 64))

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash of each bin; an empty bin borrows from the first filled bin of its own random sequence."""
        at = np.searchsorted(hashes, self.edges)
        ends = np.append(at[1:], len(hashes))
        filled = ends > at
        out = np.zeros(self.bins, np.uint64)
        out[filled] = hashes[at[filled]]
        empty = np.flatnonzero(~filled)
        for t in range(self.probes.shape[1]):
            if not len(empty):
                return out
            source = self.probes[empty, t]
            ok = filled[source]
            out[empty[ok]] = out[source[ok]]
            empty = empty[~ok]
        if len(empty):  # few filled bins: the next one in cyclic order
            have = np.flatnonzero(filled)
            out[empty] = out[have[np.searchsorted(have, empty) % len(have)]]
        return out

    @staticmethod
    def halves(sketch: np.ndarray) -> tuple[bytes, bytes]:
        """Two bytes a bin, apart: the low ones are enough to estimate similarity, both name a band."""
        m = mix(sketch)
        return tuple((m >> np.uint64(x)).astype(np.uint8).tobytes() for x in (0, 8))
