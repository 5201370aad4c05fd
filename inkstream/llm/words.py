"""Vectorised word hashing shared by the shingle and passage operators.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Hashes are 64-bit and depend on the word's
bytes only, so they agree between tasks, executors and reruns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15  # odd, 5 mod 8: its powers have the longest period modulo 2^64
_STEP = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _CHUNK + 4096), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def batches(texts: list[bytes | None], limit: int = _CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in runs of about `limit` bytes; a null text is an empty one."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size > limit:
            yield lo, [x or b"" for x in texts[lo:i]]
            lo, size = i, 0
        size += len(t or b"") + 1
    if lo < len(texts):
        yield lo, [x or b"" for x in texts[lo:]]


class Words:
    """The words of several texts: hash, byte range and the index of each text's first word."""

    def __init__(self, texts: list[bytes]):
        self.buf = b" ".join(texts) + b" "
        a = self.bytes = np.frombuffer(self.buf, np.uint8)
        inside = ~_SPACE[a]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(size + 1)]))
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self), np.uint64)
        i, inverse = 0, pow(_BASE, -1, 1 << 64)
        while i < len(out):
            at = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + _CHUNK)))
            n = int(self.end[j - 1] - at)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.bytes[at : at + n]] * _power_table(_BASE, n), out=sums[1:])
            s, e = self.start[i:j] - at, self.end[i:j] - at
            out[i:j] = mix((sums[e] - sums[s]) * _power_table(inverse, n)[s] + (e - s).astype(np.uint64))
            i = j
        return out

    def owner(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def whole(self, k: int) -> np.ndarray:
        """For each possible window start: whether its k words lie in one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        ends = np.repeat(self.first[1:], self.count)[:n]
        return ends - np.arange(n) >= k


#: A step for hashes that are independent of those with the usual one.
OTHER_STEP = 0xAEF17502108EF2D9


def windows(h: np.ndarray, k: int, step: int = _STEP) -> np.ndarray:
    """Hash of every k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for t in range(k):
        out *= U(step)
        out += h[t : t + n]
    return mix(out)


_POS = 28  # position bits of a selection key


def minimizers(gram: np.ndarray, w: int) -> np.ndarray:
    """For each run of w consecutive gram hashes the index of the smallest (leftmost on ties).

    The choice depends on the run's content only, so equal windows choose the same offset."""
    n = len(gram) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    m = (gram >> U(_POS) << U(_POS)) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[:n], m[w - span : w - span + n])
    return (m & U((1 << _POS) - 1)).astype(np.int64)


def runs(starts_new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of the runs that a boolean 'a new run starts here' marks; its first entry counts as True."""
    if not len(starts_new):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(starts_new)
    if not len(at) or at[0]:
        at = np.concatenate([[0], at])
    return at, np.diff(np.concatenate([at, [len(starts_new)]]))
