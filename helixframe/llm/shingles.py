"""Sets of word shingles as sorted 64-bit fingerprints, a step of texts at a time."""

from __future__ import annotations

import numpy as np

from .arrowtext import STEP_BYTES

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Odd multipliers of the words of a shingle; the last one takes the number of words.
WEIGHTS = [U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, for a step of bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n <= 2 * STEP_BYTES:
            self.up, self.down = self.made(STEP_BYTES if n <= STEP_BYTES else 2 * STEP_BYTES)
        return (self.up, self.down) if n <= len(self.up) else self.made(n)

    @staticmethod
    def made(n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full(n, BASE, U), np.full(n, pow(BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_powers = Powers()


def spans_hashed(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``buf``, of its bytes and length alone."""
    n = len(buf)
    up, down = _powers.upto(n)
    sums = np.zeros(n + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[:n], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U))


def pieces(separator: np.ndarray, edges: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of a buffer into pieces of about STEP_BYTES that end at a separator or an edge, so that no word is cut."""
    n, out, at = len(separator), [], 0
    while at < n:
        to = min(n, at + STEP_BYTES)
        if to < n:
            free = np.flatnonzero(separator[to:])
            edge = int(edges[np.searchsorted(edges, to)])
            to = min(edge, to + int(free[0]) if len(free) else n)
        out.append((at, to))
        at = to
    return out


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word of texts that lie end to end at ``ends`` in ``raw``; A-Z lower-cased."""
    buf = LOWER[raw[ends[0] : ends[-1]]]
    edges = ends - ends[0]
    if not len(buf):
        return np.zeros(0, U), np.zeros(0, np.int64)
    blank = SEPARATOR[buf]
    hashes, owners = [], []
    # A long text goes a piece at a time: only its words are held.
    for at, to in pieces(blank, edges) if len(buf) > 2 * STEP_BYTES else [(0, len(buf))]:
        part, inside = buf[at:to], ~blank[at:to]
        own = edges[np.searchsorted(edges, at) : np.searchsorted(edges, to)] - at
        edge = np.zeros(to - at + 1, bool)
        edge[own] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1 : to - at]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | edge[1 : to - at]
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        hashes.append(spans_hashed(part, starts, stops))
        owners.append(np.searchsorted(edges, starts + at, side="right") - 1)
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(size of each text's set, the sets end to end, each sorted).

    A text of fewer than ``k`` words has its whole sequence as one shingle, a
    text without words the empty set.
    """
    words, text = word_hashes(raw, ends)
    texts = len(ends) - 1
    counts = np.bincount(text, minlength=texts)
    if not len(words):
        return np.zeros(texts, np.int64), words
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    made = np.maximum(0, counts - k + 1) + ((counts > 0) & (counts < k))
    bounds = np.concatenate(([0], np.cumsum(made)))
    owner = np.repeat(np.arange(texts), made)
    place = np.arange(len(owner)) - bounds[owner] + first[owner]
    size = np.minimum(counts[owner], k)
    hashes = size.astype(U) * WEIGHTS[5]
    for j in range(k):
        at = np.minimum(place + j, len(words) - 1)
        hashes += np.where(j < size, words[at] * WEIGHTS[j % 5] * U(2 * (j // 5) + 1), U(0))
    hashes = mixed(hashes)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[fresh], minlength=texts), hashes[fresh]


def digests(sizes: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of every set, as signed integers."""
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for salt in (U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25)):
        sums = np.concatenate((np.zeros(1, U), np.cumsum(mixed(sets ^ salt))))
        out.append(mixed(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(U) * salt).view(np.int64))
    return out[0], out[1]
