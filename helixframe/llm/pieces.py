"""Token ids of pieces of text that come again and again, looked up a step of bytes at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .shingles import U, spans_hashed

#: Longer pieces are never remembered.
LONGEST = 64
#: Slots of the look-up table, as a power of two; pieces and ids that are remembered before all are forgotten.
TABLE_BITS, PIECES, IDS = 20, 1 << 19, 1 << 21


class PieceTable:
    """Remembered ids of pieces, of bounded size.

    Pieces of up to LONGEST bytes are told apart by 64-bit hashes; a new piece
    meets the hash of a remembered one with a probability of some 1e-14.  A
    slot keeps the last piece that fell there; what isn't found is made again.
    ``make`` gives the ids of pieces end to end, and how many each has.
    """

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], doublings: int = 0):
        self.make = make
        self.bits, self.most_pieces, self.most_ids = TABLE_BITS + doublings, PIECES << doublings, IDS << doublings
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(1 << self.bits, U)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.pieces = self.ids = 0
        self.first, self.sizes, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)

    def room(self, name: str, need: int) -> None:
        """Arrays double as they fill up."""
        had = getattr(self, name)
        if len(had) < need:
            grown = np.zeros(max(need, 2 * len(had)), had.dtype)
            grown[: len(had)] = had
            setattr(self, name, grown)

    def add(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers under which the ids of new pieces can be found."""
        made, sizes = self.make(pieces)
        pieces, ids = self.pieces + len(sizes), self.ids + len(made)
        for name, need in (("first", pieces), ("sizes", pieces), ("flat", ids)):
            self.room(name, need)
        self.first[self.pieces : pieces] = self.ids + np.cumsum(sizes) - sizes
        self.sizes[self.pieces : pieces] = sizes
        self.flat[self.ids : ids] = made
        fresh = np.arange(self.pieces, pieces)
        self.pieces, self.ids = pieces, ids
        return fresh

    def encode(self, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids) of the pieces of ``buf`` between ``starts`` and ``stops``."""
        if self.pieces > self.most_pieces or self.ids > self.most_ids:
            self.forget()
        size = stops - starts
        hashes = spans_hashed(buf, starts, stops)
        at = (hashes >> U(64 - self.bits)).astype(np.int64)
        found = self.slot[at].astype(np.int64)
        short = size <= LONGEST
        found[(self.key[at] != hashes) | ~short] = -1
        lost = np.flatnonzero((found < 0) & short)
        if len(lost):
            own, first, place = np.unique(hashes[lost], return_index=True, return_inverse=True)
            fresh = self.add([buf[a:b].tobytes() for a, b in zip(starts[lost[first]].tolist(), stops[lost[first]].tolist(), strict=True)])
            found[lost] = fresh[place]
            spot = (own >> U(64 - self.bits)).astype(np.int64)
            self.key[spot], self.slot[spot] = own, fresh
        rare = np.flatnonzero(~short)
        if len(rare):
            every = [buf[a:b].tobytes() for a, b in zip(starts[rare].tolist(), stops[rare].tolist(), strict=True)]
            known = {piece: i for i, piece in enumerate(dict.fromkeys(every))}
            found[rare] = self.add([*known])[[known[piece] for piece in every]]
        counts = self.sizes[found]
        total = np.cumsum(counts)
        index = np.repeat(self.first[found] - (total - counts), counts) + np.arange(int(total[-1]) if len(total) else 0)
        return self.flat[index], counts
