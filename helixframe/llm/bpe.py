"""Byte-level BPE encoding and decoding (operator 10).

Texts are cut by the tokenizer's pattern; every match is merged on its own by
a rank queue.  The queue has one bucket of positions for each merge rank and a
hierarchical bitmap over the ranks: find-first-set on its two levels gives the lowest rank with an entry.  Positions live on a linked list;
an entry whose pair has since changed is stale and skipped.  A match of n
bytes costs O(n log n) whatever its length, so very long matches are safe.
All matches of a batch that no table has share one queue, and a bucket is merged
as a whole: matches never touch each other, and of overlapping places in one
match every other one from the left counts.  A few tokens are part of one of
lower rank, which has to go first; of those, a match merges one place at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import layout, steps
from .pieces import PieceTable
from .worker import bound_batches, left_by, released

#: Texts are encoded together up to so many bytes.
STEP_BYTES = 1 << 20
#: Fixed value: the pattern whose matches never run from a word into the blanks after it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ASCII letters, and digits and marks: no match of that pattern has one of these after a letter.
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[33:127] = ~LETTER[33:127]
#: First bytes of white space other than the blank and the line end, in UTF-8.
OTHER_SPACE = np.zeros(256, bool)
OTHER_SPACE[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a line has a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class RankQueue:
    """Merge ranks with list positions; buckets come out by rank, positions from left to right.

    Two levels of 256-bit words mark the ranks that have a bucket; the lowest
    set bit of the upper one finds the word, that of the word the rank.
    """

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        self.mark(rank)

    def mark(self, rank: int) -> None:
        word = rank >> 8
        self.low[word] |= 1 << (rank & 255)
        self.top |= 1 << word

    def pop(self) -> tuple[int, list[int]]:
        """The lowest marked rank and what was pushed for it; only where ``top`` is not 0."""
        top = self.top
        word = (top & -top).bit_length() - 1
        bits = self.low[word]
        first = bits & -bits
        rank = (word << 8) + first.bit_length() - 1
        self.low[word] = bits = bits ^ first
        if not bits:
            self.top = top & (top - 1)
        return rank, self.buckets.pop(rank, [])


class PairRanks:
    """Rank of the token that two tokens make, for arrays of them; -1 if none."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=0) + 1
        made = [(ranks[t[:i]] * self.size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        made.sort()
        self.keys, self.ranks = (np.array([m[c] for m in made] + [-1 if c else 1 << 62], np.int64) for c in (0, 1))
        self.part_of_lower = np.zeros(self.size, bool)
        self.part_of_lower[[part for key, r in made for part in divmod(key, self.size) if part > r]] = True
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


class ByteBPE:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.pairs = PairRanks(ranks)
        self.first_pairs = self.pairs.of(np.repeat(self.pairs.byte, 256), np.tile(self.pairs.byte, 256))
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # A run of blanks belongs to the word after it: the pattern never matches across the end of a
        # word, so such chunks can be encoded apart.  Texts with other white space, and other patterns, go whole.
        self.chunked = pattern == WORD_PATTERN
        self.other_space = re.compile("[^\\S \\n]").search
        self.table = PieceTable(self.learn)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids end to end, number of them) of each match of the pattern; the matches share one queue but never merge."""
        data, sizes = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, queue, pairs = len(data), self.queue, self.pairs
        if not n:
            return np.zeros(0, np.uint32), sizes
        ends = np.cumsum(sizes)
        starts, stops = (ends - sizes)[sizes > 0], ends[sizes > 0] - 1
        token, gone = pairs.byte[data], np.zeros(n, bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[stops] = before[starts] = -1
        pair = np.full(n, -1, np.int64)
        pair[:-1] = self.first_pairs[data[:-1] << 8 | data[1:]]
        pair[stops] = -1
        # The first entries of the buckets: places by rank, from left to right.
        places = np.flatnonzero(pair >= 0)
        places = places[np.argsort(pair[places], kind="stable")]
        own, first = np.unique(pair[places], return_index=True)
        entries = dict(zip(own.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(places)], strict=True), strict=True))
        for rank in entries:
            queue.mark(rank)
        while queue.top:
            rank, pushed = queue.pop()
            a, b = entries.pop(rank, (0, 0))
            at = np.unique(np.concatenate([places[a:b], np.array(pushed, np.int64)])) if pushed else places[a:b]
            at = at[pair[at] == rank]  # others are stale: the pair has changed or its left part is gone
            if not len(at):
                continue
            if pairs.part_of_lower[rank] and len(at) > 1:
                own = np.searchsorted(ends, at, side="right")
                first = np.concatenate(([True], own[1:] != own[:-1]))
                if not first.all():
                    queue.buckets[rank] = at[~first].tolist()
                    queue.mark(rank)
                at = at[first]
            joined = after[at]
            if len(at) > 1 and (chained := joined[:-1] == at[1:]).any():
                heads = np.flatnonzero(np.concatenate(([True], ~chained)))
                taken = (np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))) % 2 == 0
                at, joined = at[taken], joined[taken]
            right = after[joined]
            token[at], after[at], gone[joined], pair[joined], pair[at] = rank, right, True, -1, -1
            more = right >= 0
            left, right = at[more], right[more]
            before[right] = left
            lower = before[at]
            some = lower >= 0
            lower, upper = lower[some], at[some]
            changed = np.concatenate([left, lower])
            made = pairs.of(token[changed], token[np.concatenate([right, upper])])
            pair[changed] = made
            kept = made >= 0
            for new, place in zip(made[kept].tolist(), changed[kept].tolist(), strict=True):
                queue.push(new, place)
        kept = np.concatenate(([0], np.cumsum(~gone)))
        return token[~gone].astype(np.uint32), kept[ends] - kept[ends - sizes]

    def learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of them) of each chunk, its matches merged with those of all others."""
        cut = [self.pieces(chunk.decode()) for chunk in chunks]
        ids, counts = self.merge([piece.encode() for pieces in cut for piece in pieces])
        total = np.concatenate(([0], np.cumsum(counts)))[np.cumsum([0, *map(len, cut)])]
        return ids, np.diff(total)

    def encode_bytes(self, raw: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers; texts lie end to end at ``ends`` in ``raw``."""
        edges = ends - ends[0]
        buf = raw[ends[0] : ends[-1]]
        if not len(buf):
            return [b""] * (len(ends) - 1)
        # A chunk starts with a text, with a blank after another character, or with a mark after a letter.
        edge = np.zeros(len(buf) + 1, bool)
        edge[edges] = True
        blank = (buf == 32) | (buf == 10)
        start = edge[:-1].copy()
        start[1:] |= (blank[1:] & ~blank[:-1]) | (LETTER[buf[:-1]] & MARK[buf[1:]])
        odd = np.flatnonzero(OTHER_SPACE[buf])
        for i in np.unique(np.searchsorted(edges, odd, side="right") - 1).tolist() if self.chunked else range(len(edges) - 1):
            a, b = int(edges[i]), int(edges[i + 1])
            if not self.chunked or self.other_space(buf[a:b].tobytes().decode()):
                start[a + 1 : b] = False
        starts = np.flatnonzero(start)
        ids, counts = self.table.encode(buf, starts, np.append(starts[1:], len(buf)))
        cuts = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, edges)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        own = [text.encode() for text in texts]
        return self.encode_bytes(np.frombuffer(b"".join(own), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in own], dtype=np.int64))))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[tuple[str, str], ByteBPE] = left_by(__name__)


def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each worker process and rank file."""
    if (path, pattern) not in _codecs:
        _codecs.clear()
        _codecs[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _codecs[path, pattern]


def _encoded(bpe: ByteBPE, column: pa.Array) -> Iterator[list[bytes]]:
    """Ids of the column's texts, some at a time; null is empty."""
    raw, ends = layout(column)
    for at, to in steps(ends, STEP_BYTES):
        yield bpe.encode_bytes(raw, ends[at : to + 1])


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``ids``: little-endian unsigned 32-bit token ids.

    A null text counts as empty and has no ids.  A column that is already
    called ``ids`` is replaced; all others pass through, repeated rows too.
    """
    kept = [c for c in docs.columns if c != ids]
    schema = docs.select(*kept).schema.add(ids, "binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            made = pa.array([ids for own in _encoded(bpe, batch.column(text)) for ids in own], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), made], [*kept, ids])

    bound_batches(docs.sparkSession)
    return docs.select(*kept).mapInArrow(released(released(run)), schema)


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a binary column ``text``: the bytes that ``ids`` stand for (null: empty)."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*kept).schema.add(text, "binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            made = pa.array([bpe.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), made], [*kept, text])

    bound_batches(docs.sparkSession)
    return docs.select(*kept).mapInArrow(released(released(run)), schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs`` (doc_id, text).

    Encoding and decoding run in one pass, a few documents at a time, so ids
    and decoded bytes never leave the worker.  Null texts count as empty; null
    and repeated doc_ids keep one row each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            counts, sums, decoded = [], [], []
            for own in _encoded(bpe, batch.column("text")):
                for ids in own:
                    counts.append(len(ids) // 4)
                    sums.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(released(released(run)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
