"""Qualities judged from alignments: mapping quality capped by mismatches, and qualities of mates where they overlap."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = re.compile(r"(\d+)([MIDNSHP=X])")
#: Qualities below this don't speak for or against a base; a mismatch counts with at most the second.
LEAST, MOST = 13, 33


def matched(pos: int, cigar: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(reference places, places in the read) of the letters that lie on the reference."""
    q, r, own, there = 0, pos, [], []
    for n, op in ((int(n), op) for n, op in _OPS.findall(cigar or "")):
        if op in "M=X":
            there.append(np.arange(r, r + n))
            own.append(np.arange(q, q + n))
        r += n if op in "MDN=X" else 0
        q += n if op in "MIS=X" else 0
    none = [np.zeros(0, int)]
    return np.concatenate(there or none), np.concatenate(own or none)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1", "replace"), np.uint8)


def capped_mapq(pos: int, cigar: str, seq: str, qual: str, ref: str, most: int = 40) -> int:
    """Highest mapping quality that a read's mismatches with ``ref`` (the whole reference) allow; -1 where they are too many.

    Mismatches of confident letters count with their quality, against the number
    of ways to place as many; clipped letters with a fifth of theirs.  What lies
    beyond the reference isn't looked at.
    """
    letters, quality = _codes(seq.upper()), _codes(qual).astype(int) - 33
    bases = _codes(ref.upper())
    length = mismatches = lost = clipped = 0
    q, r = 0, pos
    for n, op in ((int(n), op) for n, op in _OPS.findall(cigar)):
        if op in "M=X":
            inside = max(0, min(n, len(bases) - r))
            a, b, own = letters[q : q + inside], bases[r : r + inside], quality[q : q + inside]
            sure = (a != ord("N")) & (b != ord("N")) & (own >= LEAST)
            wrong = sure & (a != b) & (a != ord("="))
            length += int(sure.sum())
            mismatches += int(wrong.sum())
            lost += int(np.minimum(own[wrong], MOST).sum())
            if inside < n:
                break
            q, r, length = q + n, r + n, length + n
        elif op == "D":
            if r + n > len(bases):
                break
            r += n
        elif op == "S":
            clipped += int(quality[q : q + n].sum())
            q += n
        elif op == "H":
            clipped += LEAST * n
        elif op == "I":
            q += n
        elif op == "N":
            r += n
    t = lost - 4.343 * sum(math.log(length / (i + 1)) for i in range(mismatches)) + clipped / 5
    if t > most:
        return -1
    return int(math.sqrt((most - max(t, 0.0)) / most) * most + 0.499)


def cap_mapq(pos: Column, cigar: Column, seq: Column, qual: Column, ref: Column, most: int = 40) -> Column:
    """``capped_mapq`` of each read; null where the CIGAR, the bases, the qualities or the reference are."""

    @F.pandas_udf("int")
    def run(pos: pd.Series, cigar: pd.Series, seq: pd.Series, qual: pd.Series, ref: pd.Series) -> pd.Series:
        rows = zip(pos, cigar, seq, qual, ref, strict=True)
        return pd.Series([None if any(x is None for x in row) else capped_mapq(int(row[0]), *row[1:], most) for row in rows], dtype="Int32")

    return run(pos, cigar, seq, qual, ref)


def keeps_first(qname: str) -> bool:
    """Whether the left mate keeps its qualities; a hash of the name decides, so neither strand is favoured."""
    # Factors and shifts of the two mixing steps.
    word = (1 << 32) - 1
    key = 0
    for c in qname.encode():
        key = 31 * key + c & word
    key = key + ~(key << 15) & word
    key ^= key >> 10
    key = key + (key << 3) & word
    key ^= key >> 6
    key = key + ~(key << 11) & word
    key ^= key >> 16
    return bool(key & 1)


def settled(qname: str, a: tuple[int, str, str, np.ndarray], b: tuple[int, str, str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """New qualities of two mates (pos, cigar, seq, qualities), the left one first.

    Where both have a letter on one reference place, equal letters give the sum
    (200 at most) to one mate and 0 to the other; unequal ones leave 0.8 of the
    higher quality and 0 of the lower.
    """
    (there_a, own_a), (there_b, own_b) = matched(a[0], a[1]), matched(b[0], b[1])
    _, i, j = np.intersect1d(there_a, there_b, assume_unique=True, return_indices=True)
    x, y = own_a[i], own_b[j]
    first, second = a[3].astype(int), b[3].astype(int)
    qa, qb, equal = first[x], second[y], _codes(a[2].upper())[x] == _codes(b[2].upper())[y]
    left = keeps_first(qname)
    total = np.minimum(qa + qb, 200)
    wins = (qa > qb) | ((qa == qb) & left)
    first[x] = np.where(equal, total * left, np.where(wins, (qa * 0.8).astype(int), 0))
    second[y] = np.where(equal, total * (not left), np.where(~wins, (qb * 0.8).astype(int), 0))
    return first, second


def mate_qualities(qname: Column, left: Column, right: Column) -> Column:
    """struct<left, right: array<int>>: new qualities of mates, each a struct of pos, cigar, seq and qual."""

    @F.pandas_udf("struct<left: array<int>, right: array<int>>")
    def run(qname: pd.Series, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, a, b in zip(qname, left[["pos", "cigar", "seq", "qual"]].itertuples(index=False), right[["pos", "cigar", "seq", "qual"]].itertuples(index=False), strict=True):
            mates = [(int(m[0]), m[1], m[2] or "", _codes(m[3] or "").astype(int) - 33) for m in (a, b)]
            out.append([x.tolist() for x in settled(name or "*", *mates)])
        return pd.DataFrame(out, columns=["left", "right"])

    return run(qname, left, right)
