"""Base modifications of reads: the MM and ML tags decoded to places and probabilities."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "array<struct<pos: int, base: string, strand: string, code: string, likelihood: int>>"
_ENTRY = re.compile(r"([ACGTUN])([+-])([a-z]+|\d+)([.?]?)((?:,\d+)*)")
_COMPLEMENT = str.maketrans("ACGTUN", "TGCAAN")


def decode_mods(seq: str | None, reverse: bool, mm: str | None, ml: list[int] | None) -> list[tuple[int, str, str, str, int]] | None:
    """(place in seq, base, strand, code, likelihood) of each modification; likelihood is -1 without ML.

    MM counts how many bases of its kind to skip, along the read as it was
    sequenced; a reversed read's seq is searched from its end for the complement.
    Several letters are several codes of one place, digits one numbered code.
    None without MM; ValueError where MM is no such text, runs past the read or
    doesn't fit ML.
    """
    if mm is None:
        return None
    letters = np.frombuffer((seq or "").encode("ascii"), np.uint8)
    out, used = [], 0
    for text in filter(None, mm.split(";")):
        m = _ENTRY.fullmatch(text)
        if not m:
            raise ValueError(f"not a base modification: {text[:40]!r}")
        base, strand, name, _, skips = m.groups()
        codes = [name] if name[0].isdigit() else list(name)
        wanted = (base.translate(_COMPLEMENT) if reverse else base).replace("U", "T")
        places = np.arange(len(letters)) if base == "N" else np.flatnonzero(letters == ord(wanted))
        steps = np.array([int(x) for x in skips.split(",")[1:]], np.int64)
        if not len(steps):
            continue
        at = np.cumsum(steps + 1) - 1
        if at[-1] >= len(places):
            raise ValueError("base modifications run past the read")
        found = places[len(places) - 1 - at] if reverse else places[at]
        for place in found:
            for code in codes:
                if ml is not None and used >= len(ml):
                    raise ValueError("fewer likelihoods than base modifications")
                out.append((int(place), base, strand, code, int(ml[used]) if ml is not None else -1))
                used += 1
    if ml is not None and used != len(ml):
        raise ValueError("more likelihoods than base modifications")
    return sorted(out)


def base_mods(seq: Column, flag: Column, mm: Column, ml: Column) -> Column:
    """The modifications of each read, by place; see ``decode_mods``.  ml is an array of ints or null."""

    @F.pandas_udf(SCHEMA)
    def run(seq: pd.Series, reverse: pd.Series, mm: pd.Series, ml: pd.Series) -> pd.Series:
        names = ("pos", "base", "strand", "code", "likelihood")
        rows = (decode_mods(s, bool(r), m, p) for s, r, m, p in zip(seq, reverse, mm, ml, strict=True))
        return pd.Series([None if row is None else [dict(zip(names, x, strict=True)) for x in row] for row in rows], dtype=object)

    return run(seq, flag.bitwiseAND(F.lit(16)) != 0, mm, ml)
