"""Bins of intervals on the five-level index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (shift, first bin) of the levels, finest first; bin 0 is the whole sequence.
LEVELS = [(14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)]


def reg2bin(beg: Column, end: Column) -> Column:
    """Smallest bin that holds the half-open interval whole."""
    out = None
    for shift, first in LEVELS:
        same = F.shiftright(beg, shift) == F.shiftright(end - 1, shift)
        value = F.shiftright(beg, shift) + first
        out = F.when(same, value) if out is None else out.when(same, value)
    return out.otherwise(F.lit(0)).cast("long")


def overlapping_bins(beg: Column, end: Column) -> Column:
    """All bins that may hold an overlap of the half-open interval."""
    parts = [F.sequence(F.shiftright(beg, s) + first, F.shiftright(end - 1, s) + first) for s, first in reversed(LEVELS)]
    return F.flatten(F.array(F.array(F.lit(0).cast("long")), *parts))
