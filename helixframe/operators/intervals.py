"""Interval joins, region lists and range scans.

Spark has no interval join: both sides are dealt to fixed bins, joined by
(chromosome, bin) and tested for overlap; of the bins that a pair shares only
the first one keeps it, so no pair comes twice and nothing is shuffled again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pileup import running, steps

BIN_SHIFT = 13


def binned(df: DataFrame, shift: int = BIN_SHIFT) -> DataFrame:
    """Rows (chrom, beg, end half-open, ...) once for every bin; empty intervals go."""
    return df.filter("end > beg").withColumn("_bin", F.explode(F.sequence(F.shiftright("beg", shift), F.shiftright(F.col("end") - 1, shift))))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", shift: int = BIN_SHIFT, repeated: bool = False) -> DataFrame:
    """Pairs (or left rows) of half-open intervals (chrom, beg, end) that overlap.

    how: inner gives the columns of ``left`` and r_<name> of ``right``; left_semi
    and left_anti give left rows, each once.  Where ``repeated``, many left rows
    have equal intervals: the distinct ones are joined by bin, the rows by their
    intervals, so that few bins don't gather all rows.
    """
    r = binned(right, shift).select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.col("_bin").alias("_rbin"))
    if how == "inner":
        left_bins = binned(left, shift)
        owner = F.greatest(F.shiftright("beg", shift), F.shiftright("r_beg", shift))
        on = (F.col("chrom") == F.col("r_chrom")) & (F.col("_bin") == F.col("_rbin")) & (F.col("beg") < F.col("r_end")) & (F.col("r_beg") < F.col("end")) & (F.col("_bin") == owner)
        return left_bins.join(r, on).drop("_bin", "_rbin")
    if repeated:
        return _by_hits(left, right, how, shift)
    # Most left rows lie within one bin and need one join alone; of the others the distinct intervals that hit decide.
    whole = (F.col("end") <= F.col("beg")) | (F.shiftright("beg", shift) == F.shiftright(F.col("end") - 1, shift))
    on = (F.col("chrom") == F.col("r_chrom")) & (F.shiftright("beg", shift) == F.col("_rbin")) & (F.col("beg") < F.col("r_end")) & (F.col("r_beg") < F.col("end")) & (F.col("end") > F.col("beg"))
    narrow = left.filter(F.coalesce(whole, F.lit(True))).join(r.select("r_chrom", "r_beg", "r_end", "_rbin"), on, how)
    return narrow.unionByName(_by_hits(left.filter(~whole), right, how, shift))


def _by_hits(left: DataFrame, right: DataFrame, how: str, shift: int) -> DataFrame:
    hits = overlap_join(left.select("chrom", "beg", "end").distinct(), right.select("chrom", "beg", "end"), "inner", shift).select("chrom", "beg", "end").distinct()
    return left.join(hits, ["chrom", "beg", "end"], how).select(*left.columns)


def compact(regions: DataFrame, touching: bool = True) -> DataFrame:
    """chrom, beg, end: overlapping (or touching) half-open intervals merged; empty ones and those without a chrom go.

    Islands are where depth is above 0.  Where touching intervals stay apart,
    places are doubled and each end moved in by one.
    """
    scaled = regions if touching else regions.withColumns({"beg": F.col("beg") * 2, "end": F.col("end") * 2 - 1})
    edges = running(steps(scaled)).filter("total = 0 OR total = d").select("chrom", "at", "d")
    found = running(edges).filter("d > 0").select("chrom", F.col("at").alias("beg"), F.col("next").alias("end"))
    return found if touching else found.select("chrom", F.expr("beg div 2").alias("beg"), F.expr("(end + 1) div 2").alias("end"))


_SCALE = {"k": 10**3, "K": 10**3, "m": 10**6, "M": 10**6, "g": 10**9, "G": 10**9}


def parse_decimal(text: str) -> int:
    """An integer with commas, a decimal part and an exponent or k, M, G."""
    m = re.fullmatch(r"([+-]?[\d,]*\.?\d*)(?:[eE]([+-]?\d+))?([kKmMgG]?)", text.strip())
    if not m or not re.search(r"\d", m[1]):
        raise ValueError(f"not a number: {text!r}")
    whole, _, fraction = m[1].replace(",", "").partition(".")
    power = int(m[2] or 0)
    digits, places = int((whole or "0") + fraction), len(fraction) - power
    value = digits * _SCALE.get(m[3], 1)
    return value // 10**places if places > 0 else value * 10**-places


def parse_region(text: str, last: int = (1 << 62)) -> tuple[str, int, int] | None:
    """(chrom, beg, end) half-open of ``chr``, ``chr:b``, ``chr:b-e``, ``chr:-e`` or ``{name}:b-e``; ``.`` is all (None)."""
    if text == ".":
        return None
    if text.startswith("{"):
        name, _, rest = text[1:].partition("}")
        rest = rest.removeprefix(":")
    else:
        name, colon, rest = text.rpartition(":")
        if not colon or not re.fullmatch(r"[\d,.eEkKmMgG+]*-?[\d,.eEkKmMgG+]*", rest):
            name, rest = text, ""
    if not rest:
        return name, 0, last
    first, dash, second = rest.partition("-")
    return name, max(0, parse_decimal(first) - 1) if first else 0, parse_decimal(second) if dash and second else last
